"""Byte-level BPE: encoding with the tokenizers library over Arrow batches, and exact decoding.

A byte-level vocabulary is stored over characters: every byte has one printable character. The
tokenizer is built from a rank file through that table, and decoding reverses it. A text is cut
before every word with the white space that belongs to it; the vocabulary's own pattern never
matches across such a cut, so the library sees each distinct unit once per worker and a bounded
cache holds what it answered.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from foliarc.llm.common import SEPARATOR_CONTROLS, Remembered, release_memory, text_or_empty

# Units that are encoded apart: a word with at most one space before it, or white space.
UNIT = re.compile(r" ?\S+|\s+(?!\S)|\s+")
ODD = re.compile(f"[{SEPARATOR_CONTROLS}]")
LONGEST_CACHED = 64
CACHE_UNITS = 600_000
MISSES_AT_ONCE = 20_000
TEXTS_AT_ONCE = 128


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if printable Latin-1, else the next from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_halves(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two tokens whose merge makes ``token``: what lower ranks leave of its bytes."""
    parts = [token[i:i + 1] for i in range(len(token))]
    limit = ranks[token]
    while len(parts) > 2:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], limit))
        if ranks.get(parts[best] + parts[best + 1], limit) >= limit:
            raise ValueError(f"rank file is not closed under merges at rank {limit}")
        parts[best:best + 2] = [parts[best] + parts[best + 1]]
    return parts[0], parts[1]


class ByteBpe:
    """Encoder and decoder of one rank file, with a bounded cache of units."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        signs = byte_characters()
        spell = lambda token: "".join(signs[b] for b in token)
        ordered = sorted(ranks, key=ranks.get)
        merges = [tuple(map(spell, merge_halves(t, ranks))) for t in ordered if len(t) > 1]
        self.library = Tokenizer(models.BPE(vocab={spell(t): ranks[t] for t in ordered}, merges=merges))
        self.library.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split(Regex(pattern), behavior="isolated"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
        ])
        byte_of = {sign: b for b, sign in enumerate(signs)}
        self.token_bytes = {ranks[t]: bytes(byte_of[c] for c in spell(t)) for t in ordered}
        self.cache = Remembered(CACHE_UNITS)

    def encode_now(self, units: list[str]) -> list[bytes]:
        """Ids as little-endian 32-bit strings, straight from the library."""
        found = self.library.encode_batch_fast(units, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of every text, in order. The library encodes the units the cache lacks, many at a time.

        Only the units of a few texts are held at once.
        """
        for start in range(0, len(texts), TEXTS_AT_ONCE):
            part = [[t] if ODD.search(t) else UNIT.findall(t) for t in texts[start:start + TEXTS_AT_ONCE]]
            now: dict[str, bytes] = dict.fromkeys(u for units in part for u in units)
            recall = self.cache.get
            missing = []
            for unit in now:
                known = recall(unit) if len(unit) <= LONGEST_CACHED else None
                if known is None:
                    missing.append(unit)
                else:
                    now[unit] = known
            for at in range(0, len(missing), MISSES_AT_ONCE):
                some = missing[at:at + MISSES_AT_ONCE]
                for unit, ids in zip(some, self.encode_now(some)):
                    now[unit] = ids
                    if len(unit) <= LONGEST_CACHED:
                        self.cache.put(unit, ids)
            for units in part:
                yield b"".join(map(now.__getitem__, units))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))

    def decode_stream(self, ids: Iterator[int]) -> Iterator[str]:
        """Text piece by piece; bytes of a character that two tokens share wait for the rest."""
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        for token in ids:
            yield decoder.decode(self.token_bytes[token])
        yield decoder.decode(b"", True)

    def offsets(self, text: str, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """First and last-plus-one character of each token; a token inside a character covers that character."""
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
        character = np.cumsum((raw & 0xC0) != 0x80) - 1
        ends = np.cumsum([len(self.token_bytes[i]) for i in ids], dtype=np.int64)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        return (character[starts], character[ends - 1] + 1) if len(ids) else (starts, ends)


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> ByteBpe:
    """One encoder per worker process and rank file."""
    return ByteBpe(read_ranks(path), pattern)


ENCODED = StructType([StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()),
                      StructField("decoded_sha256", StringType())])


def ids_column(text: Column, ranks_path: str, pattern: str) -> Column:
    """Token ids of a text column as array<int>; a null text has none."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = encoder(ranks_path, pattern)
        for batch in batches:
            yield pd.Series([np.frombuffer(b, dtype="<i4") for b in bpe.encode_all(batch.tolist())], dtype=object)

    return encode(F.coalesce(text, F.lit("")))


def digests_column(text: Column, ranks_path: str, pattern: str) -> Column:
    """Encode, decode again, and keep the count and both digests; ids never leave the worker."""

    @F.pandas_udf(ENCODED)
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = encoder(ranks_path, pattern)
        for batch in batches:
            rows = []
            for packed in bpe.encode_all(batch.tolist()):
                ids = np.frombuffer(packed, dtype="<u4").tolist()
                rows.append((len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()))
            yield pd.DataFrame(rows, columns=ENCODED.names)
        release_memory()

    return digest(F.coalesce(text, F.lit("")))


def decode_column(ids: Column, ranks_path: str, pattern: str) -> Column:
    """Text of an id column. Bytes that form no character become U+FFFD; null ids decode to null."""

    @F.pandas_udf(StringType())
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = encoder(ranks_path, pattern)
        for batch in batches:
            yield pd.Series([None if i is None else bpe.decode(i.tolist()).decode("utf-8", "replace") for i in batch], dtype=object)

    return decode(ids)


def offsets_column(text: Column, ranks_path: str, pattern: str) -> Column:
    """Character spans [start, end) of the tokens, as array<struct<start, end>>."""
    span = StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])

    @F.pandas_udf(ArrayType(span))
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = encoder(ranks_path, pattern)
        for batch in batches:
            texts = batch.tolist()
            out = []
            for text, packed in zip(texts, bpe.encode_all(texts)):
                first, last = bpe.offsets(text, np.frombuffer(packed, dtype="<u4").tolist())
                out.append([{"start": int(a), "end": int(b)} for a, b in zip(first, last)])
            yield pd.Series(out, dtype=object)

    return spans(F.coalesce(text, F.lit("")))


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of ``docs`` (doc_id, text).

    Null and empty texts have no tokens and the digest of no bytes. Repeated rows are answered
    each; other columns are ignored; an empty table gives an empty result. No exchange: texts
    stay where they were read, and whole texts of any length are encoded.
    """
    found = docs.select(F.col("doc_id"), digests_column(text_or_empty(), ranks_path, pattern).alias("found"))
    return found.select("doc_id", "found.n_tokens", "found.ids_sha256", "found.decoded_sha256")

"""Media columns stored as content-defined chunks.

A payload becomes 8-bit mono WAV media. A rolling gear hash cuts the media where its content says
so, and every chunk has a digest. Digests that occur more than once are found by a Spark
aggregate; their chunks are stored once in a chunk store, all others lie inline in the media's
own row. Media are rebuilt by joining their ordered chunk lists with the store, verified against
the stored digest, and only then decoded.

A compact bit table of the shared digests, of bounded size, tells the writing tasks which chunks
to send to the store. Its false hits only move a chunk to the store that could have stayed inline.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliarc.llm.common import staged, text_or_empty

BLOCK = 64
RATE = 8000
HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")
# Chunk sizes in bytes; a cut is due where the top CUT_BITS bits of the gear hash are zero.
SMALLEST, LARGEST, CUT_BITS = 256, 8192, 10
WINDOW = 32
DIGEST = 16
MAX_BITS = 1 << 26
BITS_A_DIGEST = 16
PROBES = 4
SENT_AT_MOST = 100_000

_GEAR = np.random.default_rng(64).integers(0, 1 << 32, 256, dtype=np.uint32)


def payload_of(text: str) -> bytes:
    raw = text.encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % BLOCK if raw else BLOCK)


def encode_media(payload: bytes) -> bytes:
    """WAV media whose unsigned 8-bit mono samples are the payload's bytes."""
    size = len(payload)
    return HEADER.pack(b"RIFF", 36 + size, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", size) + payload


def decode_media(media: bytes) -> bytes:
    head = HEADER.unpack_from(media)
    if head[0] != b"RIFF" or head[2] != b"WAVE" or head[10] != 8 or head[12] != len(media) - HEADER.size:
        raise ValueError("not 8-bit mono media of this kind")
    return media[HEADER.size:]


def cuts(data: np.ndarray) -> list[int]:
    """Ends of the content-defined chunks. The hash covers the last 32 bytes, so equal content cuts alike."""
    if len(data) <= SMALLEST:
        return [len(data)]
    rolling = _GEAR[data]
    span = 1
    while span < WINDOW:
        longer = rolling.copy()
        longer[span:] += rolling[:-span] << np.uint32(span)
        rolling, span = longer, span * 2
    ends: list[int] = []
    last = 0
    for at in (np.flatnonzero(rolling >> np.uint32(32 - CUT_BITS) == 0) + 1).tolist():
        while at - last > LARGEST:
            last += LARGEST
            ends.append(last)
        if at - last >= SMALLEST:
            ends.append(at)
            last = at
    while len(data) - last > LARGEST:
        last += LARGEST
        ends.append(last)
    if last < len(data):
        ends.append(len(data))
    return ends


def chunks_of(media: bytes) -> list[tuple[bytes, bytes]]:
    """(digest, bytes) of the chunks in order."""
    out, at = [], 0
    for end in cuts(np.frombuffer(media, np.uint8)):
        piece = media[at:end]
        out.append((hashlib.sha256(piece).digest()[:DIGEST], piece))
        at = end
    return out


def feature(payload: bytes) -> str:
    """Sum, energy around the centre, centre crossings and distinct levels of the samples."""
    levels = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((levels[1:] < 0) != (levels[:-1] < 0)))
    return f"sum={int(levels.sum())};energy={int((levels * levels).sum())};crossings={crossings};levels={len(np.unique(levels))}"


def described(media: bytes, digest: bytes) -> tuple:
    """Features of media read back; raises if they are not what was stored."""
    if hashlib.sha256(media).digest() != digest:
        raise ValueError("media differ from what was stored")
    payload = decode_media(media)
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), feature(payload)


def shared_table(texts: DataFrame) -> tuple[int, array]:
    """Bit table of the digests that occur more than once, ``PROBES`` bits each, and its size in bits."""

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"digest": [d for t in batch["text"] for d, _ in chunks_of(encode_media(payload_of(t)))]})

    counted = texts.mapInPandas(digests, "digest binary").groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    shared = staged(counted.filter("n > 1").select("digest"), "shared-digests")
    bits = 1024
    wanted = min(MAX_BITS, BITS_A_DIGEST * shared.count())
    while bits < wanted:
        bits *= 2
    first, step = F.crc32("digest"), F.crc32(F.substring("digest", DIGEST // 2 + 1, DIGEST // 2)).bitwiseOR(F.lit(1))
    at = shared.select(F.explode(F.array(*[(first + step * i).bitwiseAND(F.lit(bits - 1)) for i in range(PROBES)])).alias("at"))
    words = at.groupBy(F.expr("shiftright(at, 5)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, int(at & 31)))").alias("bits")).toPandas()
    table = array("I", bytes(bits // 8))
    for word, found in zip(words["word"].tolist(), words["bits"].tolist()):
        table[word] = found
    return bits, table


def listed(digest: bytes, bits: int, table: array) -> bool:
    """Whether all probes of a digest are set in the table."""
    at, step = zlib.crc32(digest), zlib.crc32(digest[DIGEST // 2:]) | 1
    for _ in range(PROBES):
        place = at & (bits - 1)
        if not table[place >> 5] >> (place & 31) & 1:
            return False
        at += step
    return True


STORED = ("shared boolean, doc_id long, n_bytes long, media_bytes long, media_sha256 binary, "
          "recipe binary, outside int, bytes binary")


def store(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Write the media of ``docs`` and return (media rows, chunk store).

    A media row holds its recipe (digest and size of every chunk, in order; size 0 marks a chunk in
    the store) and its inline chunks end to end. The store holds each shared chunk once.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    bits, table = shared_table(texts)
    known = spark.sparkContext.broadcast(table)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sent: set[bytes] = set()
        for batch in batches:
            rows, moved = [], []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                media = encode_media(payload_of(text))
                recipe, inline, outside = [], [], 0
                for digest, piece in chunks_of(media):
                    if listed(digest, bits, known.value):
                        outside += 1
                        recipe.append(digest + bytes(4))
                        if digest not in sent:
                            moved.append((digest, piece))
                            if len(sent) < SENT_AT_MOST:
                                sent.add(digest)
                    else:
                        recipe.append(digest + len(piece).to_bytes(4, "little"))
                        inline.append(piece)
                rows.append((False, doc_id, len(text.encode("utf-8", "surrogatepass")), len(media), hashlib.sha256(media).digest(),
                             b"".join(recipe), outside, b"".join(inline)))
            frame = pd.DataFrame(rows, columns=[c.split()[0] for c in STORED.split(", ")])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame
            for at in range(0, len(moved), 4096):
                part = moved[at:at + 4096]
                yield pd.DataFrame({"shared": True, "doc_id": pd.array([None] * len(part), "Int64"), "n_bytes": 0, "media_bytes": 0, "media_sha256": b"",
                                    "recipe": [d for d, _ in part], "outside": 0, "bytes": [p for _, p in part]})

    path_rows = compact(texts.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(write, STORED), "media")
    media = path_rows.filter("not shared").drop("shared")
    once = path_rows.filter("shared").groupBy(F.col("recipe").alias("digest")).agg(F.first("bytes").alias("bytes"))
    return media, compact(once, "chunks")


def compact(df: DataFrame, label: str) -> DataFrame:
    """``staged`` with a denser codec: payload bytes make up these tables."""
    spark = df.sparkSession
    before = spark.conf.get("spark.sql.parquet.compression.codec")
    spark.conf.set("spark.sql.parquet.compression.codec", "zstd")
    try:
        return staged(df, label)
    finally:
        spark.conf.set("spark.sql.parquet.compression.codec", before)


DESCRIBED = "payload_bytes long, payload_sha256 string, tail_crc32 long, feature string"


def inline_features(digest: Column, inline: Column) -> Column:
    @F.pandas_udf(DESCRIBED)
    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for digests, parts in batches:
            yield pd.DataFrame([described(bytes(p), bytes(d)) for d, p in zip(digests, parts)], columns=["payload_bytes", "payload_sha256", "tail_crc32", "feature"])

    return read(digest, inline)


def joined_features(digest: Column, recipe: Column, inline: Column, pieces: Column) -> Column:
    @F.pandas_udf(DESCRIBED)
    def read(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [described(rebuilt(bytes(r), bytes(i), {int(p["at"]): bytes(p["bytes"]) for p in found}), bytes(d)) for d, r, i, found in zip(*batch)]
            yield pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "feature"])

    return read(digest, recipe, inline, pieces)


def rebuilt(recipe: bytes, inline: bytes, borrowed: dict[int, bytes]) -> bytes:
    """Media of an ordered chunk list: inline chunks by their sizes, others by their place."""
    out, at = [], 0
    for place, start in enumerate(range(0, len(recipe), DIGEST + 4)):
        size = int.from_bytes(recipe[start + DIGEST:start + DIGEST + 4], "little")
        out.append(inline[at:at + size] if size else borrowed[place])
        at += size
    return b"".join(out)


def read_back(media: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media_bytes, media_sha256, payload_bytes, payload_sha256, tail_crc32, feature) from stored media.

    Media whose chunks all lie inline never move. The others are rebuilt once per distinct media, so
    a text with many copies costs one rebuild, and the result is joined back to its documents.
    """
    narrow = ["doc_id", "n_bytes", "media_bytes", "media_sha256"]
    alone = media.filter("outside = 0").select(*narrow, inline_features(F.col("media_sha256"), F.col("bytes")).alias("f"))
    parted = media.filter("outside > 0")
    distinct = parted.groupBy("media_sha256").agg(F.first(F.struct("recipe", "bytes")).alias("m")).select("media_sha256", "m.recipe", "m.bytes")
    recipes = parted.groupBy("media_sha256").agg(F.first("recipe").alias("recipe"))
    count = (F.length("recipe") / (DIGEST + 4)).cast("int")
    place = recipes.select("media_sha256", "recipe", F.explode(F.sequence(F.lit(0), count - 1)).alias("at"))
    cell = F.expr(f"substring(recipe, at * {DIGEST + 4} + 1, {DIGEST})").alias("digest")
    size = F.expr(f"substring(recipe, at * {DIGEST + 4} + {DIGEST} + 1, 4)").alias("size")
    wanted = place.select("media_sha256", "at", cell, size).filter(F.col("size") == F.lit(bytes(4))).drop("size")
    pieces = wanted.join(chunks, "digest").groupBy("media_sha256").agg(F.collect_list(F.struct("at", "bytes")).alias("pieces"))
    features = distinct.join(pieces, "media_sha256").select(
        "media_sha256", joined_features(F.col("media_sha256"), F.col("recipe"), F.col("bytes"), F.col("pieces")).alias("f"))
    return alone.unionByName(parted.select(*narrow).join(features, "media_sha256").select(*narrow, "f")).select(*narrow, "f.*")


def media_features(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of each row of ``docs``.

    Null and empty texts have a payload of 64 zero bytes. Equal texts have equal values; repeated
    rows are answered each; other columns are ignored; an empty table gives an empty result. A
    media that cannot be read back as stored fails the query.
    """
    rows = read_back(*store(docs))
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes",
                       F.lower(F.hex("media_sha256")).alias("media_sha256"), "feature")

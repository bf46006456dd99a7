"""Token counts by two-tier lookup on the map side.

A pre-token is a run without white space: the tokenizer drops white space before it splits, so
the count of a text is the sum over its pre-tokens. Tier one is a broadcast table of the lengths
of frequent pre-tokens, of bounded size; tier two is a worker's own bounded cache, filled by the
library. No pre-token is ever shuffled: the table is drawn from lists that a bounded sample of texts
sends straight to the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from foliarc.llm.common import SEPARATOR_CONTROLS, Remembered, release_memory, text_or_empty

ODD = re.compile(f"[{SEPARATOR_CONTROLS}]")
LONGEST_CACHED = 64
CACHE_WORDS = 800_000
TABLE_WORDS = 32_768
SAMPLE_ROWS = 4_000
WORDS_A_TEXT = 256
TEXTS_AT_ONCE = 64


@lru_cache(maxsize=2)
def library(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def lengths_of(path: str, words: list[str]) -> list[int]:
    return [len(e) for e in library(path).encode_batch_fast(words, add_special_tokens=False)]


def frequent_lengths(docs: DataFrame, path: str, words: int = TABLE_WORDS, sample_rows: int = SAMPLE_ROWS) -> dict[str, int]:
    """Lengths of the pre-tokens that most texts of a sample hold: only a cache, so a sample is enough.

    Each of about ``sample_rows`` texts lists at most ``WORDS_A_TEXT`` of its words, so what reaches the
    driver is bounded at every size; at most ``words`` of them make the table.
    """

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text in batch["text"]:
                distinct = dict.fromkeys(w for w in text.split() if len(w) <= LONGEST_CACHED)
                yield pd.DataFrame({"word": list(distinct)[:WORDS_A_TEXT]}, dtype=object)

    rows = docs.count()
    texts = docs.select(text_or_empty().alias("text"))
    sample = texts.sample(fraction=sample_rows / rows, seed=1) if rows > sample_rows else texts
    seen = sample.mapInPandas(listed, "word string").toPandas()["word"].value_counts()
    common = sorted(seen[seen > 1].index[:words])
    return dict(zip(common, lengths_of(path, common)))


_CACHE: dict[str, Remembered] = {}


def count_texts(texts: list[str], table: dict[str, int], cache: Remembered, path: str) -> list[int]:
    """Counts of a few texts; the library is called once for all words that both tiers lack."""
    split = [None if ODD.search(t) else t.split() for t in texts]
    now: dict[str, int] = dict.fromkeys(w for own in split if own is not None for w in own)
    missing = []
    for word in now:
        n = table.get(word)
        if n is None:
            n = cache.get(word) if len(word) <= LONGEST_CACHED else None
            if n is None:
                missing.append(word)
        now[word] = n
    for word, n in zip(missing, lengths_of(path, missing)):
        now[word] = n
        if len(word) <= LONGEST_CACHED:
            cache.put(word, n)
    return [lengths_of(path, [text])[0] if own is None else sum(map(now.__getitem__, own)) for text, own in zip(texts, split)]


def count_tokens(docs: DataFrame, path: str, limit: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of ``docs`` (doc_id, text).

    Counts are those of the library's default call without added special tokens; special strings
    inside a text count as it counts them. Null and empty texts have 0 bytes and 0 tokens.
    Repeated rows are answered each, other columns are ignored, an empty table gives none.
    """
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path))

    @F.pandas_udf(LongType())
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache = _CACHE.setdefault(path, Remembered(CACHE_WORDS))
        for batch in batches:
            texts = batch.tolist()
            parts = (texts[at:at + TEXTS_AT_ONCE] for at in range(0, len(texts), TEXTS_AT_ONCE))
            yield pd.Series([n for part in parts for n in count_texts(part, table.value, cache, path)], dtype="int64")
        release_memory()

    text = text_or_empty()
    counted = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), tokens(text).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))

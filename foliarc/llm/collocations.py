"""Phrase collocations by direct-address tiling.

Frequent words get ids by falling frequency, so common pairs of neighbours fall into few square tiles
of the id plane. A task packs a pair into its tile and its place inside; tiles that many pairs hit are
counted with a dense ``bincount``, the others as sorted COO (place, count). Frequent pairs are ranked
again and become the units of the next level: two overlapping phrases of k words are one of k + 1.

Tables of frequent units reach the tasks in slices of at most ``SLICE`` rows, one pass over the coded
texts a slice, so no broadcast grows with the corpus and no unit is left out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliarc.llm.common import partitions, release_memory, staged, text_or_empty

LEAST, LONGEST = 30, 4
WORD = re.compile(rb"[^\x20\x09.,;:!?\x0A-\x0D]+")
TOKEN = re.compile(rb"[^\x20\x09.,;:!?\x0A-\x0D]+|[.,;:!?\x0A-\x0D]+")
ID_BITS = 31
TILE_BITS = 8
DENSE_FROM = 1 << 13  # pairs of one buffer in one tile from which it is counted densely
DENSE_TILES = 64
BUFFER = 1 << 19
HELD_WORDS = 200_000
SLICE = 1 << 22
FETCH = 1 << 19
IDS_AT_ONCE = 1 << 17
CHARS_AT_ONCE = 1 << 20
GAP = -1


def few(lengths: list[int], most: int) -> Iterator[slice]:
    """Neighbouring places whose lengths sum to about ``most``."""
    start = held = 0
    for at, length in enumerate(lengths):
        held += length
        if held >= most:
            yield slice(start, at + 1)
            start, held = at + 1, 0
    if start < len(lengths):
        yield slice(start, len(lengths))


def folded(text: str) -> bytes:
    """UTF-8 with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower()


def named(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_or_empty().alias("text"))


def count_words(docs: DataFrame) -> DataFrame:
    """(lang, word, n) over all texts; tasks hold a bounded number of words and pass on sums."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Counter] = {}

        def out() -> Iterator[pd.DataFrame]:
            for lang, seen in held.items():
                if seen:
                    yield pd.DataFrame({"lang": lang, "word": [w.decode("utf-8", "replace") for w in seen], "n": list(seen.values())})
            held.clear()

        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                held.setdefault(lang, Counter()).update(WORD.findall(folded(text)))
                if sum(map(len, held.values())) > HELD_WORDS:
                    yield from out()
        yield from out()
        release_memory()

    return docs.mapInPandas(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def ranked(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Adds ``id``: the place by falling ``n``, ties by ``keys``, from 0. Range partitions are sorted apart."""
    order = [F.desc("n"), *keys]
    laid = df.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    laid = staged(laid.withColumn("__mid", F.monotonically_increasing_id()), label)
    part = F.shiftright("__mid", 33)
    sizes = laid.groupBy(part.alias("__part")).count().orderBy("__part").collect()  # a row for each partition
    starts = np.cumsum([0] + [r["count"] for r in sizes]).tolist()
    table = df.sparkSession.createDataFrame([(r["__part"], s) for r, s in zip(sizes, starts)], "__at long, __start long")
    placed = laid.join(F.broadcast(table), part == F.col("__at"))
    return placed.withColumn("id", F.col("__start") + F.col("__mid").bitwiseAND((1 << 33) - 1)).drop("__mid", "__at", "__start")


def digests(lang: str, word: str) -> Column:
    """Struct (hi, lo) that names a word of a language."""

    @F.pandas_udf("hi long, lo long")
    def run(langs: pd.Series, words: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([halves(a, b.encode("utf-8")) for a, b in zip(langs, words)], columns=["hi", "lo"], dtype="int64")

    return run(lang, word)


def halves(lang: str, word: bytes) -> tuple[int, int]:
    both = np.frombuffer(xxhash.xxh3_128_digest(lang.encode("utf-8") + b"\x00" + word), "<i8")
    return int(both[0]), int(both[1])


def slices(table: DataFrame, columns: list[str], rows: int) -> Iterator[tuple]:
    """(broadcast, first, last) for each slice: the table of ids as arrays sorted by their first column, at most ``SLICE`` ids each.

    The driver holds one slice, fetched as Arrow columns of at most ``FETCH`` rows; a broadcast is given up when the
    next is asked for, so a pass over it must have ended by then.
    """
    for low in range(0, max(rows, 1), SLICE):
        high = min(low + SLICE, rows)
        held = [np.empty(high - low, np.int64) for _ in range(len(columns) + 1)]
        filled = 0
        for at in range(low, high, FETCH):
            part = table.filter(F.col("id").between(at, min(at + FETCH, high) - 1)).select(*columns, "id").toArrow()
            for array, column in zip(held, part.columns):
                array[filled:filled + len(part)] = column.to_numpy()
            filled += len(part)
            del part, column
        if filled != high - low:
            raise RuntimeError(f"{filled} ids of {high - low} from {low}")
        order = np.argsort(held[0], kind="stable")
        for place in range(len(held)):
            held[place] = held[place][order]
        shared = table.sparkSession.sparkContext.broadcast(tuple(held))
        del held, order
        release_memory()
        yield shared, low == 0, high == rows
        shared.destroy()


def found(keys: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``keys`` in sorted ``names``, and whether they stand there."""
    if not len(names):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(names, keys), len(names) - 1)
    return at, names[at] == keys


def closed(ids: np.ndarray) -> np.ndarray:
    """Ids with runs of gaps made one gap."""
    return ids[(ids != GAP) | np.append(True, ids[:-1] != GAP)] if len(ids) else ids


def sequences(column: pa.ListArray) -> list[np.ndarray]:
    """The lists of a column as views of its values."""
    values, at = column.values.to_numpy(), column.offsets.to_numpy().tolist()
    return [values[a:b] for a, b in zip(at, at[1:])]


def listed(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0] + [len(a) for a in arrays], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays).astype(np.int64, copy=False)))


def code_words(docs: DataFrame, words: DataFrame, rows: int) -> DataFrame:
    """``seq``: ids of the frequent words of each text in order, one gap for whatever parts them."""

    def coding(table, first: bool, last: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            hi, lo, ids = table.value
            for batch in batches:
                for part in few([len(t) for t in batch["text"]], CHARS_AT_ONCE):
                    some = batch.iloc[part]
                    tokens = [TOKEN.findall(folded(t)) for t in some["text"]]
                    known: dict[str, dict[bytes, int]] = {}
                    for lang, own in zip(some["lang"], tokens):
                        known.setdefault(lang, {}).update(dict.fromkeys(own, GAP))
                    for lang, seen in known.items():
                        key = np.array([halves(lang, w) for w in seen], np.int64).reshape(-1, 2)
                        at, hit = found(key[:, 0], hi)
                        hit[hit] = lo[at[hit]] == key[hit, 1]
                        known[lang] = dict(zip(seen, np.where(hit, ids[at], GAP).tolist() if len(ids) else [GAP] * len(seen)))
                    seqs = []
                    for row, (lang, own) in enumerate(zip(some["lang"], tokens)):
                        seq = np.fromiter(map(known[lang].__getitem__, own), np.int64, len(own))
                        if not first:
                            seq = np.maximum(seq, some["seq"].iloc[row])
                        seqs.append(closed(seq) if last else seq)
                    yield pd.DataFrame({"seq": seqs}) if last else pd.DataFrame({"lang": some["lang"], "text": some["text"], "seq": seqs})
            release_memory()

        return run

    out = docs
    keyed = words.withColumn("__d", digests("lang", "word")).select("__d.hi", "__d.lo", "id")
    for table, first, last in slices(keyed, ["hi", "lo"], rows):
        out = staged(out.mapInPandas(coding(table, first, last), "seq array<long>" if last else "lang string, text string, seq array<long>"), "coded")
    return out


def code_pairs(seqs: DataFrame, pairs: DataFrame, rows: int) -> DataFrame:
    """``seq`` of the next level: the id of each frequent pair of neighbours."""

    def coding(table, first: bool, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, ids = table.value
            for batch in batches:
                given = sequences(batch["seq"])
                before = None if first else sequences(batch["next"])
                for part in few([len(seq) for seq in given], IDS_AT_ONCE):
                    made = []
                    for row in range(part.start, part.stop):
                        left, right = given[row][:-1], given[row][1:]
                        at, hit = found((left << ID_BITS) | right, names)
                        now = np.where(hit & (left != GAP) & (right != GAP), ids[at], GAP) if len(ids) else np.full(len(at), GAP)
                        now = now if first else np.maximum(now, before[row])
                        made.append(closed(now) if last else now)
                    if last:
                        yield pa.RecordBatch.from_arrays([listed(made)], names=["seq"])
                    else:
                        yield pa.RecordBatch.from_arrays([listed(given[part]), listed(made)], names=["seq", "next"])
                del given, before
            release_memory()

        return run

    key = F.shiftleft("p", ID_BITS).bitwiseOR(F.col("s"))
    out = seqs
    for table, first, last in slices(pairs.select(key.alias("key"), "id"), ["key"], rows):
        out = staged(out.mapInArrow(coding(table, first, last), "seq array<long>" if last else "seq array<long>, next array<long>"), "coded")
    return out


def packed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Pairs of ids as tile row, tile column, row inside, column inside."""
    inside = (1 << TILE_BITS) - 1
    tile = ((left >> TILE_BITS) << (ID_BITS - TILE_BITS)) | (right >> TILE_BITS)
    return (tile << (2 * TILE_BITS)) | ((left & inside) << TILE_BITS) | (right & inside)


def unpacked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = (1 << TILE_BITS) - 1
    tile = key >> (2 * TILE_BITS)
    row, column = tile >> (ID_BITS - TILE_BITS), tile & ((1 << (ID_BITS - TILE_BITS)) - 1)
    return (row << TILE_BITS) | ((key >> TILE_BITS) & inside), (column << TILE_BITS) | (key & inside)


class Tiles:
    """Counts of pairs of ids in bounded memory: dense tiles, and sorted COO for the rest."""

    def __init__(self) -> None:
        self.dense: dict[int, np.ndarray] = {}
        self.sparse: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, key: np.ndarray) -> None:
        """Counts packed pairs."""
        key = np.sort(key)
        tile = key >> (2 * TILE_BITS)
        edge = np.flatnonzero(np.append(len(key) > 0, tile[1:] != tile[:-1]))
        size = np.diff(np.append(edge, len(key)))
        dense = np.isin(tile[edge], np.fromiter(self.dense, np.int64, len(self.dense)))
        for at in np.flatnonzero(~dense & (size >= DENSE_FROM))[:DENSE_TILES - len(self.dense)]:
            self.dense[int(tile[edge[at]])] = np.zeros(1 << (2 * TILE_BITS), np.int64)
            dense[at] = True
        rest = np.repeat(~dense, size)
        for at in np.flatnonzero(dense):
            places = key[edge[at]:edge[at] + size[at]] & ((1 << (2 * TILE_BITS)) - 1)
            self.dense[int(tile[edge[at]])] += np.bincount(places, minlength=1 << (2 * TILE_BITS))
        self.merge([(key[rest], np.ones(int(rest.sum()), np.int64))])

    def merge(self, more: list[tuple[np.ndarray, np.ndarray]]) -> None:
        key, n = (np.concatenate(c) for c in zip(*more))
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        edge = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        self.sparse.append((key[edge], np.add.reduceat(n, edge) if len(edge) else n))
        self.held += len(edge)

    def settle(self, most: int) -> Iterator[pd.DataFrame]:
        """Merges the sparse part once it exceeds ``most``, and passes it on where that is not enough."""
        if self.held > most:
            parts, self.sparse, self.held = self.sparse, [], 0
            self.merge(parts)
            if self.held > most // 2:
                yield self.frame(*self.sparse[0])
                self.sparse, self.held = [], 0

    def rest(self) -> Iterator[pd.DataFrame]:
        for name, counts in self.dense.items():
            place = np.flatnonzero(counts)
            yield self.frame((np.int64(name) << (2 * TILE_BITS)) | place, counts[place])
        if self.sparse:
            parts, self.sparse, self.held = self.sparse, [], 0
            self.merge(parts)
            yield self.frame(*self.sparse[0])

    @staticmethod
    def frame(key: np.ndarray, n: np.ndarray) -> pd.DataFrame:
        p, s = unpacked(key)
        return pd.DataFrame({"p": p, "s": s, "n": n})


def count_pairs(seqs: DataFrame, least: int) -> DataFrame:
    """(p, s, n) of the neighbouring ids that stand together ``least`` times or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames(batches):
            yield pa.RecordBatch.from_pandas(frame, preserve_index=False)

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        tiles, waiting, held = Tiles(), [], 0
        for batch in batches:
            for seq in sequences(batch["seq"]):
                left, right = seq[:-1], seq[1:]
                both = (left != GAP) & (right != GAP)
                waiting.append(packed(left[both], right[both]))
                held += len(waiting[-1])
                if held >= BUFFER:
                    tiles.add(np.concatenate(waiting))
                    waiting, held = [], 0
                    yield from tiles.settle(2 * BUFFER)
        if held:
            tiles.add(np.concatenate(waiting))
        yield from tiles.rest()
        release_memory()

    counted = seqs.mapInArrow(run, "p long, s long, n long").groupBy("p", "s").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= least)


def described(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """Phrases one word longer than ``units``: their words and the counts of their first and last parts."""
    first = units.select(F.col("id").alias("p"), "lang", "phrase", "heads", F.col("n").alias("__head"))
    second = units.select(F.col("id").alias("s"), "last", "tails", F.col("n").alias("__tail"))
    both = pairs.join(first, "p").join(second, "s")
    return both.select("id", "p", "s", "n", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last",
                       F.concat("heads", F.array("__head")).alias("heads"), F.concat("tails", F.array("__tail")).alias("tails"))


def lowest_cut(words: int) -> Column:
    """The cut (score, k, l, r) of a phrase with the lowest score, ties to the smallest k; exact in decimals."""
    cuts = []
    for k in range(1, words):
        left, right = F.col("heads")[k - 1], F.col("tails")[words - k - 1]
        score = F.call_function("div", F.col("n").cast("decimal(20,0)") * F.lit(2_000_000).cast("decimal(7,0)"), (left + right).cast("decimal(20,0)"))
        cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")))
    return F.array_min(F.array(*cuts))


def collocations(docs: DataFrame, most: int = 2000, least: int = LEAST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``most`` best phrases of 2 to 4 words of each language.

    Texts are split at ``. , ; : ! ?`` and line ends, then at blanks and tabs; A-Z is lower-cased. A null
    text is empty, a null lang ``und``. Phrases occur ``least`` times or more; one inside a longer one that
    has 80 percent of its count is dropped. Since counts only fall with length, the phrases one word longer
    decide that. Repeated rows count each; other columns are ignored; an empty table gives no rows. Ids have
    31 bits: up to two thousand million different frequent phrases of one length.
    """
    texts = named(docs)
    words = staged(count_words(texts), "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    frequent = ranked(words.filter(F.col("n") >= least), ["lang", "word"], "frequent")
    rows = words.filter(F.col("n") >= least).count()
    seqs = code_words(texts, frequent, rows)
    empty = F.array().cast("array<long>")
    units = frequent.select("id", "n", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), empty.alias("heads"), empty.alias("tails"))
    levels: list[DataFrame] = []
    for length in range(2, LONGEST + 1):
        pairs = ranked(count_pairs(seqs, least), ["p", "s"], "pairs")
        if length < LONGEST:
            seqs = code_pairs(seqs, pairs, pairs.count())
        units = staged(described(pairs, units), "phrases")
        levels.append(units)
    parts = []
    for at, level in enumerate(levels):
        if at + 1 < len(levels):
            longer = levels[at + 1]
            inside = longer.select(F.col("p").alias("id"), "n").union(longer.select(F.col("s").alias("id"), "n"))
            level = level.join(inside.groupBy("id").agg(F.max("n").alias("__longer")), "id", "left")
            level = level.filter(F.coalesce(F.col("__longer") * 100 < F.col("n") * 80, F.lit(True)))
        parts.append(level.select("lang", "phrase", F.col("n").alias("a"), lowest_cut(at + 2).alias("cut")))
    scored = parts[0].unionByName(parts[1]).unionByName(parts[2]).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    top = scored.withColumn("rank", place.cast("long")).filter(F.col("rank") <= most)
    return top.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")

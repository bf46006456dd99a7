"""Exact removal of repeated byte strings with suffix arrays, spread over content-chosen fragments.

A string of ``width`` bytes is represented by the smallest hash among its ``GRAM``-byte grams, so
equal strings choose the same gram wherever they stand. Neighbouring strings that chose the same
gram form one fragment, and all fragments of a gram meet in one task. Equal fragments are merged
there; the different ones of a gram are laid end to end and sorted by the linear grouping
construction, and strings that stand side by side with ``width`` common bytes are repeats. Grams
that occur once never leave the first exchange.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from foliarc.llm.common import partitions, release_memory, staged, text_or_empty
from foliarc.llm.suffix_array import ranges, suffix_arrays

WIDTH = 100
GRAM = 32
SLICE = 1 << 19  # bytes hashed at once; longer texts go in overlapping slices
SORT_AT_ONCE = 1 << 19
LONG_STRING = 1 << 14  # longer strings of one gram are cut down before they are sorted
COMMON = 20_000  # fragments of one gram that one task sorts
NO_ID = (1 << 63) - 1

_RNG = np.random.default_rng(20_11)
_SYMBOL = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least ``n`` of each."""
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(10, int(n).bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


class Hashes:
    """Hashes of any substring of one byte array, the same wherever the substring stands."""

    def __init__(self, data: np.ndarray):
        self.up, down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_SYMBOL[data] * down[:-1], dtype=np.uint64, out=self.sums[1:])

    def grams(self, k: int) -> np.ndarray:
        return mixed((self.sums[k:] - self.sums[:-k]) * self.up[:len(self.sums) - k])

    def spans(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.up[start] + (stop - start).astype(np.uint64))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    have = 1
    while have * 2 <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    rest = width - have
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def fragments(data: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Fragments of the texts laid end to end in ``data``: text number, start, number of strings, gram, digest.

    ``bounds`` holds the ends of the texts. Starts count from the beginning of ``data``.
    """
    hashes = Hashes(data)
    gram = hashes.grams(GRAM)
    packed = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
    choice = (sliding_min(packed, width - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    begins = np.concatenate([[0], bounds[:-1]])
    counts = np.maximum(bounds - begins - width + 1, 0)
    string = ranges(begins, counts)
    owner = np.repeat(np.arange(len(bounds)), counts)
    chosen = choice[string]
    edge = np.flatnonzero(np.append(True, (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1])))
    size = np.diff(np.append(edge, len(string)))
    start = string[edge]
    return owner[edge], start, size, gram[chosen[edge]], hashes.spans(start, start + size + width - 1)


FRAGMENT = "gram long, digest long, id long, tie long, start long, strings int"
REPEAT = "gram long, id long, tie long, start long, stop long"


def cut(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held: list[tuple[int, int, int, bytes]] = []
            weight = 0
            for i, t, text in zip(batch["id"].to_numpy(), batch["tie"].to_numpy(), batch["text"]):
                raw = text.encode("utf-8", "surrogatepass")
                for at in range(0, max(1, len(raw) - width + 1), SLICE):
                    piece = raw[at:at + SLICE + width - 1]
                    if len(piece) < width:
                        continue
                    held.append((i, t, at, piece))
                    weight += len(piece)
                    if weight >= SLICE:
                        yield cut_now(held, width)
                        held, weight = [], 0
            if held:
                yield cut_now(held, width)
        release_memory()

    return run


def cut_now(held: list[tuple[int, int, int, bytes]], width: int) -> pd.DataFrame:
    data = np.frombuffer(b"".join(h[3] for h in held), np.uint8)
    bounds = np.cumsum([len(h[3]) for h in held])
    owner, start, size, gram, digest = fragments(data, bounds, width)
    ids, ties, base = (np.array([h[j] for h in held], np.int64) for j in range(3))
    begins = np.concatenate([[0], bounds[:-1]])
    return combined(gram.view(np.int64), digest.view(np.int64), ids[owner], ties[owner], start - begins[owner] + base[owner], size)


def combined(gram, digest, ids, ties, start, size) -> pd.DataFrame:
    """Map-side combine: of equal fragments at hand all but the first are repeats already.

    Those keep no gram to meet at; they get a spread one and a negative size, and are only passed on.
    """
    by = np.lexsort((start, ties, ids, size, digest, gram))
    gram, digest, ids, ties, start, size = (c[by] for c in (gram, digest, ids, ties, start, size))
    known = np.append(False, (gram[1:] == gram[:-1]) & (digest[1:] == digest[:-1]) & (size[1:] == size[:-1]))
    spread = mixed((start + ids).astype(np.uint64)).view(np.int64)
    return pd.DataFrame({"gram": np.where(known, spread, gram), "digest": np.where(known, 0, digest), "id": ids, "tie": ties,
                         "start": start, "strings": np.where(known, -size, size).astype(np.int32)})


def whole_groups(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Regroup sorted batches so that a key never spans two of them."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        keys = batch[key].to_numpy()
        last = int(np.searchsorted(keys, keys[-1]))
        if last:
            yield pd.concat([*held, batch.iloc[:last]], ignore_index=True)
            held = []
        elif held and held[-1][key].iat[-1] != keys[0]:
            yield pd.concat(held, ignore_index=True)
            held = []
        held.append(batch.iloc[last:])
    if held:
        yield pd.concat(held, ignore_index=True)


def merge_equal(width: int):
    """Of fragments sorted by gram, digest and position: spans of all but the first of equal ones, and
    those first ones (``sort``) where their gram has several. Only one row is carried between batches.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple | None = None
        waiting: pd.DataFrame | None = None  # first fragment of the gram read last, while it is the only one
        for batch in batches:
            known = batch["strings"] < 0
            if known.any():
                done = batch.loc[known, ["id", "tie", "start"]]
                yield done.assign(gram=0, stop=done["start"] - batch.loc[known, "strings"] + width - 1, sort=False)
                batch = batch[~known]
            if not len(batch):
                continue
            gram, digest, strings = (batch[c].to_numpy() for c in ("gram", "digest", "strings"))
            row = batch[["gram", "id", "tie", "start"]].assign(stop=batch["start"] + strings + width - 1)
            new = np.append(last is None or last[0] != gram[0], gram[1:] != gram[:-1])
            first = new | np.append(last is None or last[1:] != (digest[0], strings[0]), (digest[1:] != digest[:-1]) | (strings[1:] != strings[:-1]))
            edge = np.flatnonzero(np.append(True, new[1:]))
            several = np.add.reduceat(first.astype(np.int64), edge) > 1
            if not new[0] and first[:edge[1] if len(edge) > 1 else None].any():
                several[0] = True
                if waiting is not None:
                    yield waiting.assign(sort=True)
            if new[0] or several[0] or len(edge) > 1:
                waiting = None
            keep = first & np.repeat(several, np.diff(np.append(edge, len(gram))))
            if (~first).any():
                yield row[~first].assign(gram=0, sort=False)
            if keep.any():
                yield row[keep].assign(sort=True)
            if new[edge[-1]] and not several[-1]:
                waiting = row.iloc[edge[-1]:edge[-1] + 1]
            last = (gram[-1], digest[-1], strings[-1])

    return run


def repeats_of(rows: pd.DataFrame, width: int) -> pd.DataFrame:
    """Spans of the fragments in ``rows`` (sorted by gram and position) that earlier ones of their gram repeat."""
    gram = rows["gram"].to_numpy()
    pieces = rows["bytes"].tolist()
    sizes = np.array([len(p) for p in pieces])
    data = np.frombuffer(b"".join(pieces), np.uint8)
    ends = np.cumsum(sizes)
    last = np.append(gram[1:] != gram[:-1], True)
    # One more symbol after each fragment: 0 ends a gram's string, 1 parts its fragments.
    symbols = np.empty(len(data) + len(sizes), np.int64)
    close = ends + np.arange(len(sizes))
    inside = np.ones(len(symbols), bool)
    inside[close] = False
    symbols[inside] = data.astype(np.int64) + 2
    symbols[close] = np.where(last, 0, 1)
    string_ends = close[last] + 1
    order = suffix_arrays(symbols, np.diff(np.append(0, string_ends)))
    begin = close - sizes
    complete = np.zeros(len(symbols), bool)
    complete[ranges(begin, np.maximum(sizes - width + 1, 0))] = True
    order = order[complete[order]]
    # Neighbours in the order that share all their bytes; the hash only spares comparisons.
    in_data = np.cumsum(inside) - 1
    place = in_data[order]
    marks = Hashes(data).spans(place, place + width)
    same = np.append(False, marks[1:] == marks[:-1])
    check = np.flatnonzero(same)
    if len(check):
        views = np.lib.stride_tricks.sliding_window_view(data, width)
        for some in np.array_split(check, max(1, len(check) * width >> 24)):
            same[some] = (views[place[some]] == views[place[some - 1]]).all(axis=1)
    heads = np.flatnonzero(~same)
    if not len(heads):
        return rows.iloc[:0]
    earliest = np.repeat(np.minimum.reduceat(order, heads), np.diff(np.append(heads, len(order))))
    late = np.sort(order[order != earliest])
    if not len(late):
        return rows.iloc[:0]
    piece = np.searchsorted(close, late)
    edge = np.flatnonzero(np.append(True, (late[1:] != late[:-1] + 1) | (piece[1:] != piece[:-1])))
    run = np.diff(np.append(edge, len(late)))
    of, at = piece[edge], late[edge] - begin[piece[edge]]
    start = rows["start"].to_numpy()[of] + at
    return pd.DataFrame({"gram": 0, "id": rows["id"].to_numpy()[of], "tie": rows["tie"].to_numpy()[of], "start": start, "stop": start + run + width - 1})


def trimmed(rows: pd.DataFrame, width: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Cut a gram's many fragments down to strings that occur in more than one, and merge what became equal.

    Returns the spans already known to repeat and the rows left to sort. Only for very common
    grams, whose fragments differ mostly in text around a shared passage.
    """
    pieces = rows["bytes"].tolist()
    sizes = np.array([len(p) for p in pieces])
    hashes = Hashes(np.frombuffer(b"".join(pieces), np.uint8))
    begin = np.cumsum(sizes) - sizes
    string = ranges(begin, sizes - width + 1)
    mark = hashes.spans(string, string + width)
    _, back, count = np.unique(mark, return_inverse=True, return_counts=True)
    string = string[count[back] > 1]
    piece = np.searchsorted(begin, string, side="right") - 1
    edge = np.flatnonzero(np.append(True, (string[1:] != string[:-1] + 1) | (piece[1:] != piece[:-1]))) if len(string) else string
    of, at = piece[edge], string[edge] - begin[piece[edge]]
    size = np.diff(np.append(edge, len(string))) + width - 1
    start = rows["start"].to_numpy()[of] + at
    left = pd.DataFrame({"gram": rows["gram"].to_numpy()[of], "id": rows["id"].to_numpy()[of], "tie": rows["tie"].to_numpy()[of],
                         "start": start, "stop": start + size, "bytes": [pieces[p][a:a + n] for p, a, n in zip(of, at, size)]})
    again = left["bytes"].duplicated().to_numpy() if len(left) else np.zeros(0, bool)
    return left[again].drop(columns="bytes").assign(gram=0), left[~again]


def sort_groups(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        weight = 0
        for batch in whole_groups(batches, "gram"):
            length = np.array([len(b) + 1 for b in batch["bytes"]])
            gram = batch["gram"].to_numpy()
            edge = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
            total = np.add.reduceat(length, edge)
            heavy = total > LONG_STRING
            stop = np.append(edge[1:], len(batch))
            for i in np.flatnonzero(heavy):
                known, left = trimmed(batch.iloc[edge[i]:stop[i]], width)
                if len(known):
                    yield known[["gram", "id", "tie", "start", "stop"]]
                if len(left) > 1:
                    yield repeats_of(left, width)[["gram", "id", "tie", "start", "stop"]]
            light = batch[~np.repeat(heavy, stop - edge)]
            rest, size = light["gram"].to_numpy(), length[~np.repeat(heavy, stop - edge)]
            at = 0
            while at < len(light):
                room = np.searchsorted(np.cumsum(size[at:]), max(1, SORT_AT_ONCE - weight)) + at + 1
                if room >= len(light):
                    held.append(light.iloc[at:])
                    weight += int(size[at:].sum())
                    break
                until = int(np.searchsorted(rest, rest[room - 1], side="right"))
                yield repeats_of(pd.concat([*held, light.iloc[at:until]], ignore_index=True), width)[["gram", "id", "tie", "start", "stop"]]
                held, weight, at = [], 0, until
        if held:
            yield repeats_of(pd.concat(held, ignore_index=True), width)[["gram", "id", "tie", "start", "stop"]]
        release_memory()

    return run


def identified(docs: DataFrame) -> tuple[DataFrame, bool]:
    """``docs`` with the document order as two longs ``__id`` and ``__tie``, and whether ids had to be told apart.

    A null doc_id comes last. Rows that share a doc_id are told apart and ordered by a hash of
    their text, so equal rows are one document. The hash is made only where a doc_id repeats.
    """
    own = docs.withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
    shared = staged(own.groupBy("__id").agg(F.count(F.lit(1)).alias("__rows")).filter("__rows > 1").select("__id"), "shared-ids")
    if shared.isEmpty():
        return own.withColumn("__tie", F.lit(0).cast("long")), False
    marked = own.join(shared.withColumn("__shared", F.lit(True)), "__id", "left")
    tie = F.when(F.col("__shared"), F.xxhash64(text_or_empty())).otherwise(F.lit(0)).cast("long")
    return marked.withColumn("__tie", tie).drop("__shared"), True


def each_string(width: int):
    """Every string of the fragments by itself, under two independent hashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                rows = batch.iloc[at:at + 4096]
                sizes = np.array([len(p) for p in rows["bytes"]])
                data = np.frombuffer(b"".join(rows["bytes"]), np.uint8)
                begin = np.cumsum(sizes) - sizes
                count = sizes - width + 1
                string, of = ranges(begin, count), np.repeat(np.arange(len(rows)), count)
                one, two = Hashes(data).spans(string, string + width), Hashes(data[::-1]).spans(len(data) - string - width, len(data) - string)
                yield pd.DataFrame({"gram": one.view(np.int64), "digest": two.view(np.int64), "id": rows["id"].to_numpy()[of], "tie": rows["tie"].to_numpy()[of],
                                    "start": rows["start"].to_numpy()[of] + string - begin[of], "strings": np.ones(len(of), np.int32)})

    return run


def repeated_spans(rows: DataFrame, repeated_ids: bool, width: int = WIDTH) -> DataFrame:
    """Spans (id, tie, start, stop) of ``rows`` (__id, __tie, text) whose every string of ``width`` bytes starts earlier too."""
    spark = rows.sparkSession
    order = ["id", "tie", "start"]
    texts = rows.select(F.col("__id").alias("id"), F.col("__tie").alias("tie"), text_or_empty().alias("text"))
    if repeated_ids:
        texts = texts.dropDuplicates(["id", "tie"])
    pieces = texts.filter(F.octet_length("text") >= width).mapInPandas(cut(width), FRAGMENT)
    sorted_pieces = pieces.repartition(partitions(spark), "gram").sortWithinPartitions("gram", "digest", "strings", *order)
    merged = staged(sorted_pieces.mapInPandas(merge_equal(width), REPEAT + ", sort boolean"), "fragments")
    wanted = merged.filter("sort").groupBy("id", "tie").agg(F.collect_list(F.struct("gram", "start", "stop")).alias("parts"))
    raw = F.col("text").cast("binary")
    sliced = F.transform("parts", lambda p: F.struct(p["gram"].alias("gram"), p["start"].alias("start"), p["stop"].alias("stop"),
                                                     F.substring(raw, p["start"].cast("int") + 1, (p["stop"] - p["start"]).cast("int")).alias("bytes")))
    lined = texts.join(wanted, ["id", "tie"]).select("id", "tie", F.explode(sliced).alias("p")).select(
        "p.gram", "id", "tie", "p.start", "p.stop", "p.bytes")
    spans = merged.filter("not sort").select(*order, "stop")
    common = staged(merged.filter("sort").groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > COMMON).select("gram"), "common-grams")
    if not common.isEmpty():
        # Grams with too many different fragments for one task: their strings are compared one by one, spread by content.
        lined = staged(lined, "fragment-bytes")
        strings = lined.join(common, "gram", "left_semi").mapInPandas(each_string(width), FRAGMENT)
        spread = strings.repartition(partitions(spark), "gram", "digest").sortWithinPartitions("gram", "digest", "strings", *order)
        spans = spans.unionByName(spread.mapInPandas(merge_equal(width), REPEAT + ", sort boolean").filter("not sort").select(*order, "stop"))
        lined = lined.join(common, "gram", "left_anti")
    by_gram = lined.repartition(partitions(spark), "gram").sortWithinPartitions("gram", *order)
    return spans.unionByName(by_gram.mapInPandas(sort_groups(width), REPEAT).select(*order, "stop"))


def joined_spans(spans: list) -> list[tuple[int, int]]:
    """Maximal removed runs of one document."""
    runs: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if runs and start <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(stop, runs[-1][1]))
        else:
            runs.append((start, stop))
    return runs


def with_spans(docs: DataFrame, width: int) -> DataFrame:
    """``docs`` with column ``__spans``: the removed spans of each row as arrays [start, stop]."""
    rows, repeated_ids = identified(docs)
    found = repeated_spans(rows, repeated_ids, width).groupBy("id", "tie").agg(F.collect_list(F.array("start", "stop")).alias("__spans"))
    found = found.select(F.col("id").alias("__id"), F.col("tie").alias("__tie"), "__spans")
    return rows.join(found, ["__id", "__tie"], "left")


OUTCOME = StructType([StructField("n_removed", LongType()), StructField("n_spans", LongType()), StructField("kept_sha256", StringType())])


def outcome(text: Column, spans: Column) -> Column:
    @F.pandas_udf(OUTCOME)
    def digest(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, lists in batches:
            rows = []
            for text, found in zip(texts, lists):
                raw = text.encode("utf-8", "surrogatepass")
                runs = joined_spans([tuple(s) for s in found]) if found is not None and len(found) else []
                kept = hashlib.sha256()
                at = 0
                for start, stop in runs:
                    kept.update(raw[at:start])
                    at = stop
                kept.update(raw[at:])
                rows.append((sum(b - a for a, b in runs), len(runs), kept.hexdigest()))
            yield pd.DataFrame(rows, columns=OUTCOME.names)

    return digest(text, spans)


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of ``docs`` (doc_id, text).

    A byte goes if a string of ``width`` bytes over it also starts earlier: in a document with a
    smaller doc_id, or earlier in its own. Null and empty texts, and texts shorter than ``width``,
    lose nothing. A null doc_id comes after all others; rows that repeat doc_id and text are one
    document, each returned; rows that share only doc_id are ordered by a hash of their text.
    Other columns are ignored; an empty table gives an empty result.
    """
    rows = with_spans(docs.select("doc_id", "text"), width)
    text = text_or_empty()
    done = rows.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), outcome(text, F.col("__spans")).alias("o"))
    return done.select("doc_id", "n_bytes", "o.n_removed", "o.n_spans", "o.kept_sha256")


def without_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with repeated strings cut out of ``text``; all columns are returned and n_chars, if present, follows.

    A character goes only if all its bytes do. A text that loses everything stays as an empty one.
    """

    @F.pandas_udf(StringType())
    def kept(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, lists in batches:
            yield pd.Series([t if t is None or f is None or not len(f) else cut_text(t, joined_spans([tuple(s) for s in f]))
                             for t, f in zip(texts, lists)], dtype=object)

    own = docs.columns
    done = with_spans(docs, width).withColumn("text", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(kept("text", "__spans")))
    if "n_chars" in own:
        done = done.withColumn("n_chars", F.when(F.col("__spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return done.select(*[F.col(f"`{c}`") for c in own])


def cut_text(text: str, runs: list[tuple[int, int]]) -> str:
    """``text`` without the byte runs, each shrunk to whole characters."""
    raw = text.encode("utf-8", "surrogatepass")
    out, at = [], 0
    for start, stop in runs:
        while start < stop and raw[start] & 0xC0 == 0x80:
            start += 1
        while stop > start and stop < len(raw) and raw[stop] & 0xC0 == 0x80:
            stop -= 1
        out.append(raw[at:start])
        at = max(at, stop)
    out.append(raw[at:])
    return b"".join(out).decode("utf-8", "surrogatepass")

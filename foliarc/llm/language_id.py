"""Language identification: known words first, then ever shorter character n-grams.

A word that training texts hold at least twice scores by its log frequency in each language. Any other
word scores by its n-grams: of the longest length at which some of them are known, the mean of their log
frequencies. The tables grow with the corpus. What fits a checked number of bytes is broadcast, most
frequent units first; words beyond it are looked up by joins on distinct words. Log frequencies are
whole numbers of 2^-20, so sums are exact and both ways give the same answers.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliarc.llm.collocations import few, found
from foliarc.llm.common import release_memory, staged, text_or_empty

WORD = re.compile(r"[^\W\d_]+")
LONGEST = 5  # characters of an n-gram; words carry a blank at both ends
KNOWN = 2  # training occurrences that make a unit known
UNIT = 1 << 20
TABLE_BYTES = 32 * 1024 * 1024
SLICES = 8  # in which a table comes to the driver
HELD_UNITS = 300_000
CHARS_AT_ONCE = 1 << 20
UNKNOWN = "und"


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def grams_of(word: str, length: int) -> list[str]:
    """The n-grams of a word with a blank at both ends; single characters without the blanks."""
    spaced = f" {word} " if length > 1 else word
    return [spaced[i:i + length] for i in range(len(spaced) - length + 1)]


def held_out(identifier: str = "doc_id") -> Column:
    """Whether a row is kept out of training: crc32 of its id as text, modulo 4, is 2. A null id counts as empty text."""
    name = F.coalesce(F.col(identifier).cast("string"), F.lit(""))
    return F.crc32(name.cast("binary")) % 4 == 2


def counted(rows: DataFrame, units, schema: str) -> DataFrame:
    """(lang, k, unit, n): sums of what ``units`` lists for each row, combined inside tasks of bounded memory first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[str, int], Counter] = {}

        def out() -> Iterator[pd.DataFrame]:
            for (lang, k), seen in held.items():
                if seen:
                    yield pd.DataFrame({"lang": lang, "k": k, "unit": list(seen), "n": list(seen.values())})
            held.clear()

        for batch in batches:
            for row in batch.itertuples(index=False):
                for k, some, times in units(row):
                    seen = held.setdefault((row.lang, k), Counter())
                    if times == 1:
                        seen.update(some)
                    else:
                        for unit in some:
                            seen[unit] += times
                if sum(map(len, held.values())) > HELD_UNITS:
                    yield from out()
        yield from out()
        release_memory()

    return rows.mapInPandas(run, schema).groupBy("lang", "k", "unit").agg(F.sum("n").alias("n"))


COUNTS = "lang string, k int, unit string, n long"


class Model:
    """Languages, their shares of the training texts, and the tables of words (k = 0) and n-grams."""

    def __init__(self, training: DataFrame):
        """``training`` has text and lang, neither null."""
        shares = training.groupBy("lang").count().orderBy("lang").collect()  # a row for each language
        self.langs = [r["lang"] for r in shares]
        docs = np.array([r["count"] for r in shares], np.float64)
        self.prior = np.round(UNIT * np.log(docs / docs.sum())).astype(np.int64) if len(docs) else np.zeros(0, np.int64)
        words = staged(counted(training.select("text", "lang"), lambda r: [(0, words_of(r.text), 1)], COUNTS), "words")
        every = range(1, LONGEST + 1)
        grams = staged(counted(words, lambda r: [(k, grams_of(r.unit, k), r.n) for k in every], COUNTS), "grams")
        self.words, self.grams = self.scored(words, "words-scored"), self.scored(grams, "grams-scored")

    def scored(self, counts: DataFrame, label: str) -> DataFrame:
        """(unit, key, total, vector) of the known units; logs are smoothed by half a count."""
        langs = self.langs
        place = {lang: i for i, lang in enumerate(langs)}
        sums = np.zeros((LONGEST + 1, len(langs)))
        kinds = np.zeros(LONGEST + 1)
        for r in counts.groupBy("k", "lang").agg(F.sum("n").alias("n")).collect():  # lengths times languages
            sums[r["k"], place[r["lang"]]] = r["n"]
        by_unit = counts.groupBy("k", "unit").agg(F.sum("n").alias("total"), F.collect_list(F.struct("lang", "n")).alias("each"))
        by_unit = by_unit.filter(F.col("total") >= KNOWN)
        for r in by_unit.groupBy("k").count().collect():
            kinds[r["k"]] = r["count"]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                n = np.zeros((len(batch), len(langs)))
                for row, each in enumerate(batch["each"]):
                    for one in each:
                        n[row, place[one["lang"]]] = one["n"]
                k = batch["k"].to_numpy()
                logs = np.round(UNIT * np.log((n + 0.5) / (sums[k] + 0.5 * kinds[k][:, None] + 0.5))).astype(np.int32)
                yield pd.DataFrame({"unit": batch["unit"], "key": keys_of(batch["unit"]), "total": batch["total"], "vector": list(logs)})

        return staged(by_unit.mapInPandas(run, "unit string, key long, total long, vector array<int>"), label)

    def fitting(self, table: DataFrame) -> tuple[tuple[np.ndarray, np.ndarray], DataFrame | None]:
        """The most frequent units that fit ``TABLE_BYTES``, as sorted keys with vectors, and the rest (None if all fit)."""
        most = TABLE_BYTES // (8 + 4 * max(1, len(self.langs)))
        rest, top = None, table
        if table.count() > most:
            order = [F.desc("total"), F.asc("unit")]
            top = staged(table.orderBy(*order).limit(most), "frequent-units")
            edge = top.orderBy(F.asc("total"), F.desc("unit")).first()
            total, unit = (edge["total"], edge["unit"]) if edge else (1 << 62, "")
            rest = table.filter((F.col("total") < total) | ((F.col("total") == total) & (F.col("unit") > F.lit(unit))))
        columns, keys, vectors = [f"v{i}" for i in range(len(self.langs))], [], []
        packed = top.select("key", *[F.col("vector")[i].alias(c) for i, c in enumerate(columns)])
        for part in range(SLICES):
            some = packed.filter(F.pmod("key", F.lit(SLICES)) == part).toArrow()
            keys.append(some["key"].to_numpy())
            vectors.append(np.stack([some[c].to_numpy() for c in columns], axis=1) if columns else np.zeros((len(some), 0), np.int32))
        key, vector = np.concatenate(keys).astype(np.int64), np.concatenate(vectors).astype(np.int32)
        order = np.argsort(key, kind="stable")
        return (key[order], vector[order]), rest


def keys_of(units) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, [u.encode("utf-8", "surrogatepass") for u in units]), np.uint64, len(units)).view(np.int64)


def backed_off(words: list[str], grams: tuple[np.ndarray, np.ndarray], langs: int) -> np.ndarray:
    """Vectors of unseen words: the mean over the known n-grams of the longest length that has any."""
    names, logs = grams
    out = np.zeros((len(words), langs), np.int64)
    left = list(range(len(words)))
    for length in range(LONGEST, 0, -1):
        if not left or not len(names):
            break
        own = [grams_of(words[i], length) for i in left]
        owner = np.repeat(np.arange(len(left)), [len(g) for g in own])
        at, hit = found(keys_of([g for some in own for g in some]), names)
        many = np.bincount(owner[hit], minlength=len(left))
        sums = np.zeros((len(left), langs), np.int64)
        np.add.at(sums, owner[hit], logs[at[hit]])
        done = many > 0
        out[np.array(left)[done]] = sums[done] // many[done][:, None]
        left = [i for i, d in zip(left, done) if not d]
    return out


def answers(sums: np.ndarray, letters: np.ndarray, prior: np.ndarray, langs: list[str]) -> tuple[list[str], np.ndarray]:
    """Most probable language and its probability; ties go to the first name."""
    if not langs:
        return [UNKNOWN] * len(sums), np.zeros(len(sums))
    logs = (sums + prior) / UNIT
    best = (sums + prior).argmax(axis=1)
    share = 1 / np.exp(logs - logs[np.arange(len(logs)), best][:, None]).sum(axis=1)
    return [langs[b] if ok else UNKNOWN for b, ok in zip(best, letters)], np.where(letters, share, 0.0)


def scoring(words, grams, model_langs: list[str], prior: np.ndarray, apart: bool):
    """Answers, or with ``apart`` the sums so far and the words that the table of words lacks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, logs = words.value
        langs = len(model_langs)
        for batch in batches:
            for part in few([len(t) for t in batch["text"]], CHARS_AT_ONCE):
                some = batch.iloc[part]
                tokens = [words_of(t) for t in some["text"]]
                code: dict[str, int] = {}
                for own in tokens:
                    for word in own:
                        code.setdefault(word, len(code))
                unique = list(code)
                at, hit = found(keys_of(unique), names)
                vectors = np.zeros((len(unique), langs), np.int64)
                vectors[hit] = logs[at[hit]]
                unseen = np.flatnonzero(~hit)
                if not apart:
                    vectors[unseen] = backed_off([unique[i] for i in unseen], grams.value, langs)
                codes = np.fromiter((code[w] for own in tokens for w in own), np.int64)
                sizes = np.array([len(own) for own in tokens])
                sums = np.zeros((len(tokens), langs), np.int64)
                full = np.flatnonzero(sizes)
                if len(full):
                    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])[full]
                    for i in range(langs):
                        sums[full, i] = np.add.reduceat(vectors[:, i][codes], starts)
                letters = np.array([any(c.isalpha() for w in own for c in w) for own in tokens], bool)
                made = some.drop(columns="text")
                if apart:
                    lacking = [Counter(w for w in own if not hit[code[w]]) for own in tokens]
                    yield made.assign(letters=letters, sums=list(sums), lacking=[[{"word": w, "n": n} for w, n in c.items()] for c in lacking])
                else:
                    best, share = answers(sums, letters, prior, model_langs)
                    yield made.assign(lang_pred=best, score=share)
        release_memory()

    return run


def looked_up(lacking: DataFrame, rest: DataFrame, grams: DataFrame, langs: int) -> DataFrame:
    """(word, vector) of distinct words: from the rest of the words, else by n-grams, both by joins."""
    met = staged(lacking.select("word").distinct().join(rest.select(F.col("unit").alias("word"), "vector"), "word", "left"), "met")
    known = met.filter(F.col("vector").isNotNull()).select("word", F.col("vector").cast("array<long>").alias("vector"))

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                rows = [(w, k, g, n) for w in batch["word"].iloc[at:at + 4096] for k in range(1, LONGEST + 1) for g, n in Counter(grams_of(w, k)).items()]
                yield pd.DataFrame(rows, columns=["word", "k", "unit", "n"])

    own = met.filter(F.col("vector").isNull()).select("word").mapInPandas(listed, "word string, k int, unit string, n long").join(grams, "unit")
    sums = own.groupBy("word", "k").agg(F.sum("n").alias("many"), F.array(*[F.sum(F.col("n") * F.col("vector")[i]) for i in range(langs)]).alias("sums"))
    best = sums.groupBy("word").agg(F.max_by(F.struct("many", "sums"), "k").alias("b"))
    down = F.transform("b.sums", lambda s: F.floor(s.cast("decimal(20,0)") / F.col("b.many").cast("decimal(20,0)")).cast("long"))
    return known.unionByName(best.select("word", down.alias("vector")))


def predict(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of ``docs`` (doc_id, text, lang).

    Training uses text and lang of rows that are not held out and have both; prediction uses the text
    alone. ``und`` with score 0 stands for a null text, one without a letter, and for every text if
    there is nothing to learn from. A word in no table at any length says nothing; a text of such words
    gets the commonest language. Repeated rows train and are answered each; a null doc_id counts as
    empty text; other columns are ignored; an empty table gives no rows. Languages go through the
    driver as a list; words, n-grams and texts of any number and length do not.
    """
    context = docs.sparkSession.sparkContext
    rows = docs.select("doc_id", held_out().alias("held_out"), text_or_empty().alias("text"), F.col("lang").cast("string").alias("lang"))
    model = Model(docs.filter(~held_out() & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", F.col("lang").cast("string").alias("lang")))
    langs, prior = model.langs, model.prior
    words, rest = model.fitting(model.words)
    grams, more = model.fitting(model.grams)
    words, grams = context.broadcast(words), context.broadcast(grams)
    texts = rows.select("doc_id", "held_out", "text")
    kind = dict(docs.dtypes)["doc_id"]
    if rest is None and more is None:
        return texts.mapInPandas(scoring(words, grams, langs, prior, False), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
    empty = model.words.limit(0) if rest is None else rest
    fields = f"__row long, doc_id {kind}, held_out boolean, letters boolean, sums array<long>, lacking array<struct<word: string, n: long>>"
    begun = texts.withColumn("__row", F.monotonically_increasing_id()).select("__row", "doc_id", "held_out", "text")
    begun = staged(begun.mapInPandas(scoring(words, grams, langs, prior, True), fields), "begun")
    lacking = begun.select("__row", F.explode("lacking").alias("w")).select("__row", "w.word", "w.n")
    vectors = looked_up(lacking, empty, model.grams, len(langs))
    added = lacking.join(vectors, "word").groupBy("__row").agg(F.array(*[F.sum(F.col("n") * F.col("vector")[i]) for i in range(len(langs))]).alias("added"))
    both = begun.join(added, "__row", "left")
    sums = F.when(F.col("added").isNull(), F.col("sums")).otherwise(F.zip_with("sums", "added", lambda a, b: a + b))

    @F.pandas_udf("lang_pred string, score double")
    def answered(totals: pd.Series, letters: pd.Series) -> pd.DataFrame:
        best, share = answers(np.stack(totals.to_numpy()) if len(totals) else np.zeros((0, len(langs)), np.int64), letters.to_numpy(), prior, langs)
        return pd.DataFrame({"lang_pred": best, "score": share})

    return both.select("doc_id", "held_out", answered(sums, "letters").alias("a")).select("doc_id", "held_out", "a.lang_pred", "a.score")

"""Operators 11 to 13 against brute force, held-out accuracy and the awkward rows."""

import math
import os
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliarc.llm import collocations, language_id, whitening
from tests.llm.frames import documents, rows


def vectors(spark, data):
    return spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")


def test_whitening_matches_numpy(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 16)
    monkeypatch.setattr(whitening, "SLAB_BLOCKS", 4)
    draw = np.random.default_rng(3)
    data = (draw.normal(size=(200, 12)) * np.linspace(0.2, 2, 12) + 0.3).astype(np.float32)
    nan = [float("nan")] + [0.0] * 11
    extra = [(900, None, 1), (901, nan, 1), (902, [None] + [0.0] * 11, 1), (903, [float("inf")] * 12, 1), (904, [1.0], 1)]
    frame = vectors(spark, [(i, v.tolist(), 0) for i, v in enumerate(data)] + extra)
    x = np.floor(1024 * data.astype(np.float64)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    covariance = np.cov(x.T.astype(np.float64), bias=True)
    values, axes = np.linalg.eigh(covariance)
    got = whitening.whiten(frame).collect()
    assert len(got) == 200 * 8 and {r.vec_id for r in got} == set(range(200))
    whole = {i: sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[i], sums)) for i in range(200)}
    for c in range(1, 9):
        mine = np.array([r.whitened for r in sorted(got, key=lambda r: r.vec_id) if r.component == c])
        want = (x - sums / n) @ axes[:, -c] / math.sqrt(values[-c])
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-8
    for r in got:
        assert r.deviation == whole[r.vec_id] and r.n == 200 and r.identity_error < 1e-8
        assert abs(r.explained - values[-r.component] / values.sum()) < 1e-12


def test_whitening_of_awkward_tables(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None, 0), (2, [], 0)])).count() == 0
    same = whitening.whiten(vectors(spark, [(None, [1.0, 2.0], 0), (5, [1.0, 2.0], 0), (5, [1.0, 2.0], 0)])).collect()
    assert len(same) == 6 and all(r.whitened is None and r.explained is None and r.deviation == 0 and r.identity_error == 0 for r in same)
    line = whitening.whiten(vectors(spark, [(i, [float(i), float(i)], 0) for i in range(4)])).collect()
    assert [(r.component, r.whitened is None) for r in line if r.vec_id == 3] == [(1, False), (2, True)]
    large = whitening.whiten(vectors(spark, [(1, [1e14, 0.0], 0), (2, [-1e14, 0.0], 0), (3, [1e38, 0.0], 0)])).collect()
    assert {r.vec_id for r in large} == {1, 2} and all(r.deviation is None for r in large)


def brute_phrases(docs, least, most):
    total, counts = Counter(), Counter()
    for lang, text in docs:
        lang = lang if lang is not None else "und"
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, 5):
                counts.update((lang, tuple(words[i:i + k])) for i in range(len(words) - k + 1))
    found = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= least}
    out = {}
    for (lang, words), a in found.items():
        cuts = [(2_000_000 * a // (counts[lang, words[:k]] + counts[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        longer = [b for (other, w), b in found.items() if other == lang and len(w) > len(words)
                  and any(w[i:i + len(words)] == words for i in range(len(w)))]
        if not any(100 * b >= 80 * a for b in longer):
            out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), counts[lang, words[:k]], counts[lang, words[k:]]))
    return sorted((lang, rank, p.decode(), -a, left, right, total[lang], -score) for lang, found in out.items()
                  for rank, (score, a, p, left, right) in enumerate(sorted(found)[:most], 1))


@pytest.mark.parametrize("seed,rows_at_once", [(1, 1 << 22), (2, 7)])
def test_collocations_match_brute_force(spark, monkeypatch, seed, rows_at_once):
    monkeypatch.setattr(collocations, "SLICE", rows_at_once)
    draw = random.Random(seed)
    words = ["the", "New", "york", "éa", "of", "x"] + [f"w{i}" for i in range(20)]
    text = lambda: "".join(draw.choice(words if draw.random() < 0.5 else words[:5]) + draw.choice([" ", " ", " ", "\t", ". ", ",", "\n", "  "]) for _ in range(60))
    docs = [(draw.choice(["en", "de", None]), text()) for _ in range(60)] + [("en", "the the the the the " * 30), ("fr", None), ("fr", "")]
    frame = documents(spark, [(i, t, lang, "a", 0) for i, (lang, t) in enumerate(docs)])
    got = collocations.collocations(frame, most=25, least=5)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute_phrases(docs, 5, 25)


def test_collocations_of_awkward_rows(spark):
    docs = documents(spark)
    got = collocations.collocations(docs).collect()
    assert sorted(tuple(r) for r in got) == brute_phrases([(r.lang, r.text) for r in docs.collect()], 30, 2000)
    assert collocations.collocations(docs.limit(0)).count() == 0


@pytest.mark.parametrize("many", [0, 7, 20])
def test_tables_reach_the_tasks_one_slice_at_a_time(spark, monkeypatch, many):
    """Without the Arrow setting toPandas makes a Python row of every id on the driver."""
    monkeypatch.setattr(collocations, "SLICE", 7)
    monkeypatch.setattr(collocations, "FETCH", 3)
    frame = spark.range(many).select(((F.col("id") * 13) % 20).alias("key"), "id")
    monkeypatch.setattr(type(frame), "toPandas", lambda self: pytest.fail("rows of Python objects"))
    seen, edges, before = [], [], None
    for shared, first, last in collocations.slices(frame, ["key"], many):
        assert before is None or not os.path.exists(before._path)
        key, ids = shared.value
        assert len(key) <= 7 and list(key) == sorted(key)
        seen += zip(ids.tolist(), key.tolist())
        edges.append((first, last))
        before = shared
    assert not os.path.exists(before._path)
    assert sorted(seen) == [(i, i * 13 % 20) for i in range(many)]
    assert edges == [(at == 0, at == max(-(-many // 7), 1) - 1) for at in range(max(-(-many // 7), 1))]


def test_tiles_count_as_a_counter_does(monkeypatch):
    monkeypatch.setattr(collocations, "DENSE_FROM", 40)
    monkeypatch.setattr(collocations, "DENSE_TILES", 2)
    draw = np.random.default_rng(5)
    tiles, want, got = collocations.Tiles(), Counter(), Counter()
    for _ in range(12):
        left, right = (np.minimum(draw.zipf(1.3, 400), (1 << 31) - 1).astype(np.int64) for _ in "lr")
        want.update(zip(left.tolist(), right.tolist()))
        tiles.add(collocations.packed(left, right))
        for frame in tiles.settle(150):
            got.update(Counter(dict(zip(zip(frame.p, frame.s), frame.n))))
    for frame in tiles.rest():
        got.update(Counter(dict(zip(zip(frame.p, frame.s), frame.n))))
    assert tiles.dense and got == want


def brute_languages(docs):
    """(lang, score) of every text, in exact arithmetic up to the rounded logs."""
    words_of = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    grams = lambda w, k: [w] if k == 0 else [(f" {w} " if k > 1 else w)[i:i + k] for i in range(len(w) + (2 if k > 1 else 0) - k + 1)]
    out = [zlib.crc32(b"" if i is None else str(i).encode()) % 4 == 2 for i, _, _ in docs]
    train = [(t, lang) for (_, t, lang), held in zip(docs, out) if not held and t is not None and lang is not None]
    langs = sorted({lang for _, lang in train})
    counts = {lang: Counter((k, g) for t, other in train if other == lang for w in words_of(t) for k in range(6) for g in grams(w, k)) for lang in langs}
    whole = sum(counts.values(), Counter())
    known = {unit for unit, n in whole.items() if n >= 2}
    kinds = Counter(k for k, _ in known)
    sums = {(lang, k): sum(n for (kk, _), n in counts[lang].items() if kk == k) for lang in langs for k in range(6)}
    log = lambda lang, unit: round(2 ** 20 * math.log((counts[lang][unit] + 0.5) / (sums[lang, unit[0]] + 0.5 * kinds[unit[0]] + 0.5)))
    answers = []
    for (_, text, _), held in zip(docs, out):
        words = words_of(text or "")
        if not langs or not any(c.isalpha() for w in words for c in w):
            answers.append((held, "und", 0.0))
            continue
        score = {lang: round(2 ** 20 * math.log(sum(other == lang for _, other in train) / len(train))) for lang in langs}
        for w in words:
            for k in [0, 5, 4, 3, 2, 1]:
                own = [(k, g) for g in grams(w, k) if (k, g) in known]
                if own:
                    for lang in langs:
                        score[lang] += math.floor(Fraction(sum(log(lang, u) for u in own), len(own)))
                    break
        best = max(langs, key=lambda lang: score[lang])
        answers.append((held, best, 1 / sum(math.exp((score[lang] - score[best]) / 2 ** 20) for lang in langs)))
    return answers


@pytest.mark.parametrize("table_bytes", [1 << 26, 600])
def test_languages_match_brute_force(spark, monkeypatch, table_bytes):
    monkeypatch.setattr(language_id, "TABLE_BYTES", table_bytes)
    draw = random.Random(4)
    stems = {"en": ["the", "and", "ing", "ed", "th"], "de": ["der", "und", "sch", "en", "ü"], "ru": ["не", "что", "ов", "ть"], None: ["the", "der"]}
    word = lambda lang: "".join(draw.choice(stems[lang]) for _ in range(draw.randint(1, 3)))
    docs = [(i, " ".join(word(lang) for _ in range(draw.randint(1, 12))), lang) for i, lang in enumerate(draw.choices(list(stems), k=80))]
    docs += [(100, None, "en"), (101, "", "de"), (102, "123 ²²", "en"), (103, "日本", None), (103, "日本", None), (None, "the und", "en"), (2, "qqq" * 5000, None)]
    frame = documents(spark, [(i, t, lang, "a", 0) for i, t, lang in docs])
    got = rows(language_id.predict(frame), "doc_id", "held_out", "lang_pred", "score")
    want = sorted([(i, *a) for (i, _, _), a in zip(docs, brute_languages(docs))], key=lambda r: tuple((v is None, str(v)) for v in r))
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], atol=1e-9)


def test_languages_of_awkward_rows(spark):
    docs = documents(spark)
    assert language_id.predict(docs).count() == docs.count() and language_id.predict(docs.limit(0)).count() == 0
    unlabelled = documents(spark, [(1, "some text", None, "a", 9)])
    assert [tuple(r) for r in language_id.predict(unlabelled).collect()] == [(1, False, "und", 0.0)]


def test_held_out_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = language_id.predict(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").filter("held_out and lang is not null and text is not null").collect()
    right = [r.lang == r.lang_pred for r in found if r.lang_pred != "und"]
    assert len(right) > 20 and sum(right) / len(right) > 0.95

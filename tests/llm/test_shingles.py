"""The near-duplicate stage against the Jaccard similarity of all pairs."""

import random
import re

import pytest

import corpus_pipeline
from foliarc.llm import shingles
from tests.llm.frames import documents


def brute_set(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def brute_kept(docs):
    """Ids that stay: the smallest of each component of texts with similarity 0.8."""
    docs = sorted(docs)
    sets = [brute_set(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if similarity(sets[i], sets[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [docs[i][0] for i in range(len(docs)) if find(i) == i]


def near_copies(seed, n=40):
    """Texts with copies on both sides of 0.8, chains of copies, shared lines, and texts of few words."""
    draw = random.Random(seed)
    text = lambda k: [f"w{draw.randint(0, 4000)}" for _ in range(k)]
    lines = [text(40) for _ in range(3)]
    out = []
    for _ in range(n):
        words = text(draw.choice([3, 5, 6, 30, 120, 300])) + (draw.choice(lines) if draw.random() < 0.5 else [])
        out.append(" ".join(words))
        for _ in range(draw.choice([0, 1, 3, 12])):
            copy = list(words)
            for _ in range(draw.randint(0, max(1, len(words) // 30))):
                copy[draw.randrange(len(copy))] = f"new{draw.randint(0, 9)}"
            out.append(" ".join(copy))
            words = copy if draw.random() < 0.3 else words
    draw.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("seed,frequent,pairs", [(1, 3, 1 << 21), (2, 3, 50), (3, 1 << 30, 1 << 21)])
def test_stage_keeps_what_all_pairs_keep(spark, monkeypatch, seed, frequent, pairs):
    monkeypatch.setattr(shingles, "FREQUENT", frequent)
    monkeypatch.setattr(shingles, "PAIRS_AT_ONCE", pairs)
    docs = near_copies(seed)
    sets = [brute_set(t) for _, t in docs]
    scores = [similarity(a, b) for i, a in enumerate(sets) for b in sets[:i]]
    assert all(sum(low <= s < low + 0.05 for s in scores) > 5 for low in (0.75, 0.80, 0.85, 0.90))
    frame = documents(spark, [(i, t, "en", "a", len(t)) for i, t in docs])
    kept = corpus_pipeline.near_duplicates(spark, frame, "")
    assert kept.columns == frame.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [docs[i] for i in brute_kept(docs)]


def test_awkward_rows(spark):
    docs = documents(spark)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "4", "5", "None", "None"]
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0
    large = documents(spark, [(2 ** 60 + 1, "a b c d e f", "en", "a", 11), (2 ** 60, "g h i j k l", "en", "a", 11), (None, "m n", "en", "a", 3)])
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, large, "").collect()} == {2 ** 60, 2 ** 60 + 1, None}


def test_first_shingles_of_similar_sets_meet():
    import numpy as np

    draw = np.random.default_rng(1)
    for _ in range(300):
        pool = np.unique(draw.integers(0, 1 << 62, draw.integers(2, 80)).astype(np.uint64))
        a, b = (np.sort(draw.permutation(pool)[:max(1, int(len(pool) * draw.uniform(0.8, 1)))]) for _ in "ab")
        levels = draw.integers(0, 4, 1 << shingles.CELL_BITS).astype(np.uint8)
        if similarity(set(a.tolist()), set(b.tolist())) >= 0.8:
            assert np.intersect1d(shingles.head(a, levels, 0.8), shingles.head(b, levels, 0.8)).size


def test_sketches_rule_out_no_similar_pair():
    import numpy as np

    draw = np.random.default_rng(2)
    for _ in range(300):
        pool = draw.integers(0, 1 << 62, draw.integers(2, 600)).astype(np.uint64)
        a, b = (np.unique(draw.permutation(pool)[:max(1, int(len(pool) * draw.uniform(0.5, 1)))]) for _ in "ab")
        differ = int(np.bitwise_count((shingles.sketch(a) ^ shingles.sketch(b)).view(np.uint64)).sum())
        assert differ <= len(np.setxor1d(a, b))


def met_rows(sets):
    """Rows of sets that all share shingle 7, as ``crossing`` reads them."""
    import numpy as np
    import pandas as pd

    words = np.stack([shingles.sketch(s) for s in sets])
    rows = pd.DataFrame({"token": 7, "a": np.arange(len(sets)), "n": [len(s) for s in sets], "at": 0, "root": np.arange(len(sets))})
    return rows.assign(**{f"s{k}": words[:, k] for k in range(shingles.SKETCH_WORDS)}).sort_values(["n", "a"])


def test_texts_with_one_common_shingle_make_no_pairs():
    import numpy as np

    draw = np.random.default_rng(3)
    rows = met_rows([np.unique(np.append(draw.integers(0, 1 << 62, 200), 7).astype(np.uint64)) for _ in range(300)])
    assert not sum(len(f) for f in shingles.crossing(0.8, False)(iter([rows])))


def test_nearest_pairs_of_a_large_group_grow_with_its_rows():
    import numpy as np

    draw = np.random.default_rng(4)
    base = draw.integers(0, 1 << 62, 200).astype(np.uint64)
    rows = met_rows([np.unique(np.append(base[:195], draw.integers(0, 1 << 62, 5).astype(np.uint64))) for _ in range(300)])
    assert 0 < sum(len(f) for f in shingles.crossing(0.8, True)(iter([rows]))) < 300


def test_fingerprints_meet_in_the_trees(spark, monkeypatch):
    seen = []
    real = shingles.grouped_prints
    monkeypatch.setattr(shingles, "grouped_prints", lambda prints: seen.append(1) or real(prints))
    docs = documents(spark, [(1, " ".join(f"w{i}" for i in range(300)), "en", "a", 3), (2, " ".join(f"w{i}" for i in range(299)), "en", "a", 3)])
    assert [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()] == [1] and seen

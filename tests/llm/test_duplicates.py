"""SimHash components, suffix arrays and suffix dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from foliarc.llm import simhash, suffix_dedup
from foliarc.llm.suffix_array import suffix_arrays
from tests.llm.frames import LONG, documents, rows


def brute_print(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(prints):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4 and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(prints))]


def near_prints(seed, n, centres, flips):
    draw = random.Random(seed)
    base = [draw.getrandbits(64) for _ in range(centres)]
    out = []
    for _ in range(n):
        value = draw.choice(base)
        for _ in range(draw.randint(0, flips)):
            value ^= 1 << draw.randrange(64)
        out.append(value)
    return sorted(set(out))


@pytest.mark.parametrize("seed,n,centres,flips", [(1, 700, 40, 6), (2, 900, 3, 8), (3, 600, 600, 0), (4, 500, 1, 4)])
def test_trees_miss_no_link(spark, seed, n, centres, flips):
    prints = near_prints(seed, n, centres, flips)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = dict(map(tuple, simhash.grouped_prints(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()))
    want = brute_components(prints)
    parts = {}
    for p, w in zip(signed, want):
        parts.setdefault(w, set()).add(p)
    assert all({got[p] for p in part} == {min(part)} for part in parts.values())


@pytest.mark.parametrize("pairs", [1, 1 << 21])
def test_leaf_links(monkeypatch, pairs):
    monkeypatch.setattr(simhash, "PAIRS_AT_ONCE", pairs * 64)
    for seed in range(6):
        prints = near_prints(seed, 300, [1, 5, 100][seed % 3], 7)
        labels = simhash.link(np.array(prints, np.uint64), np.ones(len(prints), bool))
        assert labels.tolist() == brute_components(prints)


def test_fingerprints_and_components(spark):
    assert [simhash.fingerprint(t) % (1 << 64) for t in ("", " \t", "One two", "A b C d e f é", LONG)] == [brute_print(t) for t in ("", " \t", "One two", "A b C d e f é", LONG)]
    docs = documents(spark)
    found = {}
    for r in simhash.near_duplicates(docs).collect():
        found.setdefault(r.doc_id, []).append((r.fingerprint, r.component_id))
    assert found[2] == found[3] == found[8] == [("0" * 16, 2)]
    assert found[1] == found[7] and found[7][0][1] == 1 and len(found[5]) == 2 and len(found[None]) == 2
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long")
    assert {tuple(r) for r in simhash.components(edges).collect()} == {(i, 0) for i in range(1, 301)} | {(1001, 1000)}
    assert simhash.components(edges.limit(0)).count() == 0


def test_suffix_arrays_are_sorted():
    draw = random.Random(1)
    for trial in range(150):
        strings = [[draw.randint(1, draw.choice([1, 2, 3, 200])) for _ in range(draw.randint(0, 60))] + [0] for _ in range(draw.randint(1, 6))]
        strings += [[1, 2] * 30 + [0], [5] * 40 + [0], list(range(1, 40)) + [0]] if trial % 5 == 0 else []
        got = suffix_arrays(np.array(sum(strings, [])), np.array([len(s) for s in strings]))
        want, at = [], 0
        for s in strings:
            want += [at + i for i in sorted(range(len(s)), key=lambda i: s[i:])]
            at += len(s)
        assert got.tolist() == want


def brute_removal(docs, width):
    """(n_bytes, n_removed, n_spans, digest) by doc_id for unique ids."""
    seen, out = set(), {}
    for doc_id, text in sorted(docs):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for a in range(len(raw) - width + 1):
            string = raw[a:a + width]
            if string in seen:
                gone[a:a + width] = b"\1" * width
            seen.add(string)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out[doc_id] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def passages(seed, n=150):
    """Texts of few words with shared passages, near copies and self-repeats."""
    draw = random.Random(seed)
    words = ["alpha", "bé", "gamma,", "d", "epsilon", "zéta", "eta", "日本"]
    text = lambda k: " ".join(draw.choice(words) + str(draw.randint(0, 99)) for _ in range(k))
    shared = [text(40) for _ in range(3)]
    docs = []
    for i in range(n):
        body = text(draw.randint(0, 60))
        if draw.random() < 0.5:
            body += draw.choice(shared)[draw.randint(0, 20):] + text(draw.randint(0, 8))
        if docs and draw.random() < 0.3:
            old = list(docs[draw.randrange(len(docs))][1])
            if old:
                old[draw.randrange(len(old))] = "#"
            body = "".join(old)
        docs.append((i, body * draw.choice([1, 1, 1, 2])))
    return docs


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("common", [20_000, 5])
def test_removal_equals_brute_force(spark, monkeypatch, seed, common):
    monkeypatch.setattr(suffix_dedup, "COMMON", common)
    docs = passages(seed)
    frame = documents(spark, [(i, t, "en", "a", 1) for i, t in docs])
    want = brute_removal(docs, 100)
    for r in suffix_dedup.remove_repeats(frame).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id]


def thirds(frame):
    """The rows in batches of uneven sizes."""
    edge = [0, len(frame) // 3, len(frame) // 3 + 1, 2 * len(frame) // 3, len(frame)]
    return (frame.iloc[a:b] for a, b in zip(edge, edge[1:]))


@pytest.mark.parametrize("limit,piece", [(300, 1 << 19), (1 << 14, 700)])
def test_common_grams_and_slices(spark, monkeypatch, limit, piece):
    docs = passages(9, 80)
    rows = [(i, 0, t) for i, t in docs]
    monkeypatch.setattr(suffix_dedup, "LONG_STRING", limit)
    monkeypatch.setattr(suffix_dedup, "SLICE", piece)
    import pandas as pd

    batch = pd.DataFrame(rows, columns=["id", "tie", "text"])
    cut = pd.concat(list(suffix_dedup.cut(100)(iter([batch]))))
    by = ["gram", "digest", "strings", "id", "tie", "start"]
    merged = pd.concat(list(suffix_dedup.merge_equal(100)(thirds(cut.sort_values(by)))))
    text = dict(docs)
    wanted = merged[merged["sort"]].copy()
    wanted["bytes"] = [text[i].encode()[a:b] for i, a, b in zip(wanted["id"], wanted["start"], wanted["stop"])]
    wanted = wanted.sort_values(["gram", "id", "tie", "start"])
    found = list(suffix_dedup.sort_groups(100)(thirds(wanted)))
    spans = pd.concat([merged[~merged["sort"].astype(bool)], *found])
    want = brute_removal(docs, 100)
    for i, t in docs:
        runs = suffix_dedup.joined_spans(spans.loc[spans["id"] == i, ["start", "stop"]].values.tolist())
        assert (sum(b - a for a, b in runs), len(runs)) == want[i][1:3]


def test_removal_of_awkward_rows(spark):
    docs = documents(spark)
    found = {}
    for r in suffix_dedup.remove_repeats(docs).collect():
        found.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans))
    assert found[2] == found[3] == [(0, 0, 0)] and len(found[5]) == 2 and len(found[None]) == 2
    period = LONG[:47]
    assert found[4] == [(len(LONG), len(LONG) - len(period), 1)] and LONG.startswith(period * 2)
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0
    trimmed = suffix_dedup.without_repeats(docs)
    assert trimmed.columns == docs.columns
    assert {r.doc_id: r.text for r in trimmed.collect() if r.doc_id == 4} == {4: period}
    twice = documents(spark, [(1, "x" * 50 + "y" * 150, "en", "a", 200), (1, "x" * 50 + "y" * 150, "en", "a", 200), (1, "z" * 99, "en", "a", 99)])
    assert rows(suffix_dedup.remove_repeats(twice), "n_bytes", "n_removed") == [(200, 149, ), (200, 149), (99, 0)]


def test_cuts_fall_between_characters():
    text = "aé日b"
    assert suffix_dedup.cut_text(text, [(1, 3)]) == "a日b"
    assert suffix_dedup.cut_text(text, [(2, 5)]) == text
    assert suffix_dedup.cut_text(text, [(2, 6)]) == "aéb"

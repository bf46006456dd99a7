"""Every pipeline stage, and operator 7 and the draws of operator 1, against brute force over a small corpus."""

import hashlib
import math
import random
import re
from zlib import crc32

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foliarc.llm import quality, sharding
from tests.llm.frames import documents
from tests.llm.test_shingles import brute_kept
from tests.llm.test_text_operators import water

MASK = (1 << 64) - 1


def corpus(seed=8):
    """Clean prose, junk, exact and near copies, a passage of over 50 words that documents share; labels of a part."""
    draw = random.Random(seed)
    words = [f"word{i}" for i in range(300)]
    text = lambda n: " ".join(draw.choice(words) for _ in range(n))
    passage = text(60)
    docs, good = [], {}
    for i in range(160):
        if i % 8 == 3:
            body = " ".join(draw.choice(["@@", "###", "zzqx", "$$$", "0x0"]) + draw.choice("abc") for _ in range(80))
        elif i % 8 == 5 and i > 8:
            body = docs[i - 4][1]
        elif i % 8 == 6:
            near = docs[i - 2][1].split()
            near[len(near) // 2] = "changed"
            body = " ".join(near)
        else:
            body = text(120) + (" " + passage + " " + text(10) if i % 16 == 0 else "")
        docs.append((i, body, "en", ["a", "b", None][i % 3], len(body)))
        good[i] = int(i % 8 != 3)
    return docs, [(i, q) for i, q in good.items() if i % 2 == 1 or i % 4 == 0]


def brute_grams(text):
    words = [crc32(w.encode()) for w in re.findall(r"\w+|[^\w\s]+", text)]
    pairs = [1 if a == b else ((a * 0x9E3779B97F4A7C15) & MASK) ^ ((b + 0x632BE59BD9B4E019) & MASK) for a, b in zip(words, words[1:])]
    mixed = [((g ^ (g >> 31)) * 0xFF51AFD7ED558CCD) & MASK for g in words + pairs]
    return [(g >> 40) % quality.BUCKETS for g in mixed]


def brute_weights(docs, labels):
    """doc_id -> log weight, and the threshold."""
    target_ids = {i for i, q in labels if q == 1}
    raw, target = [0] * quality.BUCKETS, [0] * quality.BUCKETS
    for i, text, *_ in docs:
        for g in brute_grams(text or ""):
            raw[g] += 1
            target[g] += i in target_ids
    n, m = sum(raw), sum(target)
    logs = [math.log((t + 1) / (m + quality.BUCKETS)) - math.log((r + 1) / (n + quality.BUCKETS)) for r, t in zip(raw, target)]
    weights = {i: sum(logs[g] for g in brute_grams(text or "")) for i, text, *_ in docs}
    scores = {q: [weights[i] for i, label in labels if label == q] for q in (0, 1)}
    best, least = -1.0, None
    values = sorted({w for part in scores.values() for w in part})
    for cut in [values[0] - 1, *((a + b) / 2 for a, b in zip(values, values[1:]))]:
        lost, caught = (sum(w < cut for w in scores[q]) / len(scores[q]) for q in (1, 0))
        if lost <= 1 - quality.CLEAN_RECALL and caught - lost > best:
            best, least = caught - lost, cut
    return weights, least


def test_resampling_equals_brute_force(spark):
    docs, labels = corpus()
    frame = documents(spark, docs)
    named = spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id long, quality int, toxic int")
    weights, least = brute_weights(docs, labels)
    noise = {r.doc_id: r.g for r in frame.select("doc_id", quality.gumbel(F.col("doc_id"), quality.SEED).alias("g")).collect()}
    keys = {i: w + noise[i] for i, w in weights.items()}
    k = sum(w >= least for w in weights.values())
    kept = set(sorted(keys, key=lambda i: (-keys[i], i))[:k])
    for r in quality.resample(frame, named).collect():
        assert abs(r.log_weight - weights[r.doc_id]) < 1e-6 and abs(r.key - keys[r.doc_id]) < 1e-6 and r.kept == (r.doc_id in kept)
    assert 100 < len(kept) < 160 and not any(i % 8 == 3 for i in kept)


def brute_cut(docs, width=100):
    """Texts without strings that start earlier too; runs shrink to whole characters (here: ASCII)."""
    seen, out = set(), {}
    for i, text in sorted(docs):
        gone = [False] * len(text)
        for a in range(len(text) - width + 1):
            if text[a:a + width] in seen:
                gone[a:a + width] = [True] * width
            seen.add(text[a:a + width])
        out[i] = "".join(c for c, g in zip(text, gone) if not g)
    return out


def brute_times(docs, weights=(5, 2, 1), epochs=3):
    """doc_id -> how often the mix takes it whole."""
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", text)) for i, text, _ in docs}
    total = {}
    for i, _, source in docs:
        total[source] = total.get(source, 0) + size[i]
    target, out = water(total), {}
    for source in total:
        mine = sorted((hashlib.md5(f"42:{i}".encode()).hexdigest(), i) for i, _, s in docs if s == source)
        whole = math.floor(target[source] / total[source]) if total[source] else 0
        rest, passed = round(target[source] - whole * total[source]), 0
        for _, i in mine:
            part = max(0, min(size[i], rest - passed))
            passed += size[i]
            out[i] = 1 if size[i] == 0 else whole + (1 if part * 2 >= size[i] else 0)
    return out


def test_stages_equal_brute_force(spark, tmp_path):
    docs, labels = corpus()
    folder = str(tmp_path)
    spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    frame = documents(spark, docs)
    stages = dict(corpus_pipeline.STAGES)

    def run(name, rows):
        out = stages[name](spark, rows, folder)
        assert name == "encoding" or out.columns == frame.columns
        return spark.createDataFrame(out.toPandas(), out.schema)

    named = spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality.resample(frame, named).filter("kept").collect()}
    first = run("quality", frame)
    assert {(r.doc_id, r.text) for r in first.collect()} == {(i, t) for i, t, *_ in docs if i in kept}
    second = run("near_duplicates", first)
    texts = {i: t for i, t, *_ in docs}
    survivors = brute_kept([(i, texts[i]) for i in kept])
    assert sorted(r.doc_id for r in second.collect()) == sorted(survivors) and len(survivors) < len(kept) - 20
    third = run("repeated_passages", second)
    cut = brute_cut([(i, texts[i]) for i in survivors])
    assert {r.doc_id: r.text for r in third.collect()} == cut and sum(map(len, cut.values())) < sum(len(texts[i]) for i in survivors) - 1000
    fourth = run("mixing", third)
    source = {i: s for i, _, _, s, _ in docs}
    times = brute_times([(i, cut[i], source[i]) for i in survivors])
    assert sorted(r.doc_id for r in fourth.collect()) == sorted(i for i in survivors for _ in range(times[i]))
    import base64

    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in run("encoding", fourth).collect():
        assert r.n_tokens == len(library.encode_ordinary(cut[r.doc_id])) and r.decoded_sha256 == hashlib.sha256(cut[r.doc_id].encode()).hexdigest()


def test_stages_of_awkward_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, str(tmp_path))
        assert out.count() > 0 and (name == "encoding" or out.columns == rows.columns)
        rows = spark.createDataFrame(out.collect(), out.schema)


def brute_draw(key, children):
    """The child (name, weight) with the smallest exponential draw."""
    def draw(child):
        bits = int(hashlib.md5(f"{key}/{child[0]}".encode()).hexdigest()[:13], 16)
        return -math.log((bits + 0.5) / 2.0 ** 52) / child[1]
    return min(children, key=draw)[0]


@pytest.mark.parametrize("shards", [7, 39, 40, 43])
def test_shards_equal_drawn_ones(spark, shards):
    frame = documents(spark, [(i, "t", "en", "a", 1) for i in range(400)])
    base = min(shards, 40)
    trees = [sharding.tree_of(n, base) for n in (shards, shards + 1)]
    moved = 0
    for r in sharding.shard_documents(frame, shards).collect():
        want = []
        for tree in trees:
            region = brute_draw(r.doc_id, [(name, sum(sum(x.values()) for x in racks.values())) for name, racks in tree.items()])
            rack = brute_draw(r.doc_id, [(name, sum(leaves.values())) for name, leaves in tree[region].items()])
            want.append(int(brute_draw(r.doc_id, [(f"shard{s}", w) for s, w in tree[region][rack].items()])[5:]))
        assert [r.shard, r.grown_shard] == want and r.grown_shard in (r.shard, shards)
        moved += r.grown_shard == shards
    assert moved > 0

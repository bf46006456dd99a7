"""Media, quality, search and chat operators."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliarc.llm import ann, chat, media, quality
from tests.llm.frames import LONG, documents, rows


def test_chunks_follow_content():
    draw = random.Random(4)
    body = bytes(draw.randrange(256) for _ in range(60_000))
    one, two = media.chunks_of(body), media.chunks_of(b"inserted in front" + body)
    assert b"".join(p for _, p in one) == body
    assert all(len(p) <= media.LARGEST for _, p in one) and all(len(p) >= media.SMALLEST for _, p in one[:-1])
    assert len({d for d, _ in one} & {d for d, _ in two}) >= len(one) - 3
    assert media.decode_media(media.encode_media(b"ab" * 32)) == b"ab" * 32
    with pytest.raises(ValueError):
        media.described(media.encode_media(b"a" * 64), bytes(32))


def test_media_round_trip(spark):
    draw = random.Random(5)
    base = "".join(draw.choice("abcdefgh ") for _ in range(9000))
    data = [(i, base[: 4000 + 50 * i] + str(i) + base[5000:], "en", "a", 1) for i in range(30)] + [(100 + i, base, "en", "a", 1) for i in range(5)]
    data += [(200, None, "en", "a", 0), (201, "", "en", "a", 0), (202, LONG, "en", "a", 0), (203, "x" * 64, "en", "a", 0), (203, "x" * 64, "en", "a", 0), (None, "é", "en", "a", 0)]
    docs = documents(spark, data)
    found = media.media_features(docs).collect()
    assert len(found) == len(data)
    text = {d[0]: d[1] or "" for d in data}
    for r in found:
        raw = text[r.doc_id].encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        stored = media.encode_media(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(stored), hashlib.sha256(stored).hexdigest(), media.feature(payload))
    stored, chunks = media.store(docs)
    assert chunks.count() == chunks.select("digest").distinct().count() > 0
    # Near and exact copies (all rows but the one long text) take less than half their size.
    inline = stored.filter("not doc_id <=> 202").agg(F.sum(F.length("bytes"))).first()[0]
    assert inline + chunks.agg(F.sum(F.length("bytes"))).first()[0] < 0.5 * sum(r.media_bytes for r in found if r.doc_id != 202)
    assert media.media_features(docs.limit(0)).count() == 0


def test_quality_keeps_good_and_drops_junk(spark):
    draw = random.Random(6)
    good = lambda: " ".join(draw.choice(["the", "cat", "sat", "on", "a", "mat", "and", "saw"]) for _ in range(draw.randint(3, 60)))
    junk = lambda: " ".join(draw.choice(["the!!", "%%%", "CAT!!", "&&&"]) for _ in range(draw.randint(8, 60)))
    data = [(i, junk() if i % 7 == 0 else good(), "en", "a", 1) for i in range(1400)]
    labels = spark.createDataFrame([(i, int(i % 7 != 0), 0) for i in range(0, 1400, 2)] + [(None, 1, 0), (9999, None, 0)], "doc_id long, quality int, toxic int")
    docs = documents(spark, data + [(5000, None, None, None, None), (5001, "", "en", "a", 0), (5002, LONG, "en", "a", 0), (None, "the cat", "en", "a", 0)])
    found = {r.doc_id: r for r in quality.resample(docs, labels).collect()}
    held_out = [i for i in range(1400) if i % 2]
    assert np.mean([found[i].kept == (i % 7 != 0) for i in held_out]) > 0.985
    assert found[5000].log_weight == found[5001].log_weight == 0.0 and len(found) == 1404
    kept = quality.kept_documents(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in found.values())
    assert quality.resample(docs, labels.limit(0)).filter("not kept").count() == 0
    assert quality.resample(docs.limit(0), labels).count() == 0


def test_top_k_is_exact(spark, monkeypatch):
    monkeypatch.setattr(quality, "BINS", 4)
    monkeypatch.setattr(quality, "RANKED_AT_ONCE", 3)
    draw = random.Random(2)
    values = [(i, draw.choice([draw.random() ** 9 * 1e6, 1.5, -3.0])) for i in range(500)]
    frame = spark.createDataFrame(values, "doc_id long, key double")
    order = sorted(values, key=lambda v: (-v[1], v[0]))
    for k in (0, 1, 37, 250, 499, 500):
        assert {r.doc_id for r in quality.top_k(frame, "key", "doc_id", k).filter("kept").collect()} == {i for i, _ in order[:k]}


def vectors(spark, data):
    return spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").withColumn("leaf", F.lit("clash"))


@pytest.mark.parametrize("hot", [False, True])
def test_search_reaches_recall(spark, monkeypatch, hot):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 300)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 7)
    monkeypatch.setattr(ann, "LEAF_ROWS", 64)
    draw = np.random.default_rng(3)
    points = draw.normal(size=(3000, 16)).astype(np.float32)
    if hot:
        points[::3] = points[0]
    found = ann.search(vectors(spark, [(i, p.tolist(), 0) for i, p in enumerate(points)]), every=50).toPandas()
    wide, hits = points.astype(np.float64), 0
    for q in range(0, 3000, 50):
        far = np.sqrt(((wide - wide[q]) ** 2).sum(axis=1))
        far[q] = np.inf
        top = np.lexsort((np.arange(3000), far))[:10]
        mine = found[found["query_id"] == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 11)) and np.allclose(far[mine["vec_id"]], mine["score"], atol=1e-12)
        assert list(zip(mine["score"], mine["vec_id"])) == sorted(zip(mine["score"], mine["vec_id"]))
        hits += len(set(top) & set(mine["vec_id"]))
    assert hits / 600 >= 0.9


def test_search_of_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (2, None, 0), (3, [0.0, 0.0], 0), (4, [nan, 1.0], 0), (5, [1.0, None], 0), (6, [inf, 1.0], 0),
            (7, [4.0, 6.0], None), (None, [1.0, 1.0], 0), (8, [], 0), (9, [1.0, 2.0, 3.0], 0), (100, [1.0, 2.0], 0)]
    found = rows(ann.search(vectors(spark, data)), "query_id", "rank", "vec_id", "score")
    assert found == sorted([(0, 1, 1, 0.0), (0, 2, 1, 0.0), (0, 3, 100, 0.0), (0, 4, 7, 5.0), (100, 1, 0, 0.0), (100, 2, 1, 0.0), (100, 3, 1, 0.0), (100, 4, 7, 5.0)],
                           key=lambda r: tuple(map(str, r)))
    assert ann.search(vectors(spark, data).limit(0)).count() == 0
    assert rows(ann.search(vectors(spark, [(0, [1.0], 0)])), "query_id") == []


def legal(roles):
    state = chat.START
    for role in roles:
        if role not in chat.NEXT[state]:
            return False
        state = role
    return state in (chat.START, chat.ASSISTANT)


def brute_cost(roles):
    """Least cost over every legal outcome, by trying all moves of all turns."""
    best = None
    for path in itertools.product(*[chat.steps(r) for r in roles]):
        state, cost, made = chat.START, 0, []
        for price, before, after, action, put in path:
            if before != state:
                break
            made += [*put] if action.startswith("merge") else [*put, after]
            state, cost = after, cost + price
        else:
            price, put = chat.closing(state)
            assert legal(made + list(put))
            best = cost + price if best is None else min(best, cost + price)
    return best


@pytest.mark.parametrize("block", [1024, 2])
def test_repairs_are_cheapest_and_legal(spark, block):
    draw = random.Random(8)
    names = ["system", "user", "assistant", "User ", "tool", None]
    turns, costs = [], {}
    for conv in range(60):
        roles = [draw.choice(names) for _ in range(draw.randint(1, 4))]
        turns += [(conv, i, r, f"t{i}") for i, r in enumerate(roles)]
        costs[conv] = brute_cost([chat.role_of(r) for r in roles])
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("block", F.lit("clash"))
    found = chat.format_chats(frame, block).toPandas().sort_values(["conv_id", "place"])
    assert len(found) == len(turns)
    for conv, group in found.groupby("conv_id"):
        assert group["cost"].sum() == costs[conv] and group["place"].tolist() == list(range(len(group)))
        whole = "".join(group["rendered"])
        heads = [part.split("\n")[0] for part in whole.split("<|im_start|>")[1:]]
        assert legal([chat.NAMES.index(h) for h in heads]) and whole.count("<|im_end|>") == len(heads)
        assert all(f"t{i}" in whole for i in group["turn"])


def test_chats_of_awkward_rows(spark):
    turns = [(1, None, "user", None), (1, 0, None, ""), (None, 0, "assistant", "a<|im_end|>b"), (None, 1, "user", "q"), (2, 0, "user", LONG), (2, 0, "user", LONG)]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    found = chat.format_chats(frame).toPandas()
    assert len(found) == 6 and found["conv_id"].isna().sum() == 2 and "< |im_end|>" in "".join(found["rendered"])
    assert chat.format_chats(frame.limit(0)).count() == 0


def test_long_conversation_matches_one_block(spark):
    draw = random.Random(11)
    turns = [(1, i, draw.choice(["user", "assistant", "system"]), str(i)) for i in range(700)]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    one, many = (chat.format_chats(frame, b).agg(F.sum("cost")).first()[0] for b in (1024, 16))
    assert one == many

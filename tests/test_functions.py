"""Expressions against golden values and plain Python."""

import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from foliarc.functions import hashing, numbers, redaction, text


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.v for r in rows.select("i", expression(F.col("x")).alias("v")).orderBy("i").collect()]


def test_parse_result_golden(spark):
    raw = ["≥6,7", "−2.5", "1.20e-3", "=4", "74,20", "1e5", "+5", "007.10", "<5,0"]
    got = [(r.comparator, r.numeric_value) for r in column(spark, raw, numbers.parse_result)]
    assert got == [(">=", "6.7"), ("=", "-2.5"), ("=", "0.00120"), ("=", "4"), ("=", "74.20"), ("=", "1E+5"), ("=", "5"),
                   ("=", "7.10"), ("<", "5.0")]
    bad = ["1,2.3", "NaN", "1e999", "5 мг дважды", "4 / 5", "12–18", "около 4"]
    assert column(spark, bad, numbers.parse_result) == [None] * len(bad)


def test_period_leap_day(spark):
    rows = spark.createDataFrame([("за последний год",), ("в 2021 году",), ("нет",)], "q string")
    none, today = F.lit(None).cast("date"), F.lit("2024-02-29").cast("date")
    got = rows.select(numbers.resolve_period(F.col("q"), none, none, today).alias("p")).select("p.*").collect()
    assert [(str(r.date_from), str(r.date_to)) for r in got] == [
        ("2023-02-28", "2024-02-29"), ("2021-01-01", "2021-12-31"), ("None", "None")]


def test_percent_rank_half_even(spark):
    rows = spark.createDataFrame([([5.0, 1.0, 3.0, 2.0],), ([7.0],), ([],)], "v array<double>")
    got = [r[0] for r in rows.select(numbers.nearest_rank(F.col("v"), 0.5)).collect()]
    want = [sorted(v)[round(0.5 * (len(v) - 1))] if v else None for v in ([5, 1, 3, 2], [7], [])]
    assert got == want


@pytest.mark.parametrize("quote,source,want", [
    ("b c", "a b\n c d", "b\n c"), ("one\nthree", "one\ntwo\nthree\nfour", "one\ntwo\nthree"),
    ("a d", "a b\nc d", None), ("three\none", "one\ntwo\nthree", None), ("1. 5", "v 1.5", "1.5"), ("", "x", None)])
def test_verified_excerpt(spark, quote, source, want):
    row = spark.createDataFrame([(quote, source)], "q string, s string")
    assert row.select(text.verified_excerpt(F.col("q"), F.col("s")).alias("v")).first().v == want


def test_complete_excerpt_takes_whole_line(spark):
    row = spark.createDataFrame([("48", "x\nАЛТ: 48 Ед/л; выше\ny"), ("Мета b", "мета b\nq")], "q string, s string")
    got = [r.v for r in row.select(text.complete_excerpt(F.col("q"), F.col("s")).alias("v")).collect()]
    assert got == ["АЛТ: 48 Ед/л; выше", "мета b"]


def test_a_quote_equal_to_its_source_verifies(spark):
    source = "Licensed under CC BY-NC 4.0.\n71.175 a. Dose 1, 5"
    rows = spark.createDataFrame([(source, source), (f" {source}\n", source), ("4.0. 71.175 a", source), ("dose 1, 5", source), ("1. 5", "1. 5 or 1.5"), ("1. 6", "1.5")], "q string, s string")
    got = rows.select(text.verified_excerpt(F.col("q"), F.col("s")).alias("v"), text.complete_excerpt(F.col("q"), F.col("s")).alias("c")).collect()
    assert [r.v for r in got] == [source, source, "4.0.\n71.175 a", None, "1.5", None]
    assert [r.c for r in got] == [source, source, source, source.split("\n")[1], "1. 5 or 1.5", None]


def test_occurrences_and_spans(spark):
    rows = spark.createDataFrame([("aaaa", "aa"), ("Яab ab", "ab"), ("x", "y"), ("a.b.a", "."), ("a\\Eb", "\\E")], "t string, q string")
    got = [[tuple(o) for o in r.o] for r in rows.select(text.occurrences(F.col("t"), F.col("q")).alias("o")).collect()]
    assert got == [[(0, 2), (1, 3), (2, 4)], [(2, 4), (5, 7)], [], [(1, 2), (3, 4)], [(1, 3)]]
    spans = spark.createDataFrame([("Я", 0, 1), ("Яb", 0, 2), ("a", 0, 5)], "p string, a int, b int")
    assert [r.v for r in spans.select(text.span_text(F.col("p"), F.col("a"), F.col("b")).alias("v")).collect()] == [None, "Я", None]


def test_canonical_json_equals_python(spark):
    value = {"a": "Кот \"x\" \t\n\x0b\x1f \\u000B", "b": None, "c": 3}
    row = spark.createDataFrame([(value["a"], None, 3)], "a string, b string, c int")
    got = row.select(hashing.canonical_json(F.struct("a", "b", "c")).alias("j")).first().j
    assert got == json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def test_letters(spark):
    got = [r.v for r in spark.createDataFrame([(i,) for i in (0, 25, 26, 701, 702)], "i int").select(text.letters(F.col("i")).alias("v")).collect()]
    assert got == ["A", "Z", "AA", "ZZ", "AAA"]


def test_tokens_equal_python(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("aßΣB éЯ1_-.\n") for _ in range(rng.randint(0, 30))) for _ in range(50)] + [""]
    want = [re.findall(r"\w+", t.casefold()) or ["_"] for t in texts]
    assert column(spark, texts, text.tokens) == want


def test_contact_masking_equals_python(spark):
    texts = ["Mail a.b@x.org now", "see /home/u/f.txt and docs/a.pdf and (report.md)", "АД 120/80, 5 мг/кг/сут, 12/05/2024, mmol/L",
             "Адрес: ул. Ленина\nnext", "C:\\data\\x y", "+7 (912) 345-67-89 ok"]
    w = r"\w"
    rules = [(rf"(?i)\b[{w}.+-]+@[{w}.-]+\.[a-zа-я]{{2,}}\b", "[EMAIL]"),
             (r"(?<!\w)(?:\+7|\+1|8)[ \t]*[(-]?\d{3}[) \t-]*\d{3}[ \t-]*\d{2}[ \t-]*\d{2}(?!\d)", "[PHONE]")]
    got = column(spark, texts, redaction.mask_contacts)
    for before, after in zip(texts, got):
        plain = before
        for pattern, label in rules:
            plain = re.sub(pattern, label, plain)
        assert ("[EMAIL]" in plain) == ("[EMAIL]" in after) and ("[PHONE]" in plain) == ("[PHONE]" in after)
    assert got[1] == "see [LOCAL_PATH] and [LOCAL_PATH] and ([SOURCE_FILE])"
    assert got[2] == texts[2]


def test_content_hash(spark):
    assert column(spark, ["Привет"], hashing.content_hash) == [hashlib.sha256("Привет".encode()).hexdigest()]

"""Row-heavy work is dealt evenly and done once for all that share it."""

from pyspark.sql import functions as F

from foliarc import session, vocab
from foliarc.functions import redaction as r
from foliarc.operators import redact


def test_rows_of_one_row_group_are_dealt_to_all_tasks(spark, tmp_path):
    folder = str(tmp_path / "one")
    spark.range(20000).withColumn("text", F.sha2(F.col("id").cast("string"), 256)).coalesce(1).write.parquet(folder)
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32768")
    try:
        table = spark.read.parquet(folder)
        assert table.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism  # as many splits as cores, all rows in one
        sizes = [row["count"] for row in session.spread(table, "id").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert sum(sizes) == 20000 and max(sizes) < 4 * 20000 / (session.WAVES * spark.sparkContext.defaultParallelism)


ODD = ["Patient: Anna Blum met Dr. Stone at clinic: North; phone: +1 222 333 44 55", "Anna", "mrn 77 and 77\nDOB 01.02.1990 Anna Blum", "",
       "Иванов Иван Иванович, врач Пётр Петров. СНИЛС: 11-22 Иванов И.И.", "MRN: 77-1 Mr Blum, address: A 7. 1.1.90 Fictional Participant Zed Yon",
       "ſtel 12345678 tel: 12345678 kartа card no 5 Karta 9", "Prof\tAnna Blum\r\nprof. Blum, Miss Anna"]


def test_names_made_once_for_a_package_mask_the_same(spark):
    pairs = spark.createDataFrame([(a, b) for a in ODD for b in ODD], "context string, text string")

    def whole(text, source):
        return r.mask_labelled(r.mask_people(r.mask_contacts(text), r.people(source)), r.labelled_values(source))

    named = pairs.withColumn("names", r.package_names(F.col("context"))).withColumn("both", r.package_names(F.concat_ws("\n", "context", "text")))
    source = F.concat_ws("\n", "context", "text")
    wrong = named.filter((r.sanitize(F.col("text"), F.col("names")) != whole(F.col("text"), source))
                         | (r.sanitize_field(F.col("text"), F.col("both")) != whole(F.col("text"), F.concat_ws("\n", source, F.col("text")))))
    assert wrong.count() == 0


def test_leading_letters_lose_no_match(spark):
    patterns = [p for p, _ in vocab.CONTACT_RULES] + [vocab.IDENTIFIER_LABEL, vocab.DOB_LABEL, vocab.PHONE_LABEL, vocab.LOCATION_LABEL,
                                                      vocab.PERSON_LABEL, *[p for _, p in vocab.UNLABELLED_NAMES]]
    texts = spark.createDataFrame([(t,) for t in ODD], "t string")
    led = 0
    for pattern in patterns:
        bare = pattern.replace("(?=(?iu:[фпвуpdf]))", "")
        for letters in ("сопнкpimrcd", "дрd", "тpt", "акach", "+8", "А-ЯЁ", "DdPpДдПп", "M"):
            bare = bare.replace(f"(?=[{letters}])", "").replace(f"(?={letters})", "")
        led += bare != pattern
        assert texts.filter(F.regexp_replace("t", pattern, "#") != F.regexp_replace("t", bare, "#")).count() == 0
    assert led == 11


def test_contact_rules_that_skip_texts_mask_the_same(spark):
    texts = spark.createDataFrame([(t,) for t in [*ODD, "a@b.org c:\\x\\y.pdf", "see ./a/b.txt ~/x/y", "no signs", "a=b clinic = North; address", "01234567-0123-0123-0123-0123456789ab"]], "t string")
    bare = F.col("t")
    for pattern, label in vocab.CONTACT_RULES:
        bare = F.regexp_replace(bare, pattern, label)
    assert texts.filter(~r.mask_contacts(F.col("t")).eqNullSafe(bare)).count() == 0
    assert spark.range(1).select(r.mask_contacts(F.lit(None).cast("string")).alias("n")).first()["n"] is None


def test_people_of_a_package_are_looked_for_once(spark):
    packages = spark.createDataFrame([("p", ["Anna came", "Dr Stone and Anna"], "Patient: Anna Blum")], "package_id string, fields array<string>, identifier_context string")
    done = redact.redact(packages)
    assert done.first()["texts"] == ["[PERSON_A] came", "[DOCTOR_B] and [PERSON_A]"]
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    line = next(x for x in plan.splitlines() if "_clean" in x and "transform(fields" in x)
    assert "участник" not in line.split("transform(fields", 1)[1].split("_clean", 1)[0]

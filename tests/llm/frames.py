"""Small frames with the awkward cases every operator must handle."""

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
                   StructField("source", StringType()), StructField("n_chars", LongType())])
LONG = "a long text that repeats itself, word by word, " * 4000


def documents(spark, rows=None):
    """Nulls in every column, empty and very long texts, ties and repeated rows, columns with clashing names."""
    rows = rows if rows is not None else [
        (1, "one two three four five six", "en", "a", 27), (2, None, None, None, None), (3, "", "en", "b", 0), (4, LONG, "en", "a", len(LONG)),
        (5, "éàü ß 日本語 \U0001f600 ok", "de", "c", 10), (5, "éàü ß 日本語 \U0001f600 ok", "de", "c", 10), (None, "no id here", "en", "a", 10),
        (None, "another without id", "en", None, 18), (7, "one two three four five six", "en", "b", 27), (8, " \t\n ", "en", "b", 4),
    ]
    docs = spark.createDataFrame(rows, DOCS)
    for name in ("size", "shard", "n_tokens", "target", "fp", "id", "tie", "key", "kept"):
        docs = docs.withColumn(name, F.lit("clash"))
    return docs


def rows(df, *columns):
    return sorted([tuple(r) for r in df.select(*columns).collect()], key=lambda r: tuple((v is None, str(v)) for v in r))

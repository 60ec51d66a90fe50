"""Rows that every operator must take: nulls, empty and very long texts, ties, repeated rows, clashing extra columns."""

from pyspark.sql import functions as F

LONG = ("The quick brown fox jumps over the lazy dog. " * 6000).strip()
ODD = [
    (1, "Hello world, this is a plain English text about nothing at all.", "en", "s0", 10), (2, None, "en", None, None), (3, "", None, "s0", 0), (4, LONG, "en", "s0", 5), (5, "Hello world, this is a plain English text about nothing at all.", "en", "s1", 10),
    (5, "Hello world, this is a plain English text about nothing at all.", "en", "s1", 10), (None, "Der schnelle braune Fuchs springt über den faulen Hund.", "de", "s0", 3), (7, "\u0000 %%% 123 \n\n   \t", None, "s0", 1), (8, "漢字かな 🎉🎉 ñandú É", "es", "s0", 1), (None, None, None, None, None),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


def clashing(df):
    """More columns, with names that results or inner names have, or that differ by case."""
    out = df
    for c in ("score", "rid", "key", "k0", "text__", "spans", "ids", "media", "n_links", "host", "kept", "component_id", "formatted"):
        out = out.withColumn(c, F.lit("x"))
    return out


def empty(spark, schema=SCHEMA):
    return spark.createDataFrame([], schema)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)

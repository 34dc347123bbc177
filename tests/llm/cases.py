"""Rows that every operator must get through: nulls in any column, empty and
very long texts, ties, repeated rows, extra columns with clashing names."""

LONG = "word and more " * 20_000
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = [
    (1, "", "en", "a", 0),
    (2, None, "en", "a", None),
    (3, "   \t\n\x0b ", None, None, 5),
    (4, LONG, "en", "a", len(LONG)),
    (5, "one line here\nanother line here", "en", None, 30),
    (5, "one line here\nanother line here", "en", None, 30),
    (6, "one line here\nanother line here", None, "a", 30),
    (None, "one line here\nsomething else", "de", "b", 20),
    (7, "<s> ▁ café 漢字 \U0001f642 <0x41>", "fr", "a", 20),
    (8, "x", "en", "a", 1),
]


def documents(spark, rows=ODD):
    return spark.createDataFrame(rows, DOCS)


def clashing(df):
    """Extra columns with the operators' own names."""
    from pyspark.sql import functions as F
    for c in ("fp", "key", "segment", "score", "ids", "node", "root", "kept", "n_lines", "first", "label", "host",
              "declared", "heard", "bucket", "measure", "coverage", "n_tokens", "held_out", "component_id"):
        df = df.withColumn(c, F.lit("extra"))
    return df

"""Documents that every document operator must take."""

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
    # extra columns whose names clash with names used inside
    T.StructField("class", T.StringType()),
    T.StructField("score", T.IntegerType()),
    T.StructField("piece", T.StringType()),
    T.StructField("t", T.StringType()),
])
LONG = " ".join(f"word{k % 977}x{k}" for k in range(30_000))


def row(i, text, lang="en"):
    return (i, text, lang, "s", None if text is None else len(text), "c", 1, "p", "t")


def edge_rows():
    return [
        row(1, None), row(2, ""), row(3, " \n\t "), row(None, "alpha beta gamma delta epsilon zeta"), row(4, "alpha beta gamma delta epsilon zeta", None),
        row(5, "same text here twice over"), row(5, "same text here twice over"), row(6, LONG), row(7, "x" * 50_000), row(8, "\u0000 😀 ß ÀÉ <|im_end|> \\"), row(9, "Only\nlines\n\n\nof few words."),
    ]


def documents(spark, rows=None):
    return spark.createDataFrame(edge_rows() if rows is None else rows, SCHEMA)

"""Tables with everything that may go wrong in them."""

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
CLASH = ["fp", "node", "key", "n_words", "kept", "root", "h", "body", "spans", "lines", "part", "ids"]


def docs(spark, rows, clash=True):
    """(doc_id, text) rows as documents with the usual columns and some whose names operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    return df.withColumns({c: F.lit("x") for c in CLASH}) if clash else df


ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "no id here"), (4, "one"), (4, "one"), (5, "one"), (6, "a b " * 20000), (7, "   é \U0001f600"),
       (8, "x" * 50000)]

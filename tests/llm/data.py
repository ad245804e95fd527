"""Small tables with nulls, empty and long texts, repeated rows and clashing columns."""

SCHEMA = "doc_id long, text string, quality string, placement string, slot long, kept string"
ODD = [None, "", " ", "\n\n", "a", "word " * 30_000, "Zeile\r\n\ttab\x0bvt", "ünï çødé 漢字 🎉 " * 3, "\x00\x1f ok", "a b c", "a b c a b c a b c"]


def frame(spark, texts, schema=SCHEMA):
    rows = [(i, t, "x", None, i, "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, schema)


def put(spark, folder, texts):
    """A folder with such a documents table, for the registered queries."""
    frame(spark, texts).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return str(folder)

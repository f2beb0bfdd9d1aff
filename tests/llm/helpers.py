import re

WORD = re.compile("[^\x20\x09-\x0d]+")

#: Rows with nulls in every column, empty and long texts, repeats and ties.
ODD_ROWS = [
    (1, "The same words here and there, again and again.", "en", "a", 1),
    (1, "The same words here and there, again and again.", "en", "a", 1),
    (2, None, "en", "a", None),
    (None, "No id but a text of some words to read", None, None, 7),
    (None, None, None, None, None),
    (3, "", "fr", None, 0),
    (4, " \t\n\x0b ", "fr", "b", 3),
    (5, "word " * 30000, "en", "a", 9),
    (6, "The same words here and there, again and again.", "de", "b", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, rows, path, schema=SCHEMA, extra=False):
    df = spark.createDataFrame(rows, schema)
    if extra:  # names that operators use themselves
        for c in ("fp", "group", "key", "bin", "shard", "size", "score", "n_words", "h", "at", "spans", "ids"):
            df = df.selectExpr("*", f"'x' as {c}")
    df.write.mode("overwrite").parquet(f"{path}/documents.parquet")
    return str(path)

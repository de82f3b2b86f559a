"""Rows that every operator must take: nulls, blanks, long texts, repeats, columns with clashing names."""

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Names that operators use inside.
CLASHING = ("row", "digest", "key", "spans", "kept", "n", "label", "_ROW", "band", "score", "term", "size", "ids", "lang_pred")
SAME = "one two three four five six seven eight nine ten eleven twelve mail a.b@example.com or call +1 (222) 555-0100"
LONG = " ".join(f"word{k % 977} und so weiter" for k in range(30_000))
EDGE = [
    (None, None, None, None, None),
    (None, SAME, "en", "s", 5),
    (1, "", "en", "s", 0),
    (2, " \t\n\x0b \r\n", None, "s", 9),
    (3, LONG, "de", None, len(LONG)),
    (4, SAME, "en", "s", None),
    (5, SAME, "en", "s", len(SAME)),
    (5, SAME, "en", "s", len(SAME)),
    (6, None, "fr", "s", 3),
    (7, "word", "en", "s", 4),
    (8, "x" * 70_000 + "1" * 5_000 + "@" * 10, "en", "s", 75_010),
    (9, "▁ éé \U0001f600\x00   ퟿", "fr", "s", 1),
]


def edge(spark, rows=EDGE):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, COLUMNS).repartition(3)
    return df.withColumns({c: F.lit(f"{c}!") for c in CLASHING})


def documents(spark, *texts, **columns):
    """Documents numbered from 0 with the given texts."""
    return spark.createDataFrame(
        [(k, t, columns.get("lang", "en"), "s", len(t or "")) for k, t in enumerate(texts)], COLUMNS)

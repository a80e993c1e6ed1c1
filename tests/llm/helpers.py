"""Small tables with the awkward rows every operator has to take."""

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use inside, as columns of the input.
CLASHES = {"key": "1", "_key": "2", "score": "3", "held_out": "4", "line": "5", "n_lines": "6", "uid": "7"}


def documents(spark, rows, clashes=False):
    """Documents from (doc_id, text) or whole rows."""
    full = [(*r, None, None, None)[:5] if len(r) < 5 else r for r in rows]
    df = spark.createDataFrame(full, DOCUMENTS)
    if clashes:
        from pyspark.sql import functions as F

        df = df.withColumns({n: F.lit(v) for n, v in CLASHES.items()})
    return df


LONG = "lorem ipsum dolor sit amet " * 40_000
AWKWARD = [
    (1, "One two three four five six seven eight nine ten eleven.", "en", "a", 56),
    (1, "One two three four five six seven eight nine ten eleven.", "en", "a", 56),
    (2, None, "en", "b", None),
    (3, "", None, None, 0),
    (None, "no id here at all", "en", "c", 17),
    (None, None, None, None, None),
    (4, " \t\n \r\n", "en", "a", 6),
    (5, "12 34 -- !!", "en", "b", 11),
    (6, LONG, "la", "c", len(LONG)),
    (7, "Ünïcödé ß 漢字 \U0001f600 x́", "de", "d", 20),
    (8, "x" * 300_000, "en", "d", 300_000),
]

"""Small tables shared by the tests."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """Small documents table with an extra column; rows are (doc_id, text) or (doc_id, text, lang)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, "s", len(r[1] or ""), "x") for r in rows]
    return spark.createDataFrame(full, DOCS + ", `__h.text` string")


AWKWARD = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (None, "null id"), (None, "null id"), (5, "é中🙂 mixed ÀÉ"), (6, "tie"), (6, "tie"),
           (7, "tie"), (8, "word " * 6000), (9, "\u0000\u0001 odd"), (10, "!!! ???")]

"""Documents for the tests of the training-data operators."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def make_docs(spark, rows, extra: bool = False):
    """Documents from ``(doc_id, text)`` or ``(doc_id, text, lang)``; ``extra`` adds columns named as the operators' own."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1]) if r[1] is not None else None) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    if extra:
        for name in ("id", "size", "sign", "node", "token", "group", "key", "row", "kept", "n_words", "counts", "block", "bucket", "a", "b"):
            df = df.selectExpr("*", f"'x' AS `{name}`")
    return df


ODD = [
    (None, None), (None, "a null id with some words in it"), (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one two three four"),
    (6, "x" * 300_000), (7, "same words here " * 30), (7, "same words here " * 30), (8, "same words here " * 30), (9, "日本語 text　mixed 🎉 ́"),
]

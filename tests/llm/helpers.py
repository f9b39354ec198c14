"""Small document tables for the operators' tests."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept string"


def docs(spark, texts, **columns):
    """A documents table of (text) or (id, text) rows, with extra columns whose names clash with result columns."""
    rows = []
    for k, t in enumerate(texts):
        i, text = t if isinstance(t, tuple) else (k, t)
        rows.append((i, text, columns.get("lang", "en"), columns.get("source", "s"), len(text or ""), "x", "y"))
    return spark.createDataFrame(rows, DOCS)


SAMPLE = "/root/testdata/sf0.001"

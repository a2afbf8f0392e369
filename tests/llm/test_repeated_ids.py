"""Rows that share an id but not their text in the pipeline's stages."""

from pixelframe.llm import ngram_join


def test_dedup_stage(spark):
    """A copy of a smaller id goes alone: the other row of its id stays, also as the one kept for its own group."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(3, b), (5, a), (5, b + " x"), (7, a + " x"), (8, a), (8, c), (8, c)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    got = sorted((r.doc_id, r.text) for r in ngram_join.dedup_stage(spark, docs, "").collect())
    assert got == [(3, b), (5, a), (8, c)]

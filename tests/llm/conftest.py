import pytest

#: Names that operators use or might use themselves.
CLASHING = (
    "anchor", "bits", "chunk", "_h", "size", "_kept_sha", "_text_key", "_n_bytes", "_spans", "_cut_text", "row", "mark", "spans",
)


@pytest.fixture
def documents(spark):
    """Build a documents table from (doc_id, text) pairs, with columns whose names may clash."""

    def build(rows):
        shape = "doc_id long, text string, lang string, source string, n_chars long, key string, " + ", ".join(f"{c} int" for c in CLASHING)
        return spark.createDataFrame([(i, t, "en", "s", 0, "k", *range(len(CLASHING))) for i, t in rows], shape)

    return build

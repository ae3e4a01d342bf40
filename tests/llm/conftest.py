import pytest

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def documents(spark):
    """Builds a documents table from (doc_id, text[, lang, source]) rows, with extra columns that clash with outputs."""

    def build(rows, parts=3, extra=True):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src0", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOCUMENTS)
        if extra:
            for name in ("size", "shard", "kept", "score", "a", "key", "part"):
                df = df.selectExpr("*", f"'clash' AS {name}")
        return df.repartition(parts) if full else df

    return build


ODD = [
    (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one"), (5, "Über straße und MEHR Wörter"), (6, "a b\nc  d\r\na b"),
    (7, "same words here again and again"), (8, "same words here again and again"), (8, "same words here again and again"),
    (None, "no id at all"), (None, None), (20, "x" * 5000), (21, "w " * 3000),
]


@pytest.fixture
def odd():
    return list(ODD)

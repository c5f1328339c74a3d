import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

DOCS = StructType([StructField(n, t) for n, t in (("doc_id", LongType()), ("text", StringType()), ("lang", StringType()), ("source", StringType()), ("n_chars", LongType()), ("score", StringType()))])

WORDS = "lunar crater basalt ejecta regolith highland mare ridge rille dome vent slope shadow impact glass breccia orbit pixel frame strip".split()


def sentence(seed: int, n: int) -> str:
    """Words that look random and depend on the seed alone."""
    out, x = [], seed * 2654435761 % 2**32
    for _ in range(n):
        x = (1103515245 * x + 12345) % 2**31
        out.append(WORDS[(x >> 16) % len(WORDS)] + ("s" if x >> 20 & 1 else ""))
    return " ".join(out)


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (id, text) pairs, with further columns, one of them with a clashing name."""

    def build(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t) if t else 0, "x") for i, t in rows], DOCS)

    return build


@pytest.fixture(scope="session")
def odd_rows():
    """Null and empty texts, null ids, repeated rows, a very long text, separators only, text beyond ASCII."""
    long = sentence(5, 30_000)
    return [(1, None), (2, ""), (3, " \t\n"), (None, "lunar crater"), (4, "lunar crater"), (4, "lunar crater"), (5, long), (6, "Ünïcödé ΑΣ ß 日本"), (None, None), (7, sentence(7, 120))]

import pytest

WORDS = [f"w{i}" for i in range(40)]


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) pairs, with columns whose names clash with the operators' own."""
    def build(rows, partitions=3):
        data = [(i, t, "en", "s", None if t is None else len(t), i, "x", 0.5, [1], "y") for i, t in rows]
        return spark.createDataFrame(data, "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, node BIGINT, blob STRING, score DOUBLE, "
                                           "_items ARRAY<INT>, _shard STRING").repartition(partitions)
    return build


@pytest.fixture(scope="session")
def hard(make):
    """Nulls, empty and very long texts, ties, repeated rows, and a group of copies that is a third of all rows."""
    base = " ".join(f"a{i}" for i in range(60))
    near = base.replace("a7 ", "b7 ")
    long = " ".join(f"l{i % 977}x{i // 977}" for i in range(30_000))
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "one two"), (5, base), (6, near), (6, near), (7, long), (8, "x " + long), (None, base), (None, None),
            (9, "é ü " * 20), (-4, base + " tail words here"), (10, "A B C"), (11, "a b c"), (12, "same same same same same same same same same same same same same same same")]
    rows += [(100 + i, base) for i in range(12)]
    return make(rows)

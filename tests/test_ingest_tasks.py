"""The tasks that score a batch of the ingest follow its rows."""
from patchrank.streaming import ingest as ig


def test_partitions_grow_with_the_rows(spark):
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", 4)
    ig.spread_over(session, 10)
    assert session.conf.get("spark.sql.shuffle.partitions") == "4"
    ig.spread_over(session, 40 * ig.TASK_ROWS + 1)
    assert session.conf.get("spark.sql.shuffle.partitions") == "41"
    assert spark.conf.get("spark.sql.shuffle.partitions") != "41"

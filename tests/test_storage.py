"""Intermediate tables: who owns them, and what may be dropped."""

from pathlib import Path

from pyspark.sql import functions as F

from veldspar.storage import materialise, owned, scratch


def here(path: str) -> bool:
    return Path(path.removeprefix("file://")).exists()


def test_only_tables_that_no_kept_frame_reads_are_dropped(spark):
    before = materialise(spark.range(3), "before")
    with owned(spark) as outer:
        first = materialise(spark.range(10), "first")
        with owned(spark) as inner:
            second = materialise(first.filter("id < 5"), "second")
            third = materialise(spark.range(7), "third")
            folder = scratch(spark, "folder")
            spark.range(2).write.parquet(f"{folder}/deep/table")
    assert len(outer.paths) == 4 and len(inner.paths) == 3
    kept = second.join(spark.read.parquet(f"{folder}/deep/table"), "id").groupBy().agg(F.sum("id").alias("s"))
    third_path = inner.paths[1]
    assert inner.drop(kept) == 1 and not here(third_path)
    assert kept.first()["s"] == 1 and first.count() == 10 and before.count() == 3
    assert outer.drop(kept) == 2  # the first table, and the third, which is gone already
    assert kept.first()["s"] == 1 and len(outer.paths) == 2
    assert outer.drop() == 2 and not any(map(here, inner.paths)) and before.count() == 3


def test_nothing_is_owned_outside_a_scope(spark):
    with owned(spark) as tables:
        pass
    materialise(spark.range(1), "free")
    assert tables.paths == [] and tables.drop() == 0


def test_a_scope_that_fails_can_still_be_dropped(spark):
    try:
        with owned(spark) as tables:
            materialise(spark.range(1), "made")
            raise RuntimeError("lost")
    except RuntimeError:
        pass
    path = tables.paths[0]
    assert here(path) and tables.drop() == 1 and not here(path)

"""Outputs by run: made again, dropped, compacted, and cut short at every point."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shotlake.sources import outputs as O

SCHEMA = StructType().add("stream", "string").add("x", "long")


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), SCHEMA).repartition(2)


def names(spark, *streams):
    return spark.createDataFrame([(s,) for s in streams], "stream string")


def read(out):
    return sorted(map(tuple, out.read().collect()))


def test_sources_are_run_again_dropped_and_come_back(spark, tmp_path):
    out = O.Outputs(spark, str(tmp_path), SCHEMA)
    assert read(out) == [] and out.done().count() == 0 and out.compacted() == []
    assert out.write(rows(spark, ("a", 1), ("a", 1), ("b", 2), (None, 9))) == 1
    assert read(out) == [("a", 1), ("a", 1), ("b", 2)]
    out.write(rows(spark, ("c", 3), ("d", 4), ("b", 99)), names(spark, "c", "e", "c", None))
    assert read(out) == [("a", 1), ("a", 1), ("b", 2), ("c", 3)]
    todo = names(spark, "a", "d", "e", "f")
    assert sorted(r.stream for r in out.pending(todo).collect()) == ["d", "f"]
    assert out.pending(todo, overwrite=True).count() == 4
    out.write(rows(spark, ("a", 5)), names(spark, "a"))
    out.drop(names(spark, "b", "z"))
    assert read(out) == [("a", 5), ("c", 3)]
    out.write(rows(spark, ("b", 6)))
    kept = read(out)
    assert kept == [("a", 5), ("b", 6), ("c", 3)]
    assert out.compacted() == [1, 4]
    assert read(out) == kept and sorted(r.stream for r in out.done().collect()) == ["a", "b", "c", "e"]
    assert out.compacted() == []


def test_runs_with_nothing_of_no_use_are_scanned_without_a_join(spark, tmp_path):
    out = O.Outputs(spark, str(tmp_path), SCHEMA)
    out.write(rows(spark, ("a", 1)))
    out.write(rows(spark, ("b", 1)))
    assert "Join" not in out.read()._jdf.queryExecution().executedPlan().toString()
    out.write(rows(spark, ("a", 2)))
    assert "Join" in out.read()._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("least", [0.0, 0.4])
def test_compacting_keeps_sources_gone_where_an_older_run_stays(spark, tmp_path, least):
    out = O.Outputs(spark, str(tmp_path), SCHEMA)
    out.write(rows(spark, *((s, 1) for s in "abcdef")))
    out.drop(names(spark, "a"))
    assert out.compacted(least) == ([1, 2] if least == 0 else [2])
    assert read(out) == [(s, 1) for s in "bcdef"]
    out.drop(names(spark, "b", "c", "d"))
    out.compacted(least)
    assert read(out) == [("e", 1), ("f", 1)]


def test_a_run_that_is_cut_short_changes_nothing(spark, tmp_path):
    out = O.Outputs(spark, str(tmp_path), SCHEMA)
    out.write(rows(spark, ("a", 1), ("b", 2)))
    broken = rows(spark, ("a", 7)).withColumn("x", F.raise_error(F.lit("stop")).cast("long"))
    with pytest.raises(Exception, match="stop"):
        out.write(broken, names(spark, "a"))
    # Rows are there, and a list whose job has not committed.
    rows(spark, ("a", 8)).write.parquet(str(tmp_path / "rows/_run=9"))
    spark.createDataFrame([("a", False)], "stream string, gone boolean").write.parquet(str(tmp_path / "lists/_run=9"))
    os.remove(tmp_path / "lists/_run=9/_SUCCESS")
    assert read(out) == [("a", 1), ("b", 2)]
    assert out.write(rows(spark, ("b", 3))) == 10
    out.compacted()
    assert read(out) == [("a", 1), ("b", 3)]
    assert sorted(os.listdir(tmp_path / "rows")) == sorted(os.listdir(tmp_path / "lists")) == ["_run=10", "_run=11"]


@pytest.mark.parametrize("after", range(6))
def test_compacting_cut_short_between_deletions(spark, tmp_path, monkeypatch, after):
    out = O.Outputs(spark, str(tmp_path), SCHEMA)
    out.write(rows(spark, ("a", 1), ("b", 2), ("c", 3)))
    out.drop(names(spark, "a"))
    out.write(rows(spark, ("b", 4)))
    real, left = O._delete, [after]

    def delete(spark, path):
        if not left[0]:
            raise RuntimeError("driver lost")
        left[0] -= 1
        real(spark, path)

    monkeypatch.setattr(O, "_delete", delete)
    try:
        out.compacted()
    except RuntimeError:
        pass
    monkeypatch.undo()
    assert read(out) == [("b", 4), ("c", 3)]
    out.compacted()
    assert read(out) == [("b", 4), ("c", 3)] and sorted(r.stream for r in out.done().collect()) == ["b", "c"]


def test_columns_that_clash_are_refused(spark, tmp_path):
    for schema in (StructType().add("x", "long"), StructType().add("stream", "string").add("_run", "long")):
        with pytest.raises(ValueError):
            O.Outputs(spark, str(tmp_path), schema)

"""What a task or a broadcast holds doesn't grow with the volume."""

import re

from pyspark.sql import functions as F

from porespan import fixtures
from porespan.operators import voxels as V
from porespan.plans import registry, volumes
from porespan.sources import readers


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_masks_are_merged_not_broadcast(spark, sf):
    """Spark takes runs of a function to be few; those of a large volume don't fit the driver."""
    assert "Broadcast" not in plan(volumes.volume_overlap(spark, sf))


def test_only_moves_are_broadcast(spark, sf):
    masks = volumes.canvas_masks(volumes.encoded(spark, sf))
    a, b = (masks.where(F.col("mask") == m).drop("mask") for m in "ab")
    for df in (volumes.volume_canvas(spark, sf), volumes.volume_overlay(spark, sf), V.register(a, b, ["half"])):
        text = plan(df)
        assert "BuildRight" in text and "BuildLeft" not in text
        for at in re.finditer(r"BroadcastExchange.*\n.*", text):  # straight from an aggregate or a join of aggregates
            assert "Union" not in at.group() and "MapInPandas" not in at.group()


def test_tasks_take_a_bounded_number_of_slices(spark, sf, monkeypatch):
    monkeypatch.setattr(fixtures, "SLICES", 3)
    n = fixtures.SHAPE[0] * fixtures.grown_depth(spark, sf)
    slices = fixtures.grown_slices(spark, sf)
    assert slices.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0] <= 3
    assert slices.select("scan_index", "z").distinct().count() == n


def test_files_are_written_by_many_tasks(spark):
    """Spark deals rows as small as these to one task, which then writes all files."""
    path = registry.text_files(spark.range(64).select(F.col("id").alias("k"), F.concat(F.lit("nx "), "id").alias("value")), "many")
    texts = readers.solver_texts(spark, path)
    names = [r[0] for r in texts.select("file").collect()]
    assert len(names) == 64 and len({re.search(r"part-(\d+)", n).group(1) for n in names}) > 8
    read_once = {(r.file, r.value) for r in readers.solver_values(spark, texts, ["nx"]).collect()}
    assert len(read_once) == 64 and read_once == {(r.file, r.value) for r in readers.solver_values(spark, path, ["nx"]).collect()}

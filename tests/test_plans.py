"""Plans that have to stay as they are: pushed filters, pruned columns, equi-joins, no Python where none is needed."""

import re

from porespan.fixtures import voxels
from porespan.operators import catalog as R
from porespan.operators import runs as RL
from porespan.operators import voxels as V
from porespan.plans import registry

PYTHON = re.compile("BatchEvalPython|ArrowEvalPython|MapInPandas|MapInArrow|InPandas|InArrow|PythonUDTF")


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_fixture_scan_is_pruned_and_filtered(spark, sf):
    p = plan(voxels(spark, sf))
    assert "GreaterThanOrEqual(l_linenumber,1)" in p
    schema = re.search(r"ReadSchema: (\S+)", p)[1]
    assert "l_comment" not in schema and "l_extendedprice" not in schema


def test_run_arithmetic_stays_in_the_jvm(spark):
    runs = spark.createDataFrame([(0, 0, 0, 0, 4, 1)], RL.RUNS)
    boxes = spark.createDataFrame([(1, 0, 2, 0, 2, 0, 3)], "track_id int, z0 int, z1 int, y0 int, y1 int, x0 int, x1 int")
    for df in (V.sw_series(runs), V.x_density(runs), V.centre_of_gravity(runs, ["scan_index"]), V.block_any(runs, 4), RL.clip(runs, boxes, [])):
        p = plan(df)
        assert not PYTHON.search(p) and "Cartesian" not in p and "NestedLoop" not in p


def test_counts_are_combined_before_the_shuffle(spark):
    runs = spark.createDataFrame([(0, 0, 0, 0, 4, 1)], RL.RUNS)
    p = plan(V.label_histogram(runs))
    assert p.count("HashAggregate") >= 2 and p.count("Exchange") >= 1


def test_upsert_is_an_anti_join(spark):
    t = spark.createDataFrame([(1, 1.0)], "k int, v double")
    assert "LeftAnti" in plan(R.upsert(t, t, ["k"]))


def test_relational_queries_have_no_python(spark, sf):
    for name in ("kr_wide", "run_listing", "provenance_join", "orphan_counts", "job_list", "select_domains", "nearest_sw", "regime_fit_shared", "cross_solver"):
        assert not PYTHON.search(plan(registry.queries()[name](spark, sf))), name

import pytest

from tidegrid.session import checkpoint_root, discard, materialize
from tidegrid.sources import table


def test_materialized_frames_are_read_from_the_shared_folder(spark):
    df = spark.range(10).selectExpr("id", "CAST(NULL AS STRING) AS s", "array(id) AS a")
    got = materialize(df, "numbers")
    assert got.dtypes == df.dtypes and sorted(map(str, got.collect())) == sorted(map(str, df.collect()))
    assert all(f.removeprefix("file://").startswith(checkpoint_root(spark)) for f in got.inputFiles())
    discard(got)
    with pytest.raises(Exception):
        got.collect()


def test_empty_frames_keep_their_schema(spark):
    df = spark.range(0).selectExpr("id", "struct(id AS x) AS y")
    assert materialize(df, "nothing").dtypes == df.dtypes and materialize(df, "nothing").count() == 0


def test_the_clusters_folder_is_used(spark):
    before = spark.conf.get("spark.checkpoint.dir")
    assert checkpoint_root(spark) == before


def test_unknown_tables_are_refused(spark):
    with pytest.raises(ValueError, match="unknown table"):
        table(spark, "/nowhere", "no_such_table")


def test_scans_are_pruned_and_filtered(spark):
    from tidegrid.plans import relational

    plan = relational.pricing_summary(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate), LessThanOrEqual(l_shipdate" in plan
    schema = plan.split("ReadSchema: ")[1]
    assert "l_quantity" in schema and "l_partkey" not in schema

"""Readers, sinks and streams on small files."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.sources import guards, runs, sections
from lattica.streaming import results

RESULT = T.StructType([T.StructField("seed", T.IntegerType()), T.StructField("metric", T.StringType()), T.StructField("value", T.DoubleType())])


def test_latest_run_of_each_variant(spark, tmp_path):
    for variant, stamp, value in (("a", "20250101_000000", 1.0), ("a", "20250301_000000_seed7", 2.0), ("b", "20240101_120000", 3.0)):
        folder = tmp_path / "set" / variant / stamp / "metrics"
        folder.mkdir(parents=True)
        (folder / "m.csv").write_text(f"seed,metric,value\n0,ari,{value}\n")
    (tmp_path / "set" / "a" / "20260101_000000" / "metrics").mkdir(parents=True)
    found = runs.scan_results(spark, str(tmp_path / "set/*/*/metrics/m.csv"), RESULT).collect()
    assert {r.variant: (r.value, r.seed, r.timestamp) for r in found} == {"a": (2.0, 7, "20250301_000000"), "b": (3.0, 0, "20240101_120000")}
    every = runs.scan_results(spark, str(tmp_path / "set/*/*/metrics/m.csv"), RESULT, latest=False, prefixes=("a",))
    assert every.count() == 2


def test_vendor_tables(spark, tmp_path):
    (tmp_path / "e.csv").write_text("fov,cell_ID,GeneA,Blank1,GeneB\n1,1,3,1,0\n1,2,0,1,5\n2,9,1,0,1\n")
    (tmp_path / "c.csv").write_text("fov,cell_ID,CenterX_global_px,CenterY_global_px\n1,1,0.5,1.5\n1,2,2,3\n3,3,0,0\n")
    cells, expr = sections.read_section(spark, "cosmx", str(tmp_path / "e.csv"), str(tmp_path / "c.csv"))
    assert {(r.cell_id, r.gene_id, r.value) for r in expr.collect()} == {("1_1", "GeneA", 3), ("1_2", "GeneB", 5)}
    assert {r.cell_id: (r.x, r.y) for r in cells.collect()} == {"1_1": (0.5, 1.5), "1_2": (2.0, 3.0)}
    with pytest.raises(ValueError):
        sections.read_section(spark, "other")
    (tmp_path / "e2.csv").write_text("cell,GeneA\nc1,2\nc2,0\n")
    (tmp_path / "c2.csv").write_text("cell,x,y\nc1,1,2\nc2,3,4\nc9,0,0\n")
    cells, expr = sections.read_section(spark, "merfish", str(tmp_path / "e2.csv"), str(tmp_path / "c2.csv"), "s1")
    assert {r.cell_id for r in cells.collect()} == {"c1_s1", "c2_s1"} and expr.count() == 1
    cells, expr = sections.read_section(spark, "starmap", str(tmp_path / "e2.csv"), str(tmp_path / "c2.csv"))
    assert {r.cell_id: r.original_id for r in cells.collect()} == {0: "c1", 1: "c2"}


def test_sinks_never_overwrite(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0), (2, 3.0)], "section_id int, v double")
    sections.write_sections(df, str(tmp_path / "s"))
    assert (tmp_path / "s" / "section_id=1").is_dir()
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sections.write_new(df, str(tmp_path / "s"))


def test_arriving_results(spark, tmp_path):
    rows = [("a", 1, "ari", 0.5, "2025-01-01 00:00:00"), ("a", 1, "ari", 0.9, "2025-01-01 00:01:00"), ("a", 2, "ari", 0.7, "2025-01-01 00:02:00")]
    schema = "variant string, seed int, metric string, value double, ts timestamp"
    spark.createDataFrame(rows, "variant string, seed int, metric string, value double, ts string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = results.arriving_results(spark, str(tmp_path / "in"), T._parse_datatype_string(schema))
    once = results.first_of_each_seed(stream, "ts")
    query = once.writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r.seed, r.value) for r in spark.table("once").collect()) in ([(1, 0.5), (2, 0.7)], [(1, 0.9), (2, 0.7)])
    means = results.windowed_means(stream, "ts").writeStream.format("memory").queryName("means").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp2")).start()
    means.processAllAvailable()
    means.stop()
    assert spark.table("means").first().n == 3


def test_versions_are_seen_when_they_are_committed(spark, tmp_path):
    """A write that dies half-way, two writers of one version, and a reader of an old one."""
    root = str(tmp_path / "table")
    rows = spark.range(6).withColumnRenamed("id", "v").repartition(3)
    with pytest.raises(FileNotFoundError):
        guards.current(spark, root)
    guards.supersede(rows, root, 1)
    old = guards.current(spark, root)

    broken = rows.select(F.when(F.col("v") == 5, F.raise_error(F.lit("lost"))).otherwise(F.col("v").cast("string")).alias("v"))
    with pytest.raises(Exception, match="lost"):
        guards.supersede(broken, root, 2)
    assert guards.current(spark, root).count() == 6 and list(guards.versions(spark, root)) == [1]
    (tmp_path / "table" / "v=000002").mkdir(exist_ok=True)  # what a writer leaves that was killed
    (tmp_path / "table" / "v=000002" / "part-0.parquet").write_bytes(b"half")
    assert guards.current(spark, root).count() == 6

    second = guards.supersede(rows.where("v < 4"), root, 2)
    assert guards.current(spark, root).count() == 4 and "v=000002-" in second
    with pytest.raises(FileExistsError):
        guards.supersede(rows, root, 2)
    assert not guards._put_if_absent(spark, root, 2, {"version": 2, "folder": "v=other"}) and guards.current(spark, root).count() == 4
    (tmp_path / "table" / "_log" / "000003.json").write_text('{"version": 3, "fol')  # died inside the entry
    assert guards.current(spark, root).count() == 4 and old.count() == 6 and guards.current(spark, root, 1).count() == 6
    guards.supersede(rows.limit(1), root, 4)
    assert guards.current(spark, root).count() == 1 and list(guards.versions(spark, root)) == [1, 2, 4]

"""Intermediate tables: where they may lie, and when they go."""

import os
import subprocess
import sys
import threading
from concurrent.futures import ThreadPoolExecutor
from types import SimpleNamespace

import pytest

from normgraph import storage

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_a_cluster_needs_a_shared_folder():
    nothing = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="spark://host:7077", getConf=lambda: {}, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: nothing)))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_dir(SimpleNamespace(conf={}, sparkContext=context))


def test_tables_go_when_the_driver_ends(tmp_path):
    code = """
from pyspark.sql import SparkSession
from normgraph.storage import materialize
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "DIR").getOrCreate()
assert materialize(spark.range(5), "x").count() == 5
spark.stop()
""".replace("DIR", str(tmp_path / "shared"))
    said = subprocess.run([sys.executable, "-B", "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    assert os.listdir(tmp_path / "shared" / "normgraph") == []


def test_settled_leaves_one_table(spark):
    before = storage.written(spark)
    out = storage.settled(spark, "last", lambda: storage.materialize(storage.materialize(spark.range(7), "a"), "b"))
    assert len(storage.written(spark) - before) == 1 and out.count() == 7
    storage.release(spark, keep=before)
    assert storage.written(spark) == before


def test_graphs_follow_their_files(spark, sf_dir, tmp_path):
    from normgraph.plans.tables import master

    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows.where("vec_id < 60").write.parquet(f"{tmp_path}/embeddings.parquet")
    one = master(spark, str(tmp_path))
    assert one is master(spark, str(tmp_path)) and one.nodes.count() == 60
    rows.where("vec_id < 40").write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
    two = master(spark, str(tmp_path))
    assert two is not one and two.nodes.count() == 40
    storage.release(spark)
    three = master(spark, str(tmp_path))
    assert three is not two and three.edges.count() >= 0


def test_scopes_remove_their_own_only(spark):
    before = storage.written(spark)
    with storage.scope(spark):
        kept = storage.materialize(spark.range(3), "kept")
        with pytest.raises(ZeroDivisionError), storage.scope(spark):
            storage.materialize(spark.range(3), "a")
            storage.materialize_bucketed(spark.range(3), "b", ("id",), 2)
            1 / 0
        assert len(storage.written(spark) - before) == 1
        with storage.scope(spark, lasting=True):
            lasting = storage.materialize(spark.range(4), "lasting")
        with pytest.raises(ZeroDivisionError):
            storage.settled(spark, "s", lambda: storage.materialize(spark.range(3), "c").withColumn("x", 1 / 0))
    assert kept.count() == 3 and lasting.count() == 4
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("normgraph_")]
    storage.release(spark, keep=before)
    assert storage.written(spark) == before


def test_threads_do_not_remove_each_other_s_tables(spark):
    before, setting = storage.written(spark), spark.conf.get("spark.sql.legacy.bucketedTableScan.outputOrdering")
    started = threading.Barrier(3)

    def work(k):
        def make():
            one = storage.materialize(spark.range(100 + k), "one")
            started.wait()
            with storage.ordered_buckets(spark):
                two, _ = storage.materialize_bucketed(one, "two", ("id",), 2)
                if k == 2:
                    raise ValueError("stop")
                return storage.materialize(one.join(two, "id"), "three")

        try:
            return storage.settled(spark, "last", make).count()
        except ValueError:
            return -1

    with ThreadPoolExecutor(3) as pool:
        assert list(pool.map(work, range(3))) == [100, 101, -1]
    assert spark.conf.get("spark.sql.legacy.bucketedTableScan.outputOrdering") == setting
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("normgraph_")]
    storage.release(spark, keep=before)
    assert storage.written(spark) == before


def test_graphs_follow_files_of_nested_folders(spark, sf_dir, tmp_path):
    from normgraph.plans.tables import master

    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id < 60")
    rows.write.partitionBy("label").parquet(f"{tmp_path}/embeddings.parquet")
    one = master(spark, str(tmp_path))
    had = rows.where("label = 3").count()
    rows.where("label = 3").drop("label").limit(2).write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet/label=3")
    two = master(spark, str(tmp_path))
    assert had > 2 and two is not one and two.nodes.count() == 62 - had

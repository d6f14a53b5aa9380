"""Lineage cuts, guarded broadcasts and bounded batches."""

import pytest
from pyspark.sql import functions as F

from stemma.plans import storage


def test_tables_in_the_shared_folder(spark):
    df = spark.range(10).withColumn("x", F.lit(None).cast("string"))
    kept = storage.materialise(df, "t")
    assert kept.schema == df.schema or kept.count() == 10
    folder = kept.inputFiles()[0].rsplit("/", 1)[0]
    storage.discard(kept)
    assert not spark._jvm.java.io.File(folder.replace("file:", "").replace("///", "/")).exists()
    assert storage.materialise(df.filter("id < 0"), "t").isEmpty()


def test_parts(spark):
    parts = [spark.range(k, k + 1) for k in range(5)]
    assert storage.gathered(iter(parts), "g").count() == 5 and storage.gathered(iter([]), "g") is None
    assert len(storage.compacted(parts, 10)) == 5
    one = storage.compacted([storage.materialise(p, "p") for p in parts], 3)
    assert len(one) == 1 and one[0].count() == 5


def test_broadcast_only_below_the_bound(spark):
    left = spark.range(100)
    hinted = lambda n: "ResolvedHint" in left.join(storage.broadcast_if_small(spark.range(10), n), "id")._jdf.queryExecution().analyzed().toString()
    assert hinted(10) and not hinted(9)


def test_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with storage.small_batches(spark, 7):
        assert spark.conf.get(name) == "7"
    assert spark.conf.get(name) == before


def test_own_folder_only_where_none_is_named(spark, monkeypatch):
    assert storage.shared_dir(spark) == spark.conf.get(storage.CHECKPOINT_CONF)
    monkeypatch.setattr(storage, "CHECKPOINT_CONF", "spark.stemma.unset")
    assert "checkpoints" in storage.shared_dir(spark)


def test_the_shared_folder_is_refused_on_a_cluster():
    assert all(map(storage.is_local, ["local", "local[*]", "local[8]", "local[4,2]"]))
    assert not any(map(storage.is_local, ["yarn", "spark://h:7077", "local-cluster[2,1,1024]", "k8s://x"]))

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://h:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session())


def test_join_counted(spark):
    rows = storage.materialise(spark.createDataFrame([("hot", k) for k in range(300)] + [(f"k{k % 40}", k) for k in range(200)] + [("none", 1)], "key string, v int"), "rows")
    counted = rows.filter("key <> 'none'").groupBy("key").count()
    for most in (1, 3, 1000):
        got = storage.join_counted(rows, counted, "key", "count", most=most).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, rows.join(counted, "key").collect())) and len(got) == 500


def test_numbered(spark):
    names = [(f"n{k:03d}", k % 3) for k in range(50)] + [("é", 0), ("Z", 0), ("", 0), ("n001", 9)]
    got = storage.numbered(spark.createDataFrame(names, "name string, k int").repartition(3), ["name", "k"]).collect()
    assert [(r["name"], r["k"]) for r in sorted(got, key=lambda r: r["nth"])] == sorted(names) and sorted(r["nth"] for r in got) == list(range(54))

"""What jobs over large tables leave on the disk and deal out."""

import os
import re

from pyspark.sql import functions as F

import __spark_entry__ as driver
from stemma.functions import ident
from stemma.operators import closure, cvedb, merkle
from stemma.plans import exchange, storage
from stemma.sources import rawlog, readers, schemas, sinks
from tests.oracle import needs_tables

A, B, C = "a" * 40, "b" * 40, "c" * 40
EDGES = [(A, B), (A, C), (B, C), (A, B)]


def tables(spark):
    return set(os.listdir(top)) if os.path.isdir(top := storage.shared_dir(spark).removeprefix("file:")) else set()


def shuffle_files(spark):
    top = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {top.apply(k).getName() for k in range(top.size())}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def log_records(spark, n=40):
    none = "array()"
    infile = "array(named_struct('pos', 0, 'blob', sha1('in'), 'path', '/a b', 'has_cve', array('CVE-1-1'), 'fixed_cve', array('CVE-1-2'), 'prov_pkg', CAST(NULL AS STRING)))"
    rows = spark.range(1, n + 1).selectExpr(
        "id AS seq", "'1' AS pid", "CAST(NULL AS STRING) AS exec_mode", "sha1(CAST(id AS STRING)) AS out_blob", "concat('/o', id) AS out_path", "'cc' AS build_cmd", "CAST(NULL AS STRING) AS build_tool", "CAST(NULL AS STRING) AS pkg_info", "CAST(NULL AS STRING) AS prune", "false AS ignore",
        f"{infile} AS infiles", f"CAST({none} AS array<{schemas.DYNLIB}>) AS dynlibs",
    )
    return rows


def test_packed_ids_come_back(spark):
    texts = [A, "0" * 64, "", "abc", "ABCD", "é", "n0", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("p", ident.packed(F.col("t")))
    got = {r["t"]: (r["p"], r["u"]) for r in rows.withColumn("u", ident.unpacked(F.col("p"))).collect()}
    assert all(got[t][1] == t for t in texts) and len(got[A][0]) == 21


def test_a_log_is_read_once_and_not_dealt(spark, tmp_path):
    """F1, F12, F16: numbering deals no text, and one reading gives all files."""
    rawlog.write_raw_log(log_records(spark), str(tmp_path / "log"), compression="gzip")
    log = rawlog.read_raw_log(spark, str(tmp_path / "log"))
    assert sorted(r["seq"] for r in log.select("seq").collect()) == list(range(1, 41))
    assert [r["out_path"] for r in log.orderBy("seq").collect()] == [f"/o{k}" for k in range(1, 41)]
    files = rawlog.file_set(log)
    assert files.count() == 41
    # Besides the log itself, its blocks are counted.
    assert len(re.findall("Scan text", plan(files))) <= 2 and not re.search(r"hashpartitioning\(f#", plan(log.select("seq")).split("BroadcastExchange")[0])
    hints = cvedb.hint_rows(log.selectExpr("explode(infiles) AS f").select("f.*"))
    assert {(r["cve"], r["status"]) for r in hints.collect()} == {("CVE-1-1", "hint_cve"), ("CVE-1-2", "hint_fixed")}
    assert len(re.findall("Scan text", plan(hints))) <= 2


def test_closures_keep_what_they_found_only(spark):
    """F2"""
    edge = spark.createDataFrame(EDGES, "out_blob string, in_blob string")
    before, files = tables(spark), shuffle_files(spark)
    closed = closure.closure(edge, spark.createDataFrame([(A,)], "root string"))
    left = {re.sub("-[0-9a-f]+$", "", t) for t in tables(spark) - before}
    assert left == {"stemma-frontier"} and shuffle_files(spark) <= files
    assert {(r["blob"], r["depth"]) for r in closed.collect()} == {(A, 0), (B, 1), (C, 1)}


def test_documents_keep_open_tables_only(spark):
    """F4, F5, F9 to F11, F13"""
    edge = spark.createDataFrame(EDGES, "out_blob string, in_blob string")
    before, files = tables(spark), shuffle_files(spark)
    got = merkle.identify(edge, spark.createDataFrame([(B,)], "blob string"))
    left = {re.sub("-[0-9a-f]+$", "", t) for t in tables(spark) - before}
    assert left <= {"stemma-open"} and shuffle_files(spark) <= files
    assert {r["blob"]: r["doc"] for r in got.collect()} == {A: f"gitoid:blob:sha1\nblob {B}\nblob {C}\n", B: f"gitoid:blob:sha1\nblob {C}\n"}


def test_log_order_keeps_open_tables_only(spark):
    """F3, F4"""
    log = spark.createDataFrame([(B, C, 1), (A, B, 2)], "out_blob string, in_blob string, seq long")
    before, files = tables(spark), shuffle_files(spark)
    got = merkle.identify_in_log_order(log, reuse_unary=False)
    left = {re.sub("-[0-9a-f]+$", "", t) for t in tables(spark) - before}
    assert left <= {"stemma-open", "stemma-grown"} and shuffle_files(spark) <= files
    ids = {(r["blob"], r["seq"]): r for r in got.collect()}
    assert ids[(A, 2)]["doc"] == f"gitoid:blob:sha1\nblob {B} bom {ids[(B, 1)]['bom_id']}\n"


def test_stores_and_lines_deal_texts_once(spark, tmp_path):
    """F7, F14, F15"""
    docs = spark.createDataFrame([("1" * 40, f"blob {A}\n"), ("2" * 40, f"blob {A}\nblob {B} bom {C}\n"), ("1" * 40, f"blob {A}\n")], "bom_id string, doc string")
    before, files = tables(spark), shuffle_files(spark)
    for part in (docs.limit(1), docs):
        sinks.write_doc_store(part, str(tmp_path / "store"))
    assert tables(spark) == before and shuffle_files(spark) <= files
    assert sorted(r["bom_id"][0] for r in readers.read_doc_table(spark, str(tmp_path / "store")).collect()) == ["1", "2"]
    lines = readers.doc_lines(docs)
    assert {(r["blob"], r["bom_id"][0]) for r in readers.docs_with(lines, lines.select("blob")).collect()} == {(A, "1"), (A, "2"), (B, "2")}
    once = merkle.bom_lines(docs)
    assert "unhex" in plan(once) and {(r["bom_id"][0], r["blob"], r["child_bom"]) for r in once.collect()} == {("1", A, None), ("2", A, None), ("2", B, C)}


@needs_tables
def test_records_deal_keys_only(spark):
    """identifiers, paths and hints are made after the last exchange."""
    made = exchange._records(spark, driver.SMALL, in_order=True)
    assert not [x for x in plan(made).split("\n") if "collect_set" in x and "sha1" in x]


def sliced_and_whole(spark, monkeypatch, run):
    """What ``run`` gives with slices and without; with them, how many tables each step was written in."""
    whole, written = sorted(map(str, run().collect())), []
    for module in (storage, merkle):
        monkeypatch.setattr(module, "SLICE_ROWS", 0)
    monkeypatch.setattr(storage, "SLICES", 2)
    write = storage.Stored.write
    monkeypatch.setattr(storage.Stored, "write", classmethod(lambda cls, df, tag: written.append(tag) or write(df, tag)))
    before = tables(spark)
    got = run()
    assert {re.sub("-[0-9a-f]+$", "", t) for t in tables(spark) - before} <= {"stemma-open", "stemma-compacted"}
    assert sorted(map(str, got.collect())) == whole
    return written


def chain(spark):
    """Numbers made of smaller ones, some of them twice."""
    rows = spark.range(30).selectExpr("sha1(CAST(id AS STRING)) AS out_blob", "explode(array(id % 10, id + 1000, id + 1000)) AS k", "id AS seq")
    return rows.filter("k <> seq").selectExpr("out_blob", "sha1(CAST(k AS STRING)) AS in_blob", "seq")


def test_log_order_goes_by_slices(spark, monkeypatch):
    """F4"""
    written = sliced_and_whole(spark, monkeypatch, lambda: merkle.identify_in_log_order(chain(spark), reuse_unary=False))
    assert written.count("open") >= 2 * storage.SLICES and written.count("told") >= storage.SLICES


def test_graphs_go_by_slices(spark, monkeypatch):
    """F5, F9"""
    pruned = spark.createDataFrame([(3,), (7,)], "k int").selectExpr("sha1(CAST(k AS STRING)) AS blob")
    written = sliced_and_whole(spark, monkeypatch, lambda: merkle.identify(chain(spark), pruned, dedupe=False))
    assert written.count("open") >= 2 * storage.SLICES and written.count("told") >= storage.SLICES


def test_ids_alone_keep_no_lists_of_what_is_ready(spark, monkeypatch):
    """F5, F9 to F11, F13: the links are read by slices and not kept, and ready outputs are kept by their id."""
    pruned = spark.createDataFrame([(3,), (7,)], "k int").selectExpr("sha1(CAST(k AS STRING)) AS blob")
    want = {(r["blob"], r["bom_id"], r["cycle"]) for r in merkle.identify(chain(spark), pruned).collect()}
    written = sliced_and_whole(spark, monkeypatch, lambda: merkle.identify(chain(spark), pruned, docs=False))
    assert "rows" not in written and written.count("told") >= storage.SLICES
    got = merkle.identify(chain(spark), pruned, docs=False)
    assert {(r["blob"], r["bom_id"], r["cycle"]) for r in got.collect()} == want and got.columns == ["blob", "bom_id", "cycle"]


def test_lines_of_single_documents_are_not_dealt(spark, monkeypatch):
    """with few places too, repeated documents have each line once."""
    docs = spark.createDataFrame([(str(k % 9) * 40, f"gitoid:blob:sha1\nblob {A}\nblob {A}\nblob {str(k % 9) * 40} bom {B}\n") for k in range(12)], "bom_id string, doc string")
    want = sorted([(str(k) * 40, A, None) for k in range(9)] + [(str(k) * 40, str(k) * 40, B) for k in range(9)], key=str)
    for places in (1 << 28, 4, 1):
        monkeypatch.setattr(merkle, "_PLACES", places)
        told = merkle._repeated(docs)
        assert {r["bom_id"][0] for r in told.filter("again").collect()} >= {"0", "1", "2"}
        once = merkle.bom_lines(docs)
        assert sorted(map(tuple, once.collect()), key=str) == want
    monkeypatch.setattr(merkle, "_PLACES", 1 << 28)
    assert {r["bom_id"][0] for r in merkle._repeated(docs).filter("again").collect()} == {"0", "1", "2"}


@needs_tables
def test_log_goes_by_slices_and_is_not_kept(spark, monkeypatch):
    """a log goes once its records are kept; slices give what one log gives."""
    before = tables(spark)
    whole = sorted(map(tuple, exchange.rawlog_file(spark, driver.SMALL).collect()))
    monkeypatch.setattr(storage, "SLICE_ROWS", 0)
    written, write = [], rawlog.write_raw_log
    monkeypatch.setattr(rawlog, "write_raw_log", lambda *a, **k: written.append(a[1]) or write(*a, **k))
    assert sorted(map(tuple, exchange.rawlog_file(spark, driver.SMALL).collect())) == whole and whole
    left = {re.sub("-[0-9a-f]+$", "", t) for t in tables(spark) - before}
    assert left == {"stemma-records"} and len(written) == storage.SLICES

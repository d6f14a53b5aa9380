"""Queries of the readers, writers, command lines and streams: tables are written in an exchange format and read again.

Files go to the session's shared folder.  What has one file for each row is
made from the small tables.
"""

from __future__ import annotations

import io
import tarfile
import zipfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemma.functions import ident, text
from stemma.operators import cvedb, dag, matching, merkle, processes
from stemma.plans.queries import _EDGES_SQL, _g, _gt, _named, _order_edges, _part_status, _t, query
from stemma.plans.storage import SLICES, Stored, gathered, lean_writes, materialise, read_slices, scratch, within
from stemma.sources import commands, rawlog, readers, sinks
from stemma.streaming import pipelines


def _c(*parts) -> F.Column:
    """Texts and columns (by expression) put together."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _file(spark, path: str, content: bytes | str) -> None:
    """One small file, by the file system that the path belongs to."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(conf).create(place)
    out.write(bytearray(content.encode() if isinstance(content, str) else content))
    out.close()


def _lines(df: DataFrame, value, order: str, tag: str) -> str:
    """A folder of text files with a line (or more) for each row, in order."""
    folder = scratch(df.sparkSession, tag)
    df.repartitionByRange(order).sortWithinPartitions(order).select(value.alias("value")).write.text(folder)
    return folder


def _tail(c: str, sep: str = "/"):
    return F.element_at(F.split(c, sep), -1)


# ---- logs


def _records(spark, sf_dir, *, in_order: bool = False, part: range = range(SLICES)) -> DataFrame:
    """Orders (of some slices) as build records: parts are inputs, even ones carry a hint, and suppliers are libraries."""
    none = F.array().cast("array<string>")
    hint = lambda k, r: F.when(k % 5 == r, F.array(_c("CVE-2020-", k % 50 + 1000))).otherwise(none)
    infile = lambda k: F.struct(k.cast("int").alias("pos"), _named("part", k.cast("string")).alias("blob"), _c("/src/a b/p", k, ".c").alias("path"), hint(k, 0).alias("has_cve"), hint(k, 1).alias("fixed_cve"), F.lit(None).cast("string").alias("prov_pkg"))
    dynlib = lambda k: F.struct(k.cast("int").alias("pos"), _named("supplier", k.cast("string")).alias("blob"), _c("/lib/s", k, ".so").alias("path"))
    # Only keys are dealt; what is made of them is made where it is used.
    keys = lambda c: F.array_sort(F.collect_set(F.struct(F.col(c).alias("k"))))
    own = _t(spark, sf_dir, "lineitem").filter(within(part, F.col("l_orderkey"))).groupBy("l_orderkey").agg(keys("l_partkey").alias("parts"), keys("l_suppkey").alias("suppliers"))
    if in_order:
        own = own.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey").sortWithinPartitions("l_orderkey")
    own = own.select("l_orderkey", F.transform("parts", lambda s: infile(s["k"])).alias("infiles"), F.transform("suppliers", lambda s: dynlib(s["k"])).alias("dynlibs"))
    blank = lambda c: F.lit(None).cast("string").alias(c)
    key = F.col("l_orderkey")
    return own.select(
        key.alias("seq"), _c(key % 7).alias("pid"), blank("exec_mode"), _named("order", "l_orderkey").alias("out_blob"), _c("/out/o", key, ".o").alias("out_path"), _c("cc -c o", key).alias("build_cmd"), F.lit("/bin/cc").alias("build_tool"),
        F.when(key % 3 == 0, _c("pkg ", key % 10)).alias("pkg_info"), blank("prune"), (key % 11 == 0).alias("ignore"), "infiles", "dynlibs",
    )


_LOG_SQL = f"""
ins AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p, {_g('order', 'l_orderkey')} AS out_blob, {_g('part', 'l_partkey')} AS in_blob, '/src/a b/p' || l_partkey || '.c' AS path FROM lineitem),
libs AS (SELECT DISTINCT l_orderkey AS o, {_g('supplier', 'l_suppkey')} AS blob, '/lib/s' || l_suppkey || '.so' AS path FROM lineitem)
"""


def _log(spark, sf_dir, *, part: range = range(SLICES), folder: str | None = None) -> DataFrame:
    folder = folder or scratch(spark, "log")
    rawlog.write_raw_log(_records(spark, sf_dir, in_order=True, part=part), folder, in_order=True, compression="gzip")
    return rawlog.read_raw_log(spark, folder)


@query(
    f"""WITH {_LOG_SQL}, n AS (SELECT o, count(*) AS n FROM libs GROUP BY o)
    SELECT out_blob, '/out/o' || o || '.o' AS out_path, CAST(o % 7 AS VARCHAR) AS pid, 'cc -c o' || o AS build_cmd, CASE WHEN o % 3 = 0 THEN 'pkg ' || o % 10 END AS pkg_info, o % 11 = 0 AS ignore,
      string_agg(in_blob || ' ' || path, ',' ORDER BY p) AS inputs, count(*) AS n_inputs, max(n) AS n_libs FROM ins JOIN n USING (o) GROUP BY o, out_blob"""
)
def rawlog_file(spark, sf_dir):
    """A large log is written and read as one for each slice of the orders, and goes once its records are kept, with identifiers as bytes."""
    plain = ["out_path", "pid", "build_cmd", "pkg_info", "ignore"]

    def kept():
        for part in read_slices(_t(spark, sf_dir, "lineitem"), F.col("l_orderkey")):
            folder = scratch(spark, "log")
            files = F.transform("infiles", lambda f: F.struct(ident.packed(f["blob"]).alias("blob"), f["path"].alias("path")))
            yield _log(spark, sf_dir, part=part, folder=folder).select(ident.packed(F.col("out_blob")).alias("out_blob"), *plain, files.alias("infiles"), F.size("dynlibs").cast("long").alias("n_libs"))
            Stored(spark, None, [folder]).drop()

    with lean_writes(spark):
        records = gathered(kept(), "records")
    listed = F.array_join(F.transform("infiles", lambda f: F.concat_ws(" ", ident.unpacked(f["blob"]), f["path"])), ",")
    return records.select(ident.unpacked(F.col("out_blob")).alias("out_blob"), *plain, listed.alias("inputs"), F.size("infiles").cast("long").alias("n_inputs"), "n_libs")


@query(f"WITH {_LOG_SQL} SELECT DISTINCT out_blob AS blob, '/out/o' || o || '.o' AS path FROM ins UNION SELECT in_blob, path FROM ins UNION SELECT blob, path FROM libs")
def log_file_set(spark, sf_dir):
    return rawlog.file_set(_log(spark, sf_dir))


@query(f"WITH {_LOG_SQL} SELECT kind, path, count(*) AS n FROM (SELECT 'input' AS kind, path FROM ins UNION ALL SELECT 'dynlib', path FROM libs) GROUP BY ALL")
def linker_inputs(spark, sf_dir):
    return rawlog.linker_inputs(_records(spark, sf_dir)).groupBy("kind", "path").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_LOG_SQL} SELECT out_blob, string_agg(CASE WHEN p % 2 = 0 THEN 'even ' || p ELSE '-' END, ',' ORDER BY p) AS pkgs FROM ins GROUP BY out_blob")
def log_annotate(spark, sf_dir):
    even = _t(spark, sf_dir, "part").filter("p_partkey % 2 = 0").select(_named("part", "p_partkey").alias("blob"), _c("even ", F.col("p_partkey")).alias("prov_pkg"))
    told = rawlog.annotate(_records(spark, sf_dir), even)
    return told.select("out_blob", F.array_join(F.transform("infiles", lambda f: F.coalesce(f["prov_pkg"], F.lit("-"))), ",").alias("pkgs"))


def _open_orders(spark, sf_dir, status="O"):
    return _t(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == status).select(_named("order", "o_orderkey").alias("blob"))


@query(f"SELECT {_g('order', 'o_orderkey')} AS out_blob, count(DISTINCT l_partkey) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O' GROUP BY o_orderkey")
def log_truncate(spark, sf_dir):
    return rawlog.truncate(_records(spark, sf_dir), _open_orders(spark, sf_dir)).select("out_blob", F.size("infiles").cast("long").alias("n"))


@query(f"SELECT {_g('order', 'l_orderkey')} AS out_blob, CASE WHEN max(o_orderstatus) = 'F' THEN 'subtree' END AS prune FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey")
def log_prune(spark, sf_dir):
    both = rawlog.set_prune(_records(spark, sf_dir), _open_orders(spark, sf_dir, "O").unionByName(_open_orders(spark, sf_dir, "F")))
    return rawlog.set_prune(both, _open_orders(spark, sf_dir, "O"), None).select("out_blob", "prune")


@query(f"WITH {_LOG_SQL} SELECT in_blob AS blob, path AS file_path, 'CVE-2020-' || (p % 50 + 1000) AS cve, CASE p % 5 WHEN 0 THEN 'hint_cve' ELSE 'hint_fixed' END AS status FROM (SELECT DISTINCT in_blob, path, p FROM ins) WHERE p % 5 < 2")
def log_hints(spark, sf_dir):
    files = _log(spark, sf_dir).select(F.explode("infiles").alias("f")).select("f.blob", "f.path", "f.has_cve", "f.fixed_cve")
    return cvedb.hint_rows(files)


@query(
    f"""WITH {_LOG_SQL}, kept AS (SELECT * FROM ins WHERE o % 11 > 0), named AS (
      SELECT in_blob AS blob, path, o * 2 + 1 AS place, NULL AS cmd, NULL AS pkg FROM kept UNION ALL SELECT DISTINCT out_blob, '/out/o' || o || '.o', o * 2, 'cc -c o' || o, CASE WHEN o % 3 = 0 THEN 'pkg ' || o % 10 END FROM kept)
    SELECT blob, arg_min(path, place) AS file_path, count(DISTINCT path) AS n_paths, max(cmd) AS build_cmd, coalesce(string_agg(DISTINCT pkg, ','), '') AS pkg_infos, CAST(min(place) AS BIGINT) AS first_seq FROM named GROUP BY blob"""
)
def graph_nodes(spark, sf_dir):
    told = dag.nodes(_records(spark, sf_dir))
    return told.select("blob", "file_path", F.size("file_paths").cast("long").alias("n_paths"), "build_cmd", F.array_join("pkg_infos", ",").alias("pkg_infos"), "first_seq")


@query(f"WITH {_LOG_SQL} SELECT out_blob, in_blob, CAST(o AS BIGINT) AS seq, CAST(p AS INTEGER) AS pos FROM ins WHERE o % 11 > 0 AND o % 4 <> 0")
def usable_steps(spark, sf_dir):
    """Records to be ignored and those that copy an input give no edges; an output without id goes by its path."""
    same = F.array(F.struct(F.lit(0).alias("pos"), F.col("out_blob").alias("blob"), F.col("out_path").alias("path"), F.array().cast("array<string>").alias("has_cve"), F.array().cast("array<string>").alias("fixed_cve"), F.lit(None).cast("string").alias("prov_pkg")))
    records = _records(spark, sf_dir).withColumn("infiles", F.when(F.col("seq") % 4 == 0, F.concat(same, F.col("infiles"))).otherwise(F.col("infiles")))
    return dag.edges(records)


@query(f"WITH {_LOG_SQL} SELECT {_g('order', 'o % 100')} AS out_blob, in_blob, CAST(min(o) AS BIGINT) AS seq FROM ins GROUP BY o % 100, in_blob")
def merged_inputs(spark, sf_dir):
    records = _records(spark, sf_dir).withColumns({"out_blob": ident.gitoid_of_text(_c("order ", F.col("seq") % 100)), "ignore": F.lit(False)})
    return dag.merged_edges(dag.edges(records)).select("out_blob", "in_blob", "seq")


@query("SELECT CAST(o_orderkey AS BIGINT) + n * (1 + (SELECT max(o_orderkey) FROM orders)) AS seq, n AS log FROM orders, (SELECT unnest([0, 1]) AS n)")
def logs_one_after_another(spark, sf_dir):
    log = lambda n: _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.lit(n).alias("log"))
    return dag.concatenated_logs([log(0), log(1)])


@query(
    """SELECT CAST(o_orderkey AS VARCHAR) AS out_blob, coalesce('id ' || (SELECT min(x.o_orderkey) FROM orders x WHERE x.o_custkey = o.o_custkey AND x.o_orderkey > o.o_orderkey), 'c' || o_custkey) AS named FROM orders o"""
)
def output_aliases(spark, sf_dir):
    """Outputs without id go by the id under which their path is first used later on: here, a customer's next order."""
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), _c("c", F.col("o_custkey")).alias("out_path"))
    entry = F.array(F.struct(F.lit(0).alias("pos"), _c("id ", F.col("seq")).alias("blob"), F.col("out_path").alias("path")))
    found = dag.resolve_aliases(o.select("seq", "out_path", F.col("out_path").alias("out_blob"), entry.alias("infiles")))
    return found.select(F.col("seq").cast("string").alias("out_blob"), F.col("out_blob").alias("named"))


# ---- databases


@query("SELECT 'part ' || p_partkey AS blob, '/src/' || replace(p_name, ' ', '_') || '.c' AS file_path, 'CVE-2020-' || (p_size + 1000) AS cve, CASE p_partkey % 3 WHEN 0 THEN 'cve' WHEN 1 THEN 'fixed' ELSE 'no' END AS status FROM part")
def cve_database_file(spark, sf_dir):
    folder = scratch(spark, "db")
    sinks.write_json_db(sinks.cve_json(_part_status(spark, sf_dir)), folder, parts=1)
    return readers.read_cve_db(spark, folder)


@query(f"SELECT {_g('customer', 'c_custkey')} AS blob, 'bom ' || c_name AS bom_id FROM customer")
def doc_mapping_file(spark, sf_dir):
    """A mapping that is looked for where none is, and found where it falls back to."""
    rows = _t(spark, sf_dir, "customer").select(_named("customer", "c_custkey").alias("blob"), F.concat(F.lit('"bom '), "c_name", F.lit('"')).alias("json"))
    folder = scratch(spark, "mapping")
    sinks.write_json_db(rows, folder, parts=1)
    return readers.read_doc_mapping(spark, scratch(spark, "none"), folder)


@query("SELECT 'd' || doc_id AS path, coalesce(CASE WHEN doc_id % 2 = 0 THEN 'recorded' END, CASE WHEN doc_id % 3 = 0 THEN 'embedded' END) AS first, coalesce(CASE WHEN doc_id % 3 = 0 THEN 'embedded' END, CASE WHEN doc_id % 2 = 0 THEN 'recorded' END) AS second FROM documents")
def chosen_bom(spark, sf_dir):
    d = F.col("doc_id")
    own, inside = F.when(d % 2 == 0, F.lit("recorded")), F.when(d % 3 == 0, F.lit("embedded"))
    return _t(spark, sf_dir, "documents").select(_c("d", d).alias("path"), readers.chosen_bom(own, inside).alias("first"), readers.chosen_bom(own, inside, prefer_embedded=True).alias("second"))


@query(
    f"""WITH {_EDGES_SQL} SELECT out_blob AS blob, '/o/' || o AS file_path, string_agg(in_blob, ',' ORDER BY in_blob) AS tree, CASE WHEN o % 2 = 0 THEN 'cc ' || o END AS build_cmd FROM order_edges GROUP BY out_blob, o"""
)
def node_entries(spark, sf_dir):
    edge = _order_edges(spark, sf_dir)
    key = F.col("l_orderkey")
    none = F.array().cast("array<string>")
    node = _t(spark, sf_dir, "lineitem").select("l_orderkey").distinct().select(
        _named("order", "l_orderkey").alias("blob"), F.array(_c("/o/", key)).alias("file_paths"), F.when(key % 2 == 0, F.array(_c("cc ", key))).otherwise(none).alias("build_cmds"),
        none.alias("build_tools"), none.alias("pkg_infos"), F.lit(None).cast("string").alias("prune"),
    )
    entry = F.from_json("json", "file_path string, file_paths array<string>, hash_tree array<string>, build_cmd string")
    told = sinks.node_json(node, edge).select("blob", entry.alias("e"))
    return told.select("blob", "e.file_path", F.array_join("e.hash_tree", ",").alias("tree"), "e.build_cmd")


@query(f"WITH {_EDGES_SQL}, d AS (SELECT out_blob, 'gitoid:blob:sha1' || chr(10) || string_agg('blob ' || in_blob, chr(10) ORDER BY in_blob) || chr(10) AS doc FROM order_edges GROUP BY out_blob) SELECT DISTINCT {_gt('doc')} AS bom_id, doc FROM d")
def doc_store_table(spark, sf_dir):
    """A store that is written to twice has each document once."""
    docs = merkle.identify(_order_edges(spark, sf_dir), reuse_unary=False)
    folder = scratch(spark, "store")
    sinks.write_doc_store(docs.filter("bom_id < '8'"), folder)
    sinks.write_doc_store(docs, folder)
    return readers.read_doc_table(spark, folder)


_NATION_DOC = "'gitoid:blob:sha1' || chr(10) || string_agg('blob ' || sha1(n_name), chr(10) ORDER BY sha1(n_name)) || chr(10)"


@query(f"WITH d AS (SELECT {_NATION_DOC} AS doc FROM nation GROUP BY n_regionkey) SELECT {_gt('doc')} AS bom_id, doc FROM d")
def doc_store_files(spark, sf_dir):
    edge = _t(spark, sf_dir, "nation").select(_c("r", F.col("n_regionkey")).alias("out_blob"), F.sha1(F.col("n_name").cast("binary")).alias("in_blob"))
    folder = scratch(spark, "objects")
    # One file for each region.
    for r in merkle.identify(edge, reuse_unary=False).collect():
        _file(spark, f"{folder}/objects/{r['bom_id'][:2]}/{r['bom_id'][2:]}", r["doc"])
    _file(spark, f"{folder}/metadata/notes", "no document")
    return readers.read_doc_store(spark, folder)


@query(f"WITH {_EDGES_SQL}, b AS (SELECT out_blob, {_gt(chr(40) + chr(39) + 'gitoid:blob:sha1' + chr(39) + ' || chr(10) || string_agg(' + chr(39) + 'blob ' + chr(39) + ' || in_blob, chr(10) ORDER BY in_blob) || chr(10)' + chr(41))} AS bom_id FROM order_edges GROUP BY out_blob) SELECT DISTINCT bom_id, in_blob AS blob, CAST(NULL AS VARCHAR) AS child_bom FROM b JOIN order_edges USING (out_blob)")
def document_lines(spark, sf_dir):
    return merkle.bom_lines(merkle.identify(_order_edges(spark, sf_dir), reuse_unary=False))


# ---- vulnerability inputs


@query("SELECT 'CVE-2020-' || p_size AS cve, sha1('lo ' || p_partkey) AS lo_blob, sha1('hi ' || p_partkey) AS hi_blob FROM part WHERE p_partkey % 3 > 0")
def cve_ranges_file(spark, sf_dir):
    hashed = lambda k: F.sha1(_c(f"{k} ", F.col("p_partkey")).cast("binary"))
    key = F.col("p_partkey")
    line = F.concat(F.when(key % 3 == 0, F.lit("# ")).otherwise(F.lit("")), _c("CVE-2020-", F.col("p_size"), " "), hashed("lo"), F.lit("  "), hashed("hi"), F.when(key % 5 == 0, F.lit("\n\n")).otherwise(F.lit("")))
    return readers.read_cve_ranges(spark, _lines(_t(spark, sf_dir, "part"), line, "p_partkey", "ranges"))


@query("SELECT 'CVE-2019-' || n_nationkey AS cve, CASE n_nationkey % 2 WHEN 0 THEN 'Added' ELSE 'Fixed' END AS kind, sha1(n_name) AS commit, 'a/' || n_name || '.c,b.c' AS src_files FROM nation")
def cve_info_files(spark, sf_dir):
    folder = scratch(spark, "info")
    # One file for each nation.
    for r in _t(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.sha1(F.col("n_name").cast("binary")).alias("commit")).collect():
        kind = "Fixed" if r["n_nationkey"] % 2 else "Added"
        _file(spark, f"{folder}/{r['commit']}.yml", f"# note\n{kind}:\n  CVE-2019-{r['n_nationkey']}:\n    src_files: [\"a/{r['n_name']}.c\", b.c]\n")
    return readers.read_cve_info(spark, folder).withColumn("src_files", F.array_join("src_files", ","))


@query("SELECT 'CVE-2018-' || doc_id AS cve, 'Fixed' AS kind, 'c' || doc_id AS commit, source || '.c,' || lang || '.c' AS src_files FROM documents")
def cve_info_messages(spark, sf_dir):
    d = F.col("doc_id")
    note = _c("release ", d, "\n\nFixed:\n  CVE-2018-", d, ":\n    src_files:\n      - ", F.col("source"), ".c\n      - ", F.col("lang"), ".c\n")
    rows = _t(spark, sf_dir, "documents").select(_c("c", d).alias("commit"), note.alias("text"))
    return readers.cve_info_of_messages(rows).withColumn("src_files", F.array_join("src_files", ","))


@query(
    """SELECT 'CVE-2017-' || s_suppkey AS cve, 'src/f' || s_nationkey || '.c' AS src_file, 'cveadd' AS rule_type, 'word ' || s_suppkey || '|a,b' AS include, 'never' AS exclude FROM supplier
    UNION ALL SELECT 'CVE-2017-' || s_suppkey, 'src/f' || s_nationkey || '.c', 'cvefix', 'mended: ' || s_suppkey, '' FROM supplier"""
)
def cve_rules_file(spark, sf_dir):
    s = _t(spark, sf_dir, "supplier")
    head = _c("CVE-2017-", F.col("s_suppkey"), ":\n  src/f", F.col("s_nationkey"), ".c:\n    include:\n      - ")
    whole = lambda body: s.groupBy().agg(F.array_join(F.array_sort(F.collect_list(F.concat(head, body))), "\n").alias("value"))
    add, fix = scratch(spark, "rules"), scratch(spark, "rules")
    whole(F.concat(_c("word ", F.col("s_suppkey")), F.lit("\n      - any: [a, b]\n    exclude:\n      - never"))).write.text(add)
    whole(_c('"mended: ', F.col("s_suppkey"), '"')).write.text(fix)
    rules = readers.read_cve_rules(spark, add, fix)
    joined = lambda c: F.array_join(F.transform(c, lambda g: F.array_join(g, ",")), "|")
    return rules.select("cve", "src_file", "rule_type", joined("include").alias("include"), joined("exclude").alias("exclude"))


# ---- version control text


def _git_log(spark, sf_dir) -> DataFrame:
    """Customers' orders as commits, newest first: each replaces a file's content."""
    o = _t(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    hashed = lambda what, n: F.sha1(_c(f"{what} ", n).cast("binary"))
    raw = F.concat(F.lit(":100644 100644 "), hashed("old", k), F.lit(" "), hashed("new", k), F.lit(" "), F.when(k % 5 == 0, F.lit("R090")).otherwise(F.lit("M")), _c("\tsrc/f", F.col("o_custkey"), ".c"), F.when(k % 5 == 0, _c("\tsrc/g", F.col("o_custkey"), ".c")).otherwise(F.lit("")))
    line = F.concat(F.lit("commit "), hashed("commit", k), _c("\nAuthor: a\n\n    text ", k, "\n\n"), raw, F.lit("\n"))
    return readers.read_git_log(spark, _lines(o, line, "o_orderkey", "gitlog"))


_GIT_SQL = "SELECT sha1('commit ' || o_orderkey) AS commit, CASE WHEN o_orderkey % 5 = 0 THEN 'src/g' ELSE 'src/f' END || o_custkey || '.c' AS path, sha1('old ' || o_orderkey) AS src_blob, sha1('new ' || o_orderkey) AS dst_blob, CASE WHEN o_orderkey % 5 = 0 THEN 'R' ELSE 'M' END AS change FROM orders"


@query(_GIT_SQL)
def git_log_file(spark, sf_dir):
    return _git_log(spark, sf_dir).select("commit", "path", "src_blob", "dst_blob", "change")


@query(f"SELECT path, string_agg(dst_blob, ',' ORDER BY dst_blob) AS blobs, count(*) AS n FROM ({_GIT_SQL}) GROUP BY path")
def git_file_history(spark, sf_dir):
    return readers.file_history(_git_log(spark, sf_dir)).groupBy("path").agg(F.array_join(F.array_sort(F.collect_list("blob")), ",").alias("blobs"), F.count("ord").alias("n"))


@query("SELECT sha1(p_name) AS blob, CAST(p_size AS BIGINT) AS size, 'src/p ' || p_partkey || '.c' AS path FROM part WHERE p_partkey % 4 <> 0")
def git_tree_file(spark, sf_dir):
    key = F.col("p_partkey")
    line = F.concat(F.lit("100644 blob "), F.sha1(F.col("p_name").cast("binary")), _c("   ", F.col("p_size"), "\t"), F.when(key % 4 == 0, F.lit("src/.hidden")).otherwise(_c("src/p ", key, ".c")))
    return readers.read_git_tree(spark, _lines(_t(spark, sf_dir, "part"), line, "p_partkey", "tree"))


# ---- packages


@query("SELECT 'pkg' || p_partkey AS package, '1.' || p_size AS version, 'pool/' || p_brand AS directory, 'a.dsc ' || p_size || ',a.tar.xz ' || (p_size + 1) AS files FROM part")
def deb_sources_file(spark, sf_dir):
    size = F.col("p_size")
    line = F.concat(_c("Package: pkg", F.col("p_partkey"), "\nBinary: a,\n b\nVersion: 1.", size, "\nVersion: 9\nDirectory: pool/"), F.col("p_brand"), _c("\nFiles:\n 0a ", size, " a.dsc\n 0b ", size + 1, " a.tar.xz\nHomepage: x: y\n"))
    rows = readers.read_deb_sources(spark, _lines(_t(spark, sf_dir, "part"), line, "p_partkey", "sources"))
    return rows.withColumn("files", F.array_join(F.transform("files", lambda f: F.concat_ws(" ", f["name"], f["size"].cast("string"))), ","))


@query("SELECT n_name AS name, '1.' || n_regionkey AS version, 'https://d/' || n_name || ',git://e' AS locations FROM nation")
def recipe_files(spark, sf_dir):
    package = lambda name, where: F.struct(name.alias("name"), _c("1.", F.col("n_regionkey")).alias("versionInfo"), where.alias("downloadLocation"))
    listed = F.array(package(F.concat(F.lit("recipe-"), "n_name"), F.concat(F.lit("https://d/"), "n_name")), package(F.lit("x"), F.lit("NOASSERTION")), package(F.lit("y"), F.lit("git://e")), package(F.lit("z"), F.lit("git://e")))
    folder = scratch(spark, "recipes")
    _t(spark, sf_dir, "nation").select(F.to_json(F.struct(listed.alias("packages"))).alias("value"), "n_nationkey").write.partitionBy("n_nationkey").text(folder)
    return readers.read_recipes(spark, f"{folder}/*").select("name", "version", F.array_join("download_locations", ",").alias("locations"))


@query("SELECT 'egg' AS kind, n_name AS name, '2.' || n_nationkey AS version, '' AS patches FROM nation UNION ALL SELECT 'spec', n_name, '3.' || n_regionkey, n_name || '-3.' || n_regionkey || '.patch,b.patch' FROM nation")
def package_texts(spark, sf_dir):
    n = _t(spark, sf_dir, "nation")
    eggs, specs = scratch(spark, "eggs"), scratch(spark, "specs")
    n.select(_c("Metadata-Version: 2\nName: ", F.col("n_name"), "\nVersion: 2.", F.col("n_nationkey"), "\nSummary: s").alias("value"), "n_nationkey").write.partitionBy("n_nationkey").text(eggs)
    n.select(_c("Name: ", F.col("n_name"), "\nVersion:  3.", F.col("n_regionkey"), "\nRelease: 1\nPatch0: %{name}-%{version}.patch\nPatch1: b.patch\n%prep").alias("value"), "n_nationkey").write.partitionBy("n_nationkey").text(specs)
    egg = readers.read_egg_info(spark, f"{eggs}/*").select(F.lit("egg").alias("kind"), "name", "version", F.lit("").alias("patches"))
    return egg.unionByName(readers.read_rpm_spec(spark, f"{specs}/*").select(F.lit("spec").alias("kind"), "name", "version", F.array_join("patches", ",").alias("patches")))


@query("SELECT s_suppkey, s_name AS name, 's_suppkey ' || s_suppkey || chr(10) || 'last line' AS description FROM supplier")
def package_info_lines(spark, sf_dir):
    key = F.col("s_suppkey")
    lines = F.array(F.concat(F.lit("Name        : "), "s_name"), F.lit("Version: 1"), _c("Description : s_suppkey ", key), F.lit(""), F.lit("last line"))
    return _t(spark, sf_dir, "supplier").select("s_suppkey", text.info_field(lines, "Name").alias("name"), text.info_description(lines).alias("description"))


# ---- files and archives


@query(f"SELECT 'f' || n_nationkey AS name, {_gt('(n_name || chr(10))')} AS blob, CAST(strlen(n_name) + 1 AS BIGINT) AS size FROM nation")
def files_of_folder(spark, sf_dir):
    folder = scratch(spark, "files")
    for r in _t(spark, sf_dir, "nation").collect():
        _file(spark, f"{folder}/d{r['n_regionkey']}/f{r['n_nationkey']}", r["n_name"] + "\n")
    _file(spark, f"{folder}/empty", "")
    return readers.read_files(spark, folder).select(_tail("path").alias("name"), "blob", "size")


def _archive(kind: str, members: list[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    if kind == "zip":
        with zipfile.ZipFile(out, "w") as z:
            for name, data in members:
                z.writestr(name, data)
    elif kind == "ar":
        out.write(b"!<arch>\n")
        for name, data in members:
            out.write(f"{name + '/':<16}{0:<12}{0:<6}{0:<6}{644:<8}{len(data):<10}`\n".encode() + data + b"\n" * (len(data) % 2))
    else:
        with tarfile.open(fileobj=out, mode=kind) as t:
            for name, data in members:
                info = tarfile.TarInfo(name)
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
    return out.getvalue()


_KINDS = ("zip", "ar", "w", "w:gz", "w:xz")


@query(f"SELECT 'r' || n_regionkey AS archive, 'm' || n_nationkey AS path, {_gt('n_name')} AS blob, CAST(strlen(n_name) AS BIGINT) AS size, false AS broken FROM nation UNION ALL SELECT 'broken', NULL, NULL, NULL, true")
def archive_members(spark, sf_dir):
    """Each region's nations in an archive of another kind, and one that is none."""
    folder, regions = scratch(spark, "archives"), {}
    for r in _t(spark, sf_dir, "nation").collect():
        regions.setdefault(r["n_regionkey"], []).append((f"m{r['n_nationkey']}", r["n_name"].encode()))
    for k, members in regions.items():
        _file(spark, f"{folder}/r{k}", _archive(_KINDS[k % len(_KINDS)], members))
    _file(spark, f"{folder}/broken", b"PK\x03\x04 no archive")
    return readers.expand_archives(spark, folder).select(_tail("archive").alias("archive"), "path", "blob", "size", F.col("error").isNotNull().alias("broken"))


@query("SELECT 'hi' || n_nationkey AS name, '1-' || n_regionkey AS version, 'amd64' AS arch, 'deb' AS pkg_type FROM nation")
def package_headers(spark, sf_dir):
    folder = scratch(spark, "debs")
    for r in _t(spark, sf_dir, "nation").collect():
        control = f"Package: hi{r['n_nationkey']}\nVersion: 1-{r['n_regionkey']}\nArchitecture: amd64\n".encode()
        _file(spark, f"{folder}/p{r['n_nationkey']}.deb", _archive("ar", [("debian-binary", b"2.0\n"), ("control.tar.gz", _archive("w:gz", [("./control", control)])), ("data.tar.xz", _archive("w:xz", [("./a", b"x")]))]))
    return readers.read_package_headers(spark, folder).select("name", "version", "arch", "pkg_type")


@query("SELECT 'f' || n_nationkey AS name, CASE WHEN n_nationkey % 3 = 0 THEN sha1(n_name) END AS bom_id FROM nation")
def embedded_ids(spark, sf_dir):
    folder = scratch(spark, "elf")
    note = ident.embedded_note(F.sha1(F.col("n_name").cast("binary")), F.sha2(F.col("n_name").cast("binary"), 256), "TESTER")
    for r in _t(spark, sf_dir, "nation").select("n_nationkey", note.alias("note")).collect():
        _file(spark, f"{folder}/f{r['n_nationkey']}", b"\x7fELF head" + (bytes(r["note"]) if r["n_nationkey"] % 3 == 0 else b"") + b"tail")
    return readers.read_embedded_ids(spark, folder, "TESTER").select(_tail("path").alias("name"), "bom_id")


@query("SELECT p_partkey, sha1(p_name) AS one, sha256(p_name) AS two, CAST(NULL AS VARCHAR) AS other FROM part")
def note_payload(spark, sf_dir):
    raw = F.col("p_name").cast("binary")
    note = F.concat(F.lit(b"head"), ident.embedded_note(F.sha1(raw), F.sha2(raw, 256), "OWNER"))
    return _t(spark, sf_dir, "part").select("p_partkey", ident.read_embedded_note(note, "OWNER").alias("one"), ident.read_embedded_note(note, "OWNER", "sha256").alias("two"), ident.read_embedded_note(note, "ELSE!").alias("other"))


@query("SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'elf' WHEN 1 THEN 'archive' WHEN 2 THEN 'zip' WHEN 3 THEN 'script' WHEN 4 THEN 'image' ELSE 'other' END AS kind, CASE p_partkey % 6 WHEN 0 THEN 'BINARY' WHEN 1 THEN 'ARCHIVE' WHEN 2 THEN 'ARCHIVE' WHEN 3 THEN 'SOURCE' WHEN 4 THEN 'IMAGE' ELSE CASE WHEN p_size % 2 = 0 THEN 'SOURCE' ELSE 'TEXT' END END AS spdx, p_size % 2 = 0 AS is_c, p_partkey % 2 = 0 AS regular FROM part")
def file_kinds(spark, sf_dir):
    key = F.col("p_partkey")
    marks = [b"\x7fELF\x02\x01", b"!<arch>\nx", b"PK\x03\x04", b"#!/bin/sh", b"\x89PNG\r\n"]
    head = F.lit(b"plain words")
    for k, mark in enumerate(marks):
        head = F.when(key % 6 == k, F.lit(mark)).otherwise(head)
    path = F.when(F.col("p_size") % 2 == 0, _c("/a.b/p", key, ".cpp")).otherwise(_c("/a.c/p", key))
    mode = F.when(key % 2 == 0, F.lit(0o100644)).otherwise(F.lit(0o120777))
    return _t(spark, sf_dir, "part").select("p_partkey", text.file_kind(head).alias("kind"), text.spdx_file_type(path, head).alias("spdx"), text.is_c_source(path).alias("is_c"), text.is_regular_mode(mode).alias("regular"))


# ---- traces and printed output


@query(
    """SELECT CAST(o_orderkey % 1000 AS VARCHAR) AS pid, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey AS VARCHAR) END AS child, CASE WHEN o_orderkey % 2 = 1 THEN '/bin/c' || o_orderkey % 7 END AS prog, CASE WHEN o_orderkey % 2 = 1 THEN 'cc o' || o_orderkey ELSE '' END AS argv FROM orders WHERE o_orderkey % 9 > 0"""
)
def strace_file(spark, sf_dir):
    k = F.col("o_orderkey")
    call = F.when(k % 2 == 0, F.lit("vfork()")).otherwise(_c('execve("/bin/c', k % 7, '", ["cc", "o', k, '"], 0x7 /* 3 vars */)'))
    result = F.when(k % 9 == 0, F.lit("-1 ENOENT (none)")).when(k % 2 == 0, k.cast("string")).otherwise(F.lit("0"))
    folder = _lines(_t(spark, sf_dir, "orders"), F.concat(_c(k % 1000, " "), call, F.lit(" = "), result), "o_orderkey", "strace")
    return readers.read_strace(spark, folder).select("pid", "child", "prog", F.coalesce("argv", F.lit("")).alias("argv"))


@query("SELECT '/o/C' || o_orderkey || '.class' AS class_path, '/s/C' || max(CASE WHEN o_orderkey % 4 > 0 THEN NULL ELSE o_orderkey END) OVER (ORDER BY o_orderkey) || '.java' AS java_path FROM orders QUALIFY o_orderkey % 4 > 0")
def class_access_file(spark, sf_dir):
    """One process that reads a source and then writes the classes of it."""
    k = F.col("o_orderkey")
    line = F.when(k % 4 == 0, _c('5 openat(AT_FDCWD, "/s/C', k, '.java", O_RDONLY) = 3')).otherwise(_c('5 openat(AT_FDCWD, "/o/C', k, '.class", O_WRONLY|O_CREAT) = 4'))
    return readers.class_steps(readers.read_class_access(spark, _lines(_t(spark, sf_dir, "orders"), line, "o_orderkey", "access")))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS pid, '/w/' || n_name AS pwd, '/root' AS rootdir, '/usr/bin/cc' AS prog, 'cc -c ' || n_name || '.c' || chr(10) || 'more' AS argv FROM nation")
def shell_command_files(spark, sf_dir):
    folder = scratch(spark, "commands")
    name = F.col("n_name")
    value = _c("pid: ", F.col("n_nationkey"), " ppid: 1\npwd: /w/", name, " /root\n/usr/bin/cc\ncc -c ", name, ".c\nmore")
    _t(spark, sf_dir, "nation").select(value.alias("value"), "n_nationkey").write.partitionBy("n_nationkey").text(folder)
    return readers.read_shell_commands(spark, f"{folder}/*").select("pid", "pwd", "rootdir", "prog", "argv")


@query("SELECT CASE WHEN n_nationkey % 2 = 0 THEN n_name || '.o' END AS target, n_name || '.c,/usr/' || n_name || '.h' AS depends FROM nation")
def depend_files(spark, sf_dir):
    folder, name = scratch(spark, "depends"), F.col("n_name")
    rule = _c(name, ".o: ", name, ".c \\\n  /usr/", name, ".h\n\n/usr/", name, ".h:")
    dot = _c('digraph "d" {\n h1 [ label="', name, '.c"];\n h2 [ label="/usr/', name, '.h"];\n h1 -> h2\n}')
    _t(spark, sf_dir, "nation").select(F.when(F.col("n_nationkey") % 2 == 0, rule).otherwise(dot).alias("value"), "n_nationkey").write.partitionBy("n_nationkey").text(folder)
    return readers.read_depend_files(spark, f"{folder}/*").select("target", F.array_join("depends", ",").alias("depends"))


@query("SELECT 'lib' || p_partkey || '.so' AS soname, '/lib' || (p_partkey // 10) || '/lib' || p_partkey || '.so.1' AS path FROM part")
def library_cache_file(spark, sf_dir):
    k = F.col("p_partkey")
    head = F.when((k % 10 == 0) | (k == F.min("p_partkey").over(Window.partitionBy(F.expr("p_partkey div 10")))), _c("/lib", F.expr("p_partkey div 10"), ": (from /etc/ld.so.conf)\n")).otherwise(F.lit(""))
    line = F.concat(head, _c("\tlib", k, ".so -> lib", k, ".so.1"))
    return readers.read_library_cache(spark, _lines(_t(spark, sf_dir, "part").withColumn("line", line), F.col("line"), "p_partkey", "cache"))


@query("SELECT 'libc.so.6,lib' || n_name || '.so' AS needed, '/x/' || n_name AS rpath FROM nation")
def dynamic_section_files(spark, sf_dir):
    folder = scratch(spark, "dynamic")
    value = _c(" 0x1 (NEEDED)  Shared library: [libc.so.6]\n 0x1 (NEEDED) Shared library: [lib", F.col("n_name"), ".so]\n 0xf (RUNPATH) Library runpath: [/x/", F.col("n_name"), "]\n")
    _t(spark, sf_dir, "nation").select(value.alias("value"), "n_nationkey").write.partitionBy("n_nationkey").text(folder)
    return readers.read_dynamic_sections(spark, f"{folder}/*").select(F.array_join("needed", ",").alias("needed"), F.array_join("rpath", ",").alias("rpath"))


@query("SELECT n_name || '/src/x.c,' || n_name || '/gone.c' AS targets FROM nation")
def patch_files(spark, sf_dir):
    folder, name = scratch(spark, "patches"), F.col("n_name")
    value = _c("--- a/", name, "/src/x.c\t2020\n+++ b/", name, "/src/x.c\n@@ -1 +1 @@\n-a\n+b\n--- a/", name, "/gone.c\n+++ /dev/null\n")
    _t(spark, sf_dir, "nation").select(value.alias("value"), "n_nationkey").write.partitionBy("n_nationkey").text(folder)
    return readers.read_patches(spark, f"{folder}/*").select(F.array_join("targets", ",").alias("targets"))


@query(
    """SELECT '/p/m' || p_partkey || '.py' AS path, unnest(['os', 'm' || p_size, 'm' || p_size || '.f', 'near' || p_size, 'fast']) AS module, unnest([1, 2, 2, 3, 5]) AS lineno, unnest([0, 0, 0, 1, 0]) AS level, unnest([false, false, false, false, true]) AS in_except FROM part"""
)
def python_imports(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    source = _c("import os\nfrom m", s, " import f\nfrom . import near", s, "\ntry:\n    import fast\nexcept ImportError:\n    fast = None\n")
    return readers.python_imports(_t(spark, sf_dir, "part").select(_c("/p/m", k, ".py").alias("path"), source.alias("text")))


@query(
    """WITH RECURSIVE up AS (SELECT p_partkey AS c, p_partkey // 2 AS p FROM part WHERE p_partkey > 1 AND p_partkey // 2 IN (SELECT p_partkey FROM part)), reach AS (SELECT p_partkey AS r, p_partkey AS b, 0 AS d FROM part UNION SELECT r, p, d + 1 FROM reach JOIN up ON c = b)
    SELECT '/p/m' || r || '.py' AS root, count(*) AS n, max(d) AS depth FROM reach GROUP BY r"""
)
def import_closure(spark, sf_dir):
    k = F.col("p_partkey")
    files = _t(spark, sf_dir, "part").select(_c("/p/m", k, ".py").alias("path"), F.when(k > 1, _c("from . import m", F.expr("p_partkey div 2"), "\n")).otherwise(F.lit("import os\n")).alias("text"))
    closed = matching.import_closure(readers.python_imports(files), files, files.select(F.col("path").alias("root")))
    return closed.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("depth"))


@query("SELECT 'C' || p_partkey || '.class' AS path, 'x/C' || p_partkey AS class_name, 'C' || p_partkey || '.java' AS source_file FROM part")
def class_constants(spark, sf_dir):
    name = _c("C", F.col("p_partkey"))
    two = lambda n: F.unhex(F.lpad(F.hex(n), 4, "0")) if not isinstance(n, int) else F.lit(n.to_bytes(2, "big"))
    word = lambda v: F.concat(F.lit(b"\x01"), two(F.octet_length(v)), v.cast("binary"))
    pool = F.concat(*[word(v) for v in (F.concat(F.lit("x/"), name), F.lit("java/lang/Object"), F.lit("SourceFile"), F.concat(name, F.lit(".java")))], F.lit(b"\x07\0\x01\x07\0\x02"))
    raw = F.concat(F.lit(b"\xca\xfe\xba\xbe\0\0\0\x34\0\x07"), pool, F.lit(b"\0\x01\0\x05\0\x06\0\0\0\0\0\0\0\x01\0\x03\0\0\0\x02\0\x04"))
    return readers.class_files(_t(spark, sf_dir, "part").select(F.concat(name, F.lit(".class")).alias("path"), raw.alias("content")))


@query("SELECT '/o/org/a' || p_size || '/C' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '$1' ELSE '' END || '.class' AS class_path, '/o/org/a' || p_size || '/C' || p_partkey || '.java' AS source_path FROM part")
def class_sources(spark, sf_dir):
    """Of the two sources of a class's name, the one whose folders are more alike."""
    k = F.col("p_partkey")
    classes = _t(spark, sf_dir, "part").select(_c("/o/org/a", F.col("p_size"), "/C", k, F.when(k % 3 == 0, F.lit("$1")).otherwise(F.lit("")), ".class").alias("path"))
    own = _t(spark, sf_dir, "part").select(_c("/o/org/a", F.col("p_size"), "/C", k, ".java").alias("path"))
    return matching.class_sources(classes, own.unionByName(_t(spark, sf_dir, "part").select(_c("/a/else/C", k, ".java").alias("path"))))


# ---- process trees


def _spawns(spark, sf_dir) -> DataFrame:
    """A conversation is a process number that each turn forks the next one from."""
    turns = _t(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    w = Window.partitionBy("conv_id").orderBy("turn")
    number = F.col("conv_id") * 100 + F.col("turn")
    return turns.select(number.alias("line_no"), number.cast("string").alias("pid"), F.lag(number).over(w).cast("string").alias("parent"))


@query(
    """WITH t AS (SELECT DISTINCT conv_id, turn, conv_id * 100 + turn AS n FROM conversations)
    SELECT n || '@' || n AS proc, lag(n || '@' || n) OVER (PARTITION BY conv_id ORDER BY turn) AS parent_proc, CAST(n AS BIGINT) AS line_no, CAST(n AS VARCHAR) AS pid FROM t"""
)
def named_processes(spark, sf_dir):
    return processes.named_processes(_spawns(spark, sf_dir))


_TURNS_SQL = "t AS (SELECT DISTINCT conv_id, turn, conv_id * 100 + turn AS n FROM conversations), w AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS d, min(n) OVER (PARTITION BY conv_id) AS r FROM t)"


@query(f"WITH {_TURNS_SQL} SELECT r || '@' || r AS root, count(*) AS n_processes, CAST(max(d) AS INTEGER) AS max_depth FROM w GROUP BY r")
def process_tree_summary(spark, sf_dir):
    return processes.tree_summary(processes.depths(processes.named_processes(_spawns(spark, sf_dir))))


@query(f"WITH {_TURNS_SQL} SELECT CAST(n AS BIGINT) AS line_no, repeat('  ', CAST(d AS INTEGER)) || 'line ' || n AS text FROM w")
def indented_log(spark, sf_dir):
    named = materialise(processes.named_processes(_spawns(spark, sf_dir)), "named")
    lines = _spawns(spark, sf_dir).select("line_no", "pid", _c("line ", F.col("line_no")).alias("raw"))
    return processes.indented(lines, named.select("pid", "line_no", "proc"), processes.depths(named))


@query(f"WITH {_TURNS_SQL} SELECT r || '@' || r AS root, string_agg(repeat('  ', CAST(d AS INTEGER)) || n || '@' || n || ' cc', chr(10) ORDER BY d) AS tree FROM w GROUP BY r")
def command_trees(spark, sf_dir):
    named = materialise(processes.named_processes(_spawns(spark, sf_dir)), "named")
    return processes.command_trees(named.withColumn("prog", F.lit("cc")), processes.depths(named))


# ---- command lines

#: A line of each family over a number ``{k}``, with what it makes and from what.
_COMMANDS = [
    ("/usr/bin/gcc", "gcc -c -O2 -I inc src/a{k}.c", "cc", "/w/a{k}.o", "/w/src/a{k}.c"),
    ("/usr/bin/ld", "ld -m elf_x86_64 -o app{k} crt1.o m{k}.o -lc", "ld", "/w/app{k}", "/w/crt1.o,/w/m{k}.o"),
    ("rustc", "rustc --crate-name r{k} --crate-type lib --out-dir out s{k}.rs", "rustc", "/w/out/libr{k}.rlib", "/w/s{k}.rs"),
    ("/go/tool/compile", "compile -o g{k}.a -p main g{k}.go", "go", "/w/g{k}.a", "/w/g{k}.go"),
    ("javac", "javac -d out J{k}.java", "javac", "/w/out/J{k}.class", "/w/J{k}.java"),
    ("jar", "jar cf j{k}.jar A{k}.class B.class", "jar", "/w/j{k}.jar", "/w/A{k}.class,/w/B.class"),
    ("ar", "ar rcs l{k}.a x{k}.o y.o", "ar", "/w/l{k}.a", "/w/x{k}.o,/w/y.o"),
    ("strip", "strip -g t{k}", "strip", "/w/t{k}", "/w/t{k}"),
    ("objcopy", "objcopy -O binary v{k} b{k}", "objcopy", "/w/b{k}", "/w/v{k}"),
    ("install", "install -m 644 i{k} c{k} dir", "install", "/w/dir/i{k},/w/dir/c{k}", "/w/i{k},/w/c{k}"),
    ("patch", "patch -i p{k}.diff q{k}.c", "patch", "/w/q{k}.c", "/w/q{k}.c,/w/p{k}.diff"),
    ("dpkg-deb", "dpkg-deb -b tree{k} d{k}.deb", "package", "/w/d{k}.deb", "/w/tree{k}"),
    ("ranlib", "ranlib z{k}.a", "same", "/w/z{k}.a", "/w/z{k}.a"),
    ("sign-file", "sign-file sha1 key cert mod{k}.ko", "sign-file", "/w/mod{k}.ko", "/w/mod{k}.ko"),
    ("build", "build setup{k}.bin vmlinux{k} bzImage", "bzimage", "/w/bzImage", "/w/setup{k}.bin,/w/vmlinux{k}"),
    ("ls", "ls -l {k}", "", "", ""),
]


def _command_lines(spark, sf_dir) -> DataFrame:
    key = F.col("p_partkey")
    filled = lambda n: F.replace(F.element_at(F.array(*[F.lit(c[n]) for c in _COMMANDS]), (key % len(_COMMANDS) + 1).cast("int")), F.lit("{k}"), key.cast("string"))
    return _t(spark, sf_dir, "part").select(key.alias("cmd_id"), key.cast("string").alias("pid"), F.lit("/w").alias("pwd"), F.lit("").alias("rootdir"), filled(0).alias("prog"), filled(1).alias("argv"))


def _listed(n: int) -> str:
    return f"replace(list_extract([{', '.join(repr(c[n]) for c in _COMMANDS)}], CAST(p_partkey % {len(_COMMANDS)} + 1 AS INTEGER)), '{{k}}', CAST(p_partkey AS VARCHAR))"


_FAMILY_SQL = f"SELECT p_partkey AS cmd_id, {_listed(2)} AS family, {_listed(3)} AS outputs, {_listed(4)} AS inputs FROM part WHERE p_partkey % {len(_COMMANDS)} <> {len(_COMMANDS) - 1}"


def _families(files: DataFrame) -> DataFrame:
    of = lambda role: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("pos", "path")))), lambda f: f["path"]), ",")
    return files.groupBy("cmd_id", "family").agg(of("out").alias("outputs"), of("in").alias("inputs"))


@query(_FAMILY_SQL)
def command_families(spark, sf_dir):
    return _families(commands.command_files(_command_lines(spark, sf_dir)))


@query(_FAMILY_SQL)
def command_stream(spark, sf_dir):
    """The same lines, read as a stream of files."""
    folder, out, at = (scratch(spark, t) for t in ("lines", "parsed", "progress"))
    lines = _command_lines(spark, sf_dir)
    lines.write.parquet(folder)
    stream = spark.readStream.schema(lines.schema).parquet(folder)
    commands.command_files(stream).writeStream.format("parquet").option("checkpointLocation", at).trigger(availableNow=True).start(out).awaitTermination()
    return _families(spark.read.schema("cmd_id long, family string, role string, pos int, path string").parquet(out))


@query("SELECT p_partkey AS cmd_id, '/w/o' || p_partkey || '.c' AS out_path, '/w/o' || p_partkey || '.c,/w/x' || p_partkey || '.diff' AS inputs FROM part")
def patched_records(spark, sf_dir):
    """Files that only the patch itself names."""
    k = F.col("p_partkey")
    rows = _t(spark, sf_dir, "part")
    lines = rows.select(k.alias("cmd_id"), F.lit("1").alias("pid"), F.lit("/w").alias("pwd"), F.lit("").alias("rootdir"), F.lit("patch").alias("prog"), _c("patch -p1 -i x", k, ".diff").alias("argv"))
    patches = rows.select(_c("/w/x", k, ".diff").alias("file"), F.array(_c("a/o", k, ".c")).alias("targets"))
    catalog = rows.select(_c("/w/o", k, ".c").alias("path"), _c("o", k).alias("blob")).union(rows.select(_c("/w/x", k, ".diff"), _c("x", k)))
    made = commands.command_records(lines, catalog, listed=commands.patched_files(lines, patches))
    return made.select(F.regexp_extract("build_cmd", r"x(\d+)\.", 1).cast("long").alias("cmd_id"), "out_path", F.array_join(F.transform("infiles", lambda f: f["path"]), ",").alias("inputs"))


@query("SELECT p_partkey AS cmd_id, CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS BIGINT) AS seq, '/w/g.go,/w/h' || p_size || '.h,/go/fmt' || p_partkey || '.a' AS inputs FROM part")
def imported_records(spark, sf_dir):
    """Packages that only the import table names, beside a header of a dependency file and words of an argument file."""
    k = F.col("p_partkey")
    rows = _t(spark, sf_dir, "part")
    lines = rows.select(k.alias("cmd_id"), F.lit("1").alias("pid"), F.lit("/w").alias("pwd"), F.lit("").alias("rootdir"), F.lit("/go/compile").alias("prog"), _c("compile -o g", k, ".a -importcfg cfg", k, " @args").alias("argv"))
    lines = commands.with_responses(lines, spark.createDataFrame([("/w/args", "-p main\ng.go\n")], "path string, text string"))
    tables = rows.select(_c("/w/cfg", k).alias("file"), _c("# import config\npackagefile fmt=/go/fmt", k, ".a").alias("text"))
    names = rows.select(F.explode(F.array(_c("/w/g", k, ".a"), _c("/go/fmt", k, ".a"), _c("/w/h", F.col("p_size"), ".h"), F.lit("/w/g.go"))).alias("path")).distinct()
    headers = rows.select(k.alias("cmd_id"), _c("/w/h", F.col("p_size"), ".h").alias("path"))
    made = commands.command_records(lines, names.withColumn("blob", F.col("path")), headers, commands.imported_files(lines, tables))
    order = F.transform(F.array_sort(F.transform("infiles", lambda f: F.struct(F.startswith(f["path"], F.lit("/go")).alias("g"), f["path"].alias("path")))), lambda f: f["path"])
    return made.select(F.regexp_extract("build_cmd", r"cfg(\d+)", 1).cast("long").alias("cmd_id"), "seq", F.array_join(order, ",").alias("inputs"))


@query("SELECT p_partkey AS cmd_id FROM part WHERE p_partkey % 16 IN (0, 4, 9, 11)")
def watched_commands(spark, sf_dir):
    listed = commands.read_watch_list("# list\n/usr/bin/gcc\n-deb\n\njavac\ninstall\n---\nstrip\n===\nconfigure\n+++\nrpmbuild\n")
    assert listed["pre_exec"] == ["strip"] and listed["detach"] == ["configure"] and listed["umbrella"] == ["rpmbuild"]
    return commands.watched(_command_lines(spark, sf_dir), listed["watched"]).select("cmd_id")


# ---- streams


@query(f"WITH {_LOG_SQL} SELECT out_blob, in_blob FROM ins WHERE o % 11 > 0")
def ingested_edges(spark, sf_dir):
    """A folder of logs, taken in two goes: the second reads what is new only."""
    folder, out, at = (scratch(spark, t) for t in ("logs", "ingested", "progress"))
    records = _records(spark, sf_dir)
    for n in (0, 1):
        with lean_writes(spark):
            records.filter(F.col("seq") % 2 == n).select(rawlog.stanza_text().alias("value")).write.mode("append").text(folder, compression="gzip")
        pipelines.ingest(spark, folder, out, at).awaitTermination()
    return spark.read.schema("out_blob string, in_blob string, seq long, pos int").parquet(f"{out}/edges/*").select("out_blob", "in_blob")


_PAIRS_SQL = """WITH own AS (SELECT user_id, event_id, event_type, lag(event_id) OVER w AS before_order, lag(event_type) OVER w AS k FROM events WHERE event_type IN ('view', 'click') WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
    SELECT user_id AS key, before_order, event_id AS after_order FROM own WHERE event_type = 'click' AND k = 'view'"""


@query(_PAIRS_SQL)
def paired_stream(spark, sf_dir):
    """Pairs over a stream with keyed state; all rows come in one go, since files have no order of their own."""
    out, at = scratch(spark, "pairs"), scratch(spark, "progress")
    rows = _t(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("order"), F.col("event_type").alias("kind"))
    folder = scratch(spark, "events")
    rows.coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(rows.schema).parquet(folder)
    pipelines.pair_stream(stream, "view", "click").writeStream.format("parquet").outputMode("append").option("checkpointLocation", at).trigger(once=True).start(out).awaitTermination(600)
    return spark.read.schema("key long, before_order long, after_order long").parquet(out)


@query(_PAIRS_SQL)
def paired_batches(spark, sf_dir):
    out, at, folder = scratch(spark, "pairs"), scratch(spark, "progress"), scratch(spark, "events")
    rows = _t(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("order"), F.col("event_type").alias("kind"))
    rows.coalesce(1).write.parquet(folder)
    pipelines.pair_micro_batches(spark.readStream.schema(rows.schema).parquet(folder), "view", "click", out, at).awaitTermination()
    return spark.read.parquet(f"{out}/pairs/*").select(F.col("key"), "before_order", "after_order")



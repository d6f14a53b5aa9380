"""Each operator applied to a supplied table, and the same in SQL.

The supplied tables hold no provenance, so customers are built from orders and
orders from parts, documents are file contents, their sources packages, page
addresses paths, events logs and conversations chains of processes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stemma.functions import ident, text
from stemma.operators import closure, cvedb, dag, matching, merkle, packages, processes, spdx
from stemma.plans.storage import materialise, read_table
from stemma.sources import commands, rawlog, readers, schemas, sinks
from stemma.streaming import pipelines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its own name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _t(spark, sf_dir, name):
    return read_table(spark, sf_dir, name)


def _named(kind: str, key) -> object:
    return ident.gitoid_of_text(F.concat(F.lit(f"{kind} "), F.col(key).cast("string") if isinstance(key, str) else key))


def _g(kind: str, key: str) -> str:
    """SQL of ``_named``."""
    return _gt(f"('{kind} ' || {key})")


def _gt(value: str) -> str:
    return f"sha1(encode('blob ' || strlen({value})) || '\\x00'::BLOB || encode({value}))"


def _order_edges(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct().select(_named("order", "l_orderkey").alias("out_blob"), _named("part", "l_partkey").alias("in_blob"))


def _customer_edges(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select(_named("customer", "o_custkey").alias("out_blob"), _named("order", "o_orderkey").alias("in_blob"))


def _graph(spark, sf_dir):
    return _order_edges(spark, sf_dir).unionByName(_customer_edges(spark, sf_dir))


_EDGES_SQL = f"""
order_edges AS (SELECT DISTINCT l_orderkey AS o, {_g('order', 'l_orderkey')} AS out_blob, {_g('part', 'l_partkey')} AS in_blob FROM lineitem),
customer_edges AS (SELECT o_custkey AS c, o_orderkey AS o, o_orderstatus AS s, {_g('customer', 'o_custkey')} AS out_blob, {_g('order', 'o_orderkey')} AS in_blob FROM orders)
"""


def _doc_sql(line: str) -> str:
    """SQL of a document's id from a line for each input."""
    body = f"('gitoid:blob:sha1' || chr(10) || string_agg(DISTINCT {line}, chr(10) ORDER BY {line}) || chr(10))"
    return _gt(body)


_MERKLE_SQL = f"""
WITH {_EDGES_SQL},
order_boms AS (SELECT out_blob AS blob, count(*) AS n, {_doc_sql("'blob ' || in_blob")} AS bom FROM order_edges GROUP BY out_blob),
lines AS (
  SELECT e.out_blob, e.in_blob, {{bare}} AS bom FROM customer_edges e LEFT JOIN order_boms b ON b.blob = e.in_blob
),
customer_boms AS (
  SELECT out_blob AS blob, {{reuse}} AS bom
  FROM lines GROUP BY out_blob
)
SELECT blob, bom AS bom_id FROM order_boms UNION ALL SELECT blob, bom FROM customer_boms
"""
_FULL_LINE = "'blob ' || in_blob || coalesce(' bom ' || bom, '')"


@query(f"SELECT doc_id, {_gt('text')} AS blob FROM documents")
def gitoid_sha1(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", ident.gitoid_of_text(F.col("text")).alias("blob"))


@query(f"SELECT doc_id, {_gt('text').replace('sha1(', 'sha256(', 1)} AS blob FROM documents")
def gitoid_sha256(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", ident.gitoid_of_text(F.col("text"), "sha256").alias("blob"))


@query(f"WITH {_EDGES_SQL} SELECT out_blob, {_doc_sql(chr(39) + 'blob ' + chr(39) + ' || in_blob')} AS bom_id, count(*) AS n_inputs FROM order_edges GROUP BY out_blob")
def bomdoc_orders(spark, sf_dir):
    line = ident.doc_line(F.col("in_blob"), F.lit(None).cast("string"))
    return _order_edges(spark, sf_dir).groupBy("out_blob").agg(ident.bom_id(F.collect_set(line)).alias("bom_id"), F.count(F.lit(1)).alias("n_inputs"))


def _ids(df):
    return df.select("blob", "bom_id")


def _last_ids(ids):
    """What a log read to its end leaves; identifiers are dealt as bytes."""
    last = ids.groupBy(ident.packed(F.col("blob")).alias("blob")).agg(F.max_by(ident.packed(F.col("bom_id")), "seq").alias("bom_id"))
    return last.select(ident.unpacked(F.col("blob")).alias("blob"), ident.unpacked(F.col("bom_id")).alias("bom_id"))


@query(_MERKLE_SQL.format(bare="b.bom", reuse=_doc_sql(_FULL_LINE)))
def merkle_customer(spark, sf_dir):
    return _ids(merkle.identify(_graph(spark, sf_dir), reuse_unary=False, docs=False))


@query(_MERKLE_SQL.format(bare="b.bom", reuse=f"CASE WHEN count(*) = 1 AND max(bom) IS NOT NULL THEN max(bom) ELSE {_doc_sql(_FULL_LINE)} END"))
def merkle_customer_unary(spark, sf_dir):
    return _ids(merkle.identify(_graph(spark, sf_dir), docs=False))


@query(_MERKLE_SQL.format(bare="CASE WHEN e.s <> 'F' THEN b.bom END", reuse=f"CASE WHEN count(*) = 1 AND max(bom) IS NOT NULL THEN max(bom) ELSE {_doc_sql(_FULL_LINE)} END"))
def merkle_pruned(spark, sf_dir):
    graph = _graph(spark, sf_dir)
    wanted = _t(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(_named("order", "o_orderkey").alias("blob"))
    return _ids(merkle.identify(graph, merkle.prune(wanted.limit(0), graph, wanted), docs=False))


@query(_MERKLE_SQL.format(bare="b.bom", reuse=_doc_sql(_FULL_LINE)))
def merkle_log_order(spark, sf_dir):
    """A log that builds every order before any customer: its ids are those of the whole graph."""
    orders = _order_edges(spark, sf_dir).withColumn("seq", F.lit(1).cast("long"))
    log = orders.unionByName(_customer_edges(spark, sf_dir).withColumn("seq", F.lit(2).cast("long")))
    ids = merkle.identify_in_log_order(log, reuse_unary=False)
    return _last_ids(ids)


@query(
    f"""WITH {_EDGES_SQL},
    order_boms AS (SELECT out_blob AS blob, {_doc_sql("'blob ' || in_blob")} AS bom FROM order_edges GROUP BY out_blob),
    customer_boms AS (SELECT out_blob AS blob, {_doc_sql("'blob ' || in_blob")} AS bom FROM customer_edges GROUP BY out_blob)
    SELECT blob, bom AS bom_id FROM order_boms UNION ALL SELECT blob, bom FROM customer_boms"""
)
def merkle_log_late(spark, sf_dir):
    """The same log the other way round: no input is known yet when it is used."""
    log = _customer_edges(spark, sf_dir).withColumn("seq", F.lit(1).cast("long")).unionByName(_order_edges(spark, sf_dir).withColumn("seq", F.lit(2).cast("long")))
    ids = merkle.identify_in_log_order(log, reuse_unary=False)
    return _last_ids(ids)


@query(
    f"""WITH {_EDGES_SQL}, leaves AS (SELECT DISTINCT c.out_blob AS root, coalesce(o.in_blob, c.in_blob) AS blob FROM customer_edges c LEFT JOIN order_edges o ON o.o = c.o)
    SELECT root, {_doc_sql("'blob ' || blob")} AS bom_id, CAST(count(*) AS INTEGER) AS n_leaves FROM leaves GROUP BY root"""
)
def collapse_customer(spark, sf_dir):
    graph = _graph(spark, sf_dir)
    closed = closure.closure(graph, _customer_edges(spark, sf_dir).select(F.col("out_blob").alias("root")))
    return merkle.collapse(closure.leaves(closed, graph))


@query(f"SELECT DISTINCT {_g('part', 'l_partkey')} AS in_blob, {_g('order', 'l_orderkey')} AS out_blob FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand = 'Brand#1'")
def parents_of_part(spark, sf_dir):
    wanted = _t(spark, sf_dir, "part").filter("p_brand = 'Brand#1'").select(_named("part", "p_partkey").alias("blob"))
    return closure.parents(_order_edges(spark, sf_dir), wanted)


@query(f"SELECT {_g('part', 'p_partkey')} AS blob, count(DISTINCT l_orderkey) AS n_parents FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey")
def parent_counts(spark, sf_dir):
    return closure.parent_counts(_order_edges(spark, sf_dir), _t(spark, sf_dir, "part").select(_named("part", "p_partkey").alias("blob")))


def _region_graph(spark, sf_dir):
    name = lambda kind, c: F.concat(F.lit(f"{kind} "), F.col(c).cast("string"))
    parts = [("region", "n_regionkey", "nation", "n_nationkey", "nation"), ("nation", "c_nationkey", "customer", "c_custkey", "customer"), ("customer", "o_custkey", "order", "o_orderkey", "orders"), ("order", "l_orderkey", "part", "l_partkey", "lineitem")]
    out = None
    for up, u, down, d, table in parts:
        edge = _t(spark, sf_dir, table).select(name(up, u).alias("out_blob"), name(down, d).alias("in_blob")).distinct()
        out = edge if out is None else out.unionByName(edge)
    return out


_REGION_SQL = """
links AS (
  SELECT DISTINCT 'region ' || n_regionkey AS a, 'nation ' || n_nationkey AS b FROM nation
  UNION SELECT DISTINCT 'nation ' || c_nationkey, 'customer ' || c_custkey FROM customer
  UNION SELECT DISTINCT 'customer ' || o_custkey, 'order ' || o_orderkey FROM orders
  UNION SELECT DISTINCT 'order ' || l_orderkey, 'part ' || l_partkey FROM lineitem
), reach AS (
  SELECT 'region ' || r_regionkey AS root, 'region ' || r_regionkey AS blob, 0 AS depth FROM region
  UNION SELECT root, b, depth + 1 FROM reach JOIN links ON a = blob
)
"""


def _regions(spark, sf_dir):
    return _t(spark, sf_dir, "region").select(F.concat(F.lit("region "), F.col("r_regionkey").cast("string")).alias("root"))


@query(f"WITH RECURSIVE {_REGION_SQL} SELECT root, depth, count(*) AS n_blobs, min(blob) AS first_blob FROM reach GROUP BY root, depth")
def closure_depth(spark, sf_dir):
    closed = closure.closure(_region_graph(spark, sf_dir), _regions(spark, sf_dir))
    return closed.groupBy("root", "depth").agg(F.count(F.lit(1)).alias("n_blobs"), F.min("blob").alias("first_blob"))


@query(f"WITH RECURSIVE {_REGION_SQL} SELECT root, count(*) AS n_leaves FROM reach WHERE blob NOT IN (SELECT a FROM links) GROUP BY root")
def closure_leaves(spark, sf_dir):
    graph = _region_graph(spark, sf_dir)
    return closure.leaves(closure.closure(graph, _regions(spark, sf_dir)), graph).groupBy("root").agg(F.count(F.lit(1)).alias("n_leaves"))


_STATUS = "CASE p_partkey % 3 WHEN 0 THEN 'cve' WHEN 1 THEN 'fixed' ELSE 'no' END"


def _part_status(spark, sf_dir):
    return _t(spark, sf_dir, "part").select(
        F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("blob"), F.concat(F.lit("/src/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".c")).alias("file_path"),
        F.concat(F.lit("CVE-2020-"), (F.col("p_size") + 1000).cast("string")).alias("cve"), F.expr(_STATUS).alias("status"),
    )


_CUSTOMER_PARTS = "SELECT DISTINCT 'customer ' || o_custkey AS root, l_partkey AS p FROM orders JOIN lineitem ON l_orderkey = o_orderkey"


def _customer_closure(spark, sf_dir):
    roots = _t(spark, sf_dir, "orders").select(F.concat(F.lit("customer "), F.col("o_custkey").cast("string")).alias("root"))
    return closure.closure(_region_graph(spark, sf_dir), roots)


_ROLLUP = f"SELECT root, {_STATUS} AS status, 'CVE-2020-' || (p_size + 1000) AS cve FROM reach JOIN part ON p_partkey = p"


@query(f"WITH reach AS ({_CUSTOMER_PARTS}), facts AS (SELECT DISTINCT * FROM ({_ROLLUP})) SELECT root, status, string_agg(cve, ',' ORDER BY cve) AS cves, count(*) AS n_cves FROM facts GROUP BY root, status")
def cve_rollup(spark, sf_dir):
    return cvedb.rollup(_customer_closure(spark, sf_dir), _part_status(spark, sf_dir)).withColumn("cves", F.array_join("cves", ","))


@query(f"WITH reach AS ({_CUSTOMER_PARTS}), facts AS (SELECT DISTINCT * FROM ({_ROLLUP})) SELECT root, cve, CASE WHEN bool_or(status = 'fixed') THEN 'fixed' WHEN bool_or(status = 'cve') THEN 'vulnerable' ELSE 'unknown' END AS net FROM facts GROUP BY root, cve")
def cve_net_status(spark, sf_dir):
    return cvedb.net_status(cvedb.rollup(_customer_closure(spark, sf_dir), _part_status(spark, sf_dir)))


@query("SELECT 'CVE-2020-' || (p_size + 1000) AS cve, string_agg('part ' || p_partkey, ',' ORDER BY 'part ' || p_partkey) AS blobs, count(*) AS n_blobs FROM part WHERE p_partkey % 3 = 0 GROUP BY p_size")
def cve_inverse(spark, sf_dir):
    return cvedb.vulnerable_blobs(_part_status(spark, sf_dir)).withColumn("blobs", F.array_join("blobs", ","))


@query("SELECT '/src/' || replace(p_name, ' ', '_') || '.c' AS file_path, 'CVE-2020-' || (p_size + 1000) AS cve, " + _STATUS + " AS status, count(*) AS n FROM part GROUP BY ALL")
def cve_wide_and_back(spark, sf_dir):
    table = cvedb.wide(_part_status(spark, sf_dir))
    return cvedb.long(table.filter(cvedb.has_any(table))).groupBy("file_path", "cve", "status").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT {_gt('text')} AS blob, arg_min(source || '/' || doc_id, doc_id) AS first_name, string_agg(source || '/' || doc_id, ',' ORDER BY doc_id) AS names, count(*) AS n FROM documents GROUP BY text")
def node_merge(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select("doc_id", ident.gitoid_of_text(F.col("text")).alias("blob"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("name"))
    return dag.merge_by_id(rows, "blob", "name", "doc_id").withColumn("names", F.array_join("names", ","))


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def last_wins(spark, sf_dir):
    return dag.last_of_each(_t(spark, sf_dir, "events"), "user_id", "event_type", "event_id")


@query("SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'first' ELSE 'second' END AS origin FROM customer")
def dag_overlay(spark, sf_dir):
    people = _t(spark, sf_dir, "customer")
    return dag.overlay([people.filter("c_acctbal > 5000").select("c_custkey", F.lit("first").alias("origin")), people.select("c_custkey", F.lit("second").alias("origin"))], "c_custkey")


@query(
    """SELECT a.event_id, a.user_id, b.event_id AS producer
    FROM (FROM events WHERE event_type = 'purchase') a ASOF LEFT JOIN (FROM events WHERE event_type = 'click') b ON a.user_id = b.user_id AND a.event_id > b.event_id"""
)
def asof_producer(spark, sf_dir):
    events = _t(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    clicks = events.filter("event_type = 'click'").select("user_id", "event_id", F.col("event_id").alias("made"))
    return dag.latest_before(events.filter("event_type = 'purchase'").drop("event_type"), clicks, ["user_id"], "event_id", "made", "producer")


@query(
    """WITH own AS (SELECT user_id, event_id, event_type, lag(event_id) OVER w AS before_order, lag(event_type) OVER w AS k FROM events WHERE event_type IN ('view', 'click') WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
    SELECT user_id, before_order, event_id AS after_order FROM own WHERE event_type = 'click' AND k = 'view'"""
)
def pre_post_pairing(spark, sf_dir):
    return dag.paired_once(_t(spark, sf_dir, "events"), ["user_id"], "event_id", "event_type", "view", "click")


_RULES_SQL = "rules AS (SELECT regexp_extract(url, '[^/]*$') AS src_file, min(page_id) AS rule_ord FROM pages GROUP BY 1 HAVING regexp_extract(url, '[^/]*$') <> '')"


@query(f"WITH {_RULES_SQL} SELECT p.url AS path, arg_min(src_file, rule_ord) AS src_file FROM (SELECT DISTINCT url FROM pages) p JOIN rules ON ends_with(p.url, src_file) GROUP BY p.url")
def suffix_join(spark, sf_dir):
    pages = _t(spark, sf_dir, "pages")
    rules = pages.groupBy(F.regexp_extract("url", "[^/]*$", 0).alias("src_file")).agg(F.min("page_id").alias("rule_ord")).filter("src_file <> ''")
    return cvedb.suffix_matches(pages.select(F.col("url").alias("path")), rules)


def _rules(spark, sf_dir):
    words = F.split("text", " ")
    both = _t(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("CVE-2021-"), (F.col("item_id") + 1000).cast("string")).alias("cve"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("src_file"), words.alias("w")
    )
    add = both.select("cve", "src_file", F.lit("cveadd").alias("rule_type"), F.array(F.array(F.get("w", F.lit(1))), F.array(F.get("w", F.lit(2)), F.get("w", F.lit(3)))).alias("include"), F.array(F.array(F.lit("|"))).alias("exclude"))
    return add.unionByName(both.select("cve", "src_file", F.lit("cvefix").alias("rule_type"), F.array(F.array(F.get("w", F.lit(1))), F.array(F.get("w", F.lit(4)))).alias("include"), F.array(F.array(F.lit("%%%"))).alias("exclude")))


_VERDICT_SQL = f"""
rules AS (SELECT 'CVE-2021-' || (item_id + 1000) AS cve, 'src' || (item_id % 20) AS src_file, string_split(text, ' ') AS w FROM benchmark),
held AS (
  SELECT d.doc_id, cve, contains(text, w[2]) AND (contains(text, w[3]) OR contains(text, w[4])) AND NOT contains(text, '|') AS a,
         contains(text, w[2]) AND contains(text, w[5]) AND NOT contains(text, '%%%') AS f
  FROM documents d JOIN rules ON source = src_file
), verdicts AS (SELECT CAST(doc_id AS VARCHAR) AS blob, cve, CASE WHEN bool_or(f) THEN 'fixed' ELSE 'has' END AS verdict FROM held WHERE a OR f GROUP BY ALL)
"""


def _verdicts(spark, sf_dir):
    content = _t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("blob"), F.col("source").alias("src_file"), F.col("text").alias("content"))
    return cvedb.rule_results(content, _rules(spark, sf_dir))


@query(f"WITH {_VERDICT_SQL} SELECT * FROM verdicts")
def rule_match(spark, sf_dir):
    return _verdicts(spark, sf_dir)


@query(
    f"""WITH {_VERDICT_SQL}, known AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS blob, 'CVE-2021-' || (1000 + doc_id % 40) AS cve FROM labels),
    odd AS (SELECT coalesce(v.blob, k.blob) AS blob, coalesce(v.cve, k.cve) AS cve, v.blob IS NULL AS r FROM (SELECT DISTINCT blob, cve FROM verdicts) v FULL JOIN known k ON k.blob = v.blob AND k.cve = v.cve WHERE v.blob IS NULL OR k.blob IS NULL)
    SELECT blob, coalesce(string_agg(cve, ',' ORDER BY cve) FILTER (WHERE NOT r), '') AS left_only, coalesce(string_agg(cve, ',' ORDER BY cve) FILTER (WHERE r), '') AS right_only FROM odd GROUP BY blob"""
)
def rule_vs_status_mismatch(spark, sf_dir):
    known = _t(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("blob"), F.concat(F.lit("CVE-2021-"), (F.col("doc_id") % 40 + 1000).cast("string")).alias("cve"))
    odd = cvedb.mismatches(_verdicts(spark, sf_dir), known)
    return odd.select("blob", F.array_join("left_only", ",").alias("left_only"), F.array_join("right_only", ",").alias("right_only"))


@query(
    f"""WITH {_VERDICT_SQL}, known AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS blob, 'CVE-2021-' || (1000 + doc_id % 40) AS cve, 'no' AS status FROM labels)
    SELECT * FROM known UNION ALL SELECT blob, cve, CASE verdict WHEN 'has' THEN 'cve' ELSE 'fixed' END FROM verdicts v WHERE NOT EXISTS (FROM known k WHERE k.blob = v.blob AND k.cve = v.cve)"""
)
def rule_attach(spark, sf_dir):
    known = _t(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("blob"), F.concat(F.lit("CVE-2021-"), (F.col("doc_id") % 40 + 1000).cast("string")).alias("cve"), F.lit("no").alias("status")).distinct()
    return cvedb.attach_verdicts(known, _verdicts(spark, sf_dir))


def _history(spark, sf_dir, newest_first=True):
    w = Window.partitionBy("o_custkey").orderBy(*([F.desc("o_orderdate"), F.desc("o_orderkey")] if newest_first else [F.col("o_orderdate"), F.col("o_orderkey")]))
    orders = _t(spark, sf_dir, "orders")
    return orders.select(F.col("o_custkey").cast("string").alias("path"), F.row_number().over(w).cast("long").alias("ord"), F.concat(F.lit("b"), F.col("o_orderkey").cast("string")).alias("blob"), "o_orderstatus", "o_orderpriority")


_HISTORY_SQL = """
history AS (SELECT CAST(o_custkey AS VARCHAR) AS path, 'b' || o_orderkey AS blob, o_orderkey AS k, o_orderstatus AS s,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS ord FROM orders)
"""


@query(
    f"""WITH {_HISTORY_SQL}, fixes AS (SELECT path, 'CVE-2019-' || path AS cve, min(ord) FILTER (WHERE s = 'F') AS pre, min(ord) FILTER (WHERE s = 'O') AS post FROM history GROUP BY path)
    SELECT path, blob, cve, CASE WHEN ord >= pre THEN 'cve' ELSE 'fixed' END AS status FROM history JOIN fixes USING (path) WHERE pre IS NOT NULL AND post IS NOT NULL AND (ord >= pre OR ord <= post)"""
)
def history_split(spark, sf_dir):
    history = _history(spark, sf_dir)
    at = lambda s: F.min_by(F.when(F.col("o_orderstatus") == s, F.col("blob")), F.when(F.col("o_orderstatus") == s, F.col("ord")))
    fixes = history.groupBy("path").agg(at("F").alias("pre_blob"), at("O").alias("post_blob")).filter("pre_blob IS NOT NULL AND post_blob IS NOT NULL")
    return cvedb.split_history(history.select("path", "ord", "blob"), fixes.withColumn("cve", F.concat(F.lit("CVE-2019-"), "path")))


_RANGE_SQL = f"""
WITH {_HISTORY_SQL.replace('DESC', 'ASC')},
ranges AS (SELECT path, 'CVE-2018-' || path AS cve, min(ord) FILTER (WHERE s = 'F') AS lo, max(ord) FILTER (WHERE s = 'O') AS hi FROM history GROUP BY path HAVING count(*) FILTER (WHERE s = 'F') > 0)
SELECT cve, path, blob, CASE WHEN ord >= lo AND (hi IS NULL OR ord < hi) THEN 'cve' ELSE 'not_in_range' END AS status FROM history JOIN ranges USING (path)
"""


def _in_ranges(spark, sf_dir):
    history = _history(spark, sf_dir, newest_first=False)
    pick = lambda f, s: f(F.when(F.col("o_orderstatus") == s, F.col("blob")), F.when(F.col("o_orderstatus") == s, F.col("ord")))
    ranges = history.groupBy("path").agg(pick(F.min_by, "F").alias("lo_blob"), F.coalesce(pick(F.max_by, "O"), F.lit("0" * 40)).alias("hi_blob")).filter("lo_blob IS NOT NULL")
    return cvedb.in_ranges(history.select("path", "ord", "blob"), ranges.select(F.concat(F.lit("CVE-2018-"), "path").alias("cve"), "lo_blob", "hi_blob"))


@query(f"SELECT * FROM ({_RANGE_SQL}) WHERE status = 'cve'")
def range_vulnerable(spark, sf_dir):
    return _in_ranges(spark, sf_dir).filter("status = 'cve'")


@query(f"SELECT * FROM ({_RANGE_SQL}) WHERE status <> 'cve'")
def range_complement(spark, sf_dir):
    return _in_ranges(spark, sf_dir).filter("status <> 'cve'")


@query(f"WITH {_HISTORY_SQL}, own AS (SELECT *, lag(blob) OVER (PARTITION BY path ORDER BY ord) AS newer FROM history) SELECT DISTINCT path, blob FROM own WHERE ord > 1 AND ord <= 4 UNION SELECT path, newer FROM (SELECT path, newer, row_number() OVER (PARTITION BY path ORDER BY ord DESC) AS n FROM own WHERE ord > 1 AND ord <= 4) WHERE n = 1")
def change_interval(spark, sf_dir):
    w = Window.partitionBy("path").orderBy("ord")
    changes = _history(spark, sf_dir).select("path", "ord", F.col("blob").alias("src_blob"), F.lag("blob").over(w).alias("dst_blob"))
    return cvedb.change_interval(changes, 1, 4, with_newest=True)


@query("SELECT CAST(o_custkey AS VARCHAR) AS path, o_orderpriority, 'b' || arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS blob FROM orders GROUP BY o_custkey, o_orderpriority")
def newest_per_key(spark, sf_dir):
    return cvedb.newest_of_each(_history(spark, sf_dir), ["path", "o_orderpriority"]).select("path", "o_orderpriority", "blob")


@query("SELECT 'CVE-2020-' || (1000 + doc_id % 7) AS cve, string_agg(c, ',' ORDER BY c) AS commits FROM (SELECT DISTINCT doc_id % 7 AS doc_id, 'c' || doc_id AS c FROM documents) GROUP BY doc_id")
def cve_commits(spark, sf_dir):
    commits = _t(spark, sf_dir, "documents").select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("commit"), F.concat(F.lit("fix CVE-2020-"), (F.col("doc_id") % 7 + 1000).cast("string"), F.lit(" again")).alias("message"))
    return cvedb.commits_of_cves(commits).withColumn("commits", F.array_join("commits", ","))


@query("SELECT doc_id, array_to_string(list_distinct(regexp_extract_all(m, 'CVE-\\d{4}-\\d+')).list_sort(), ',') AS cves FROM (SELECT doc_id, 'CVE-2020-' || (doc_id % 50) || '1, CVE-20-1 ' || n_chars || ' CVE-1999-' || n_chars || ' CVE-2020-' || (doc_id % 50) || '1' AS m FROM documents)")
def cve_extract(spark, sf_dir):
    d, n = F.col("doc_id"), F.col("n_chars").cast("string")
    first = F.concat(F.lit("CVE-2020-"), (d % 50).cast("string"), F.lit("1"))
    message = F.concat(first, F.lit(", CVE-20-1 "), n, F.lit(" CVE-1999-"), n, F.lit(" "), first)
    return _t(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(text.cve_ids(message)), ",").alias("cves"))


@query(
    """WITH RECURSIVE up AS (SELECT c_custkey AS c, c_custkey // 3 AS p FROM customer WHERE c_custkey > 0), reach AS (SELECT c_custkey AS descendant, c_custkey AS ancestor FROM customer UNION SELECT descendant, p FROM reach JOIN up ON c = ancestor)
    SELECT CAST(descendant AS VARCHAR) AS descendant, count(*) AS n_ancestors, CAST(min(ancestor) AS VARCHAR) AS oldest FROM reach GROUP BY descendant"""
)
def commit_ancestry(spark, sf_dir):
    people = _t(spark, sf_dir, "customer")
    parents = people.filter("c_custkey > 0").select(F.col("c_custkey").cast("string").alias("commit"), F.expr("c_custkey div 3").cast("string").alias("parent"))
    reached = cvedb.ancestry(parents, people.select(F.col("c_custkey").cast("string").alias("commit")))
    return reached.groupBy("descendant").agg(F.count(F.lit(1)).alias("n_ancestors"), F.min(F.col("ancestor").cast("long")).cast("string").alias("oldest"))


@query(
    """WITH a AS (SELECT 'CVE-2020-' || (p_partkey % 100) AS cve, p_partkey AS blob, '/' || p_name AS f, 'cve' AS s FROM part), b AS (SELECT 'CVE-2021-' || (p_partkey % 50), p_partkey, '/' || p_name, 'fixed' FROM part WHERE p_size > 25)
    SELECT CAST(blob AS VARCHAR) AS blob, f AS file_path, cve, s AS status FROM a WHERE blob NOT IN (SELECT p_partkey FROM part WHERE p_size > 25) UNION ALL SELECT CAST(p_partkey AS VARCHAR), f, c, s FROM b AS t(c, p_partkey, f, s)"""
)
def cve_overlay(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    row = lambda df, cve, s: df.select(F.col("p_partkey").cast("string").alias("blob"), F.concat(F.lit("/"), "p_name").alias("file_path"), cve.alias("cve"), F.lit(s).alias("status"))
    first = row(part, F.concat(F.lit("CVE-2020-"), (F.col("p_partkey") % 100).cast("string")), "cve")
    return cvedb.overlay([first, row(part.filter("p_size > 25"), F.concat(F.lit("CVE-2021-"), (F.col("p_partkey") % 50).cast("string")), "fixed")])


_PATH_SQL = "'/usr/src/' || source || '-1.' || (doc_id % 5) || '/lib/' || doc_id || '.c'"


def _doc_nodes(spark, sf_dir):
    d = F.col("doc_id").cast("string")
    labels = _t(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    path = F.concat(F.lit("/usr/src/"), "source", F.lit("-1."), (F.col("doc_id") % 5).cast("string"), F.lit("/lib/"), d, F.lit(".c"))
    return _t(spark, sf_dir, "documents").join(labels, "doc_id", "left").select(
        F.concat(F.lit("d"), d).alias("blob"), "lang", F.when(F.col("lang") == "de", F.concat(F.lit("/plain/"), d)).otherwise(path).alias("file_path"),
        F.when(F.col("toxic") == 1, F.concat(F.lit("prov "), "source")).alias("prov_pkg"), F.when(F.col("quality") == 0, F.array(F.concat(F.lit("pkg "), "source"))).alias("pkgs"),
    )


_SBOM_SQL = f"""
groups AS (
  SELECT lang AS root, CASE WHEN toxic = 1 THEN 'prov ' || source WHEN quality = 0 THEN 'pkg ' || source WHEN lang = 'de' THEN 'UNKNOWN_COMPONENT_VERSION'
    ELSE 'DERIVED_PKG ' || source || ' 1.' || (d.doc_id % 5) END AS pkg_key, 'd' || d.doc_id AS blob
  FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic, max(quality) AS quality FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id
)
"""


def _groups(spark, sf_dir):
    node = _doc_nodes(spark, sf_dir)
    return packages.sbom_groups(node.select(F.col("lang").alias("root"), "blob"), node)


@query(f"WITH {_SBOM_SQL} SELECT root, pkg_key, string_agg(blob, ',' ORDER BY blob) AS blobs, count(*) AS n_blobs FROM groups GROUP BY root, pkg_key")
def sbom_group(spark, sf_dir):
    return _groups(spark, sf_dir).withColumn("blobs", F.array_join("blobs", ","))


@query(f"WITH {_SBOM_SQL} SELECT root, count(DISTINCT CASE WHEN pkg_key NOT LIKE 'UNKNOWN%' THEN pkg_key END) AS n_packages, count(*) AS n_blobs, count(*) FILTER (WHERE pkg_key LIKE 'UNKNOWN%') AS n_unknown, count(*) FILTER (WHERE pkg_key LIKE 'UNKNOWN%') * 100.0::DOUBLE / count(*) AS unknown_pct FROM groups GROUP BY root")
def sbom_summary(spark, sf_dir):
    return packages.sbom_summary(_groups(spark, sf_dir))


def _pkg_blob(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select(F.col("source").alias("pkg_key"), ident.gitoid_of_text(F.col("text")).alias("blob"), F.concat_ws("/", "lang", F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("size"), F.col("doc_id").alias("ord"))


@query(f"SELECT blob, string_agg(source, ',' ORDER BY source) AS packages, count(*) AS n_packages FROM (SELECT DISTINCT {_gt('text')} AS blob, source FROM documents) GROUP BY blob")
def pkg_index(spark, sf_dir):
    return packages.index_by_blob(_pkg_blob(spark, sf_dir)).withColumn("packages", F.array_join("packages", ","))


@query("SELECT source AS pkg_key, count(DISTINCT text) AS n_blobs, count(DISTINCT lang || '/' || doc_id) AS n_paths, CAST(sum(n_chars) AS BIGINT) AS size FROM documents GROUP BY source")
def pkg_index_inverse(spark, sf_dir):
    return packages.index_by_package(_pkg_blob(spark, sf_dir))


@query("SELECT source AS pkg_key, count(*) AS n_blobs, CAST(sum(n_chars) AS BIGINT) AS size FROM documents GROUP BY ROLLUP (source)")
def index_totals(spark, sf_dir):
    return packages.index_totals(_pkg_blob(spark, sf_dir))


@query(
    f"""WITH p AS (SELECT source, CASE WHEN substr(source, 4)::INT % 4 = 0 THEN 1 ELSE 0 END AS is_source, substr(source, 4)::INT AS o FROM documents GROUP BY source)
    SELECT {_gt('text')} AS blob, arg_max(d.source, (is_source, o, doc_id)) AS pkg_key, arg_max(lang || '/' || doc_id, (is_source, o, doc_id)) AS path FROM documents d JOIN p ON p.source = d.source GROUP BY text"""
)
def pkg_fold_priority(spark, sf_dir):
    number = F.substring("pkg_key", 4, 10).cast("int")
    pkg = _pkg_blob(spark, sf_dir).select("pkg_key").distinct().select("pkg_key", F.when(number % 4 == 0, "src.rpm").otherwise("rpm").alias("pkg_type"), number.alias("ord"))
    return packages.owner_of_blob(_pkg_blob(spark, sf_dir), pkg)


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_name, c_custkey LIMIT 40 OFFSET 25")
def limit_offset_packages(spark, sf_dir):
    return packages.page(_t(spark, sf_dir, "customer").select("c_custkey", "c_name"), [F.col("c_name"), F.col("c_custkey")], 25, 40)


@query("SELECT count(*) AS num_pkgs, CAST(sum(n_chars * 2 + 1) AS BIGINT) AS total_size FROM documents")
def release_summary(spark, sf_dir):
    one = lambda size, name: F.struct(size.cast("long").alias("size"), F.lit(name).alias("name"))
    rows = _t(spark, sf_dir, "documents").select(F.col("source").alias("package"), F.array(one(F.col("n_chars"), "a.dsc"), one(F.col("n_chars") + 1, "a.tar.xz")).alias("files"))
    return packages.release_summary(rows)


_SHARED_SUFFIX = "list_max(list_transform(range(0, least(length(fp), length(pp)) + 1), lambda k: CASE WHEN right(fp, k) = right(pp, k) THEN k ELSE 0 END))"


@query(
    f"""WITH c AS (SELECT DISTINCT l_partkey AS part, l_suppkey AS s FROM lineitem), r AS (
      SELECT part, s, '/src/supp' || (part % 100) || '/part' || part || '.c' AS fp, 'supp' || s AS name, '/src/supp' || s || '/part' || (s * 7 % 200) || '.c' AS pp FROM c),
    m AS (SELECT *, contains(fp, name) AS named, CASE WHEN contains(fp, name) THEN {_SHARED_SUFFIX} END AS common FROM r),
    n AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY (named AND common = length(pp)) DESC, CASE WHEN named AND common = length(pp) THEN s END, coalesce(common, 0) DESC, s) AS k FROM m)
    SELECT CAST(part AS VARCHAR) AS blob, name, 'v' || (s % 3) AS version FROM n WHERE k = 1"""
)
def best_package(spark, sf_dir):
    pair = _t(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    c = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v.cast("string") for v in x])
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    rows = pair.select(
        p.cast("string").alias("blob"), c("/src/supp", p % 100, "/part", p, ".c").alias("file_path"), c("supp", s).alias("name"), c("v", s % 3).alias("version"),
        c("/src/supp", s, "/part", s * 7 % 200, ".c").alias("pkg_path"), s.alias("ord"),
    )
    return packages.best_package(rows)


@query("SELECT 'd' || doc_id AS path, coalesce(CASE WHEN doc_id % 3 = 0 THEN 'index ' || source END, CASE WHEN doc_id % 2 = 0 THEN 'installed ' || lang END) AS provider FROM documents")
def provider_of_file(spark, sf_dir):
    files = _t(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), "doc_id", "source", "lang")
    index = files.filter("doc_id % 3 = 0").select("path", F.concat(F.lit("index "), "source").alias("pkg_key"))
    return packages.provider(files, index, files.filter("doc_id % 2 = 0").select("path", F.concat(F.lit("installed "), "lang").alias("pkg_key")))


_COVER_SQL = "SELECT root, count(*) AS n_blobs, count(k) AS n_found, count(k) * 100.0::DOUBLE / count(*) AS found_pct, (SELECT count(*) FROM part WHERE p_size > 10) AS n_known, count(k) * 100.0::DOUBLE / (SELECT count(*) FROM part WHERE p_size > 10) AS known_pct"
_KNOWN_SQL = "known AS (SELECT 'part ' || p_partkey AS k FROM part WHERE p_size > 10)"


def _known_parts(spark, sf_dir):
    return _t(spark, sf_dir, "part").filter("p_size > 10").select(F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("blob"))


@query(f"WITH RECURSIVE {_REGION_SQL}, {_KNOWN_SQL} {_COVER_SQL} FROM (SELECT DISTINCT root, blob FROM reach WHERE blob NOT IN (SELECT a FROM links)) LEFT JOIN known ON k = blob GROUP BY root")
def coverage_leaf(spark, sf_dir):
    graph = _region_graph(spark, sf_dir)
    return closure.coverage(closure.leaves(closure.closure(graph, _regions(spark, sf_dir)), graph), _known_parts(spark, sf_dir))


@query(f"WITH RECURSIVE {_REGION_SQL}, {_KNOWN_SQL} {_COVER_SQL} FROM (SELECT DISTINCT root, blob FROM reach) LEFT JOIN known ON k = blob GROUP BY root")
def coverage_all(spark, sf_dir):
    return closure.coverage(closure.closure(_region_graph(spark, sf_dir), _regions(spark, sf_dir)), _known_parts(spark, sf_dir))


@query("SELECT 'd' || d.doc_id AS blob, " + _PATH_SQL.replace("doc_id", "d.doc_id") + " AS file_path FROM documents d WHERE lang <> 'de' AND d.doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_blobs(spark, sf_dir):
    status = _t(spark, sf_dir, "labels").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("blob"))
    return cvedb.missing_sources(_doc_nodes(spark, sf_dir), status)


@query(
    """SELECT 'd' || d.doc_id AS blob, coalesce(CASE WHEN n_chars % 2 = 0 THEN 'one ' || lang END, CASE WHEN n_chars % 3 = 0 THEN 'two ' || source END) AS note, coalesce(CASE WHEN n_chars % 2 = 0 AND n_chars % 5 > 0 THEN n_chars END, CASE WHEN n_chars % 3 = 0 THEN -n_chars END) AS size FROM documents d"""
)
def metadata_fallback(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").withColumn("blob", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    first = d.filter("n_chars % 2 = 0").select("blob", F.concat(F.lit("one "), "lang").alias("note"), F.when(F.col("n_chars") % 5 > 0, F.col("n_chars")).alias("size"))
    second = d.filter("n_chars % 3 = 0").select("blob", F.concat(F.lit("two "), "source").alias("note"), (-F.col("n_chars")).alias("size"))
    return cvedb.attach_metadata(d.select("blob"), first, second, ["note", "size"])


@query(
    """WITH boms AS (SELECT 'd' || doc_id AS blob, 'bom ' || (doc_id % 100) AS bom FROM documents)
    SELECT lang AS root, count(*) AS n FROM (SELECT DISTINCT r.lang, b.blob FROM (SELECT DISTINCT lang, 'bom ' || (doc_id % 100) AS bom FROM documents WHERE n_chars > 6000) r JOIN boms b ON b.bom = r.bom) GROUP BY lang"""
)
def same_bom_blobs(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("lang", "n_chars", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("blob"), F.concat(F.lit("bom "), (F.col("doc_id") % 100).cast("string")).alias("bom_id"))
    return closure.same_bom_blobs(d.filter("n_chars > 6000").select(F.col("lang").alias("root"), "blob"), d).groupBy("root").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'customer ' || c_custkey AS blob, 'mk ' || c_name || ' > mk ' || n_name AS commands FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT 'nation ' || n_nationkey, 'mk ' || n_name FROM nation")
def command_chains(spark, sf_dir):
    c, n = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "nation")
    name = lambda kind, col: F.concat(F.lit(f"{kind} "), F.col(col).cast("string"))
    edge = c.select(name("customer", "c_custkey").alias("out_blob"), name("nation", "c_nationkey").alias("in_blob")).union(n.select(name("nation", "n_nationkey"), name("region", "n_regionkey")))
    node = c.select(name("customer", "c_custkey").alias("blob"), F.concat(F.lit("mk "), "c_name").alias("build_cmd")).union(n.select(name("nation", "n_nationkey"), F.concat(F.lit("mk "), "n_name")))
    return closure.command_chains(edge, node).withColumn("commands", F.array_join("commands", " > "))


@query("SELECT conv_id || '/' || turn AS proc, conv_id || '/' || min(turn) OVER (PARTITION BY conv_id) AS root, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS depth FROM (SELECT DISTINCT conv_id, turn FROM conversations)")
def pstree_depth(spark, sf_dir):
    turns = _t(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    w = Window.partitionBy("conv_id").orderBy("turn")
    name = lambda t: F.concat(F.col("conv_id").cast("string"), F.lit("/"), t.cast("string"))
    return processes.depths(turns.select(name(F.col("turn")).alias("proc"), name(F.lag("turn").over(w)).alias("parent_proc")))


@query(
    """WITH own AS (SELECT event_id, user_id, event_type, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
    SELECT event_id AS line_no, user_id AS pid, event_type AS parent, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS incarnation FROM own"""
)
def incarnations(spark, sf_dir):
    return processes.incarnations(_t(spark, sf_dir, "events").select(F.col("event_id").alias("line_no"), F.col("user_id").alias("pid"), F.col("event_type").alias("parent")))


@query("SELECT 'd' || a.doc_id AS path, 'w' || min(b.doc_id) AS match FROM documents a JOIN documents b ON a.text = b.text AND a.doc_id % 50 = b.doc_id % 50 GROUP BY a.doc_id")
def same_content(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", ident.gitoid_of_text(F.col("text")).alias("blob"), (F.col("doc_id") % 50).cast("string").alias("name"))
    path = lambda prefix: F.concat(F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit("/"), "name")
    found = matching.same_content(d.select(path("d").alias("path"), "blob"), d.select(path("w").alias("path"), "blob"))
    number = lambda c: F.split(c, "/")[0].cast("long").cast("string")
    return found.select(F.concat(F.lit("d"), number("path")).alias("path"), F.concat(F.lit("w"), number("match")).alias("match"))


@query(
    """WITH RECURSIVE need AS (SELECT DISTINCT '/lib/lib' || l_partkey || '.so' AS a, '/lib/lib' || (l_partkey // 2) || '.so' AS b FROM lineitem WHERE l_partkey > 0), reach AS (SELECT DISTINCT '/bin/app' || s_suppkey AS root, '/bin/app' || s_suppkey AS blob, 0 AS depth FROM supplier
    UNION SELECT root, x.b, depth + 1 FROM reach JOIN (SELECT * FROM need UNION SELECT '/bin/app' || s_suppkey, '/lib/lib' || (s_suppkey * 3) || '.so' FROM supplier JOIN part ON p_partkey = s_suppkey * 3) x ON x.a = reach.blob)
    SELECT root, count(*) AS n_libs, max(depth) AS max_depth FROM reach GROUP BY root"""
)
def library_closure(spark, sf_dir):
    so = lambda c: F.concat(F.lit("lib"), c.cast("string"), F.lit(".so"))
    parts = _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p")).distinct()
    none = F.array().cast("array<string>")
    elf = parts.filter("p > 0").select(F.concat(F.lit("/lib/"), so(F.col("p"))).alias("path"), F.lit(64).alias("bits"), F.array(so(F.expr("p div 2"))).alias("needed"), none.alias("rpath"))
    apps = _t(spark, sf_dir, "supplier").select(F.concat(F.lit("/bin/app"), F.col("s_suppkey").cast("string")).alias("path"), F.lit(64).alias("bits"), F.array(so(F.col("s_suppkey") * 3)).alias("needed"), none.alias("rpath"))
    lib = _t(spark, sf_dir, "part").select(F.lit(64).alias("bits"), so(F.col("p_partkey")).alias("soname"), F.concat(F.lit("/lib/"), so(F.col("p_partkey"))).alias("path"), F.lit(0).alias("prio"))
    closed = matching.library_closure(elf.unionByName(apps), lib, apps.select(F.col("path").alias("root")))
    return closed.groupBy("root").agg(F.count(F.lit(1)).alias("n_libs"), F.max("depth").alias("max_depth"))


@query("SELECT s_suppkey, 'pkg:rpm/acme/' || replace(s_name, '#', '%23') || '@1.' || s_nationkey || '?arch=x86_64&distro=el8' AS purl, 'cpe:2.3:a:acme:' || replace(lower(s_name), '#', '\\#') || ':1.' || s_nationkey || ':*:*:*:*:*:*:*' AS cpe FROM supplier")
def purl_cpe(spark, sf_dir):
    version = F.concat(F.lit("1."), F.col("s_nationkey").cast("string"))
    return _t(spark, sf_dir, "supplier").select(
        "s_suppkey", text.purl("rpm", F.lit("acme"), F.col("s_name"), version, arch=F.lit("x86_64"), distro=F.lit("el8")).alias("purl"), text.cpe23(F.lit("acme"), F.col("s_name"), version).alias("cpe")
    )


@query(
    """SELECT doc_id, 'lib' || source || '-' || (doc_id % 9) || '.' || (n_chars % 10) || '.tar.gz' AS file, 'lib' || source AS name, (doc_id % 9) || '.' || (n_chars % 10) AS version,
    'https://m/pool/main/lib' || source[1] || '/lib' || source || '/x.dsc' AS url, 'SPDXRef-' || replace(source || '_' || lang, '_', '-') AS spdx FROM documents"""
)
def package_names(spark, sf_dir):
    version = F.concat((F.col("doc_id") % 9).cast("string"), F.lit("."), (F.col("n_chars") % 10).cast("string"))
    name = F.concat(F.lit("lib"), "source")
    file = F.concat(name, F.lit("-"), version, F.lit(".tar.gz"))
    told = text.archive_name_version(file)
    return _t(spark, sf_dir, "documents").select(
        "doc_id", file.alias("file"), told["name"].alias("name"), told["version"].alias("version"), text.deb_pool_url(F.lit("https://m/"), name, F.lit("x.dsc")).alias("url"), text.spdx_id(F.concat_ws("_", "source", "lang")).alias("spdx")
    )


@query("SELECT doc_id, '/r/w/' || source || '/b.c' AS path, '/w/' || source || '/b.c' AS outside, contains(source, '1') AS version FROM documents")
def path_functions(spark, sf_dir):
    raw = F.concat(F.lit("./x/../"), "source", F.lit("//./b.c"))
    full = text.normal_path(raw, F.lit("/w"), F.lit("/r"))
    told = text.is_version(F.when(F.contains("source", F.lit("1")), F.lit("v1.2.3-r4")).otherwise(F.concat(F.lit("x"), "source")))
    return _t(spark, sf_dir, "documents").select("doc_id", full.alias("path"), text.outside_root(full, F.lit("/r")).alias("outside"), told.alias("version"))


@query(
    f"""WITH d AS (SELECT DISTINCT lang AS doc, doc_id, source, CASE WHEN toxic = 1 THEN 1 ELSE 0 END AS b FROM documents LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) USING (doc_id))
    SELECT DISTINCT doc, 'SPDXRef-DOCUMENT' AS src, 'DESCRIBES' AS type, 'main ' || doc AS dst FROM d UNION ALL SELECT doc, 'main ' || doc, 'CONTAINS', 'file ' || doc_id FROM d
    UNION ALL SELECT DISTINCT doc, 'pkg ' || source, 'BUILD_DEPENDENCY_OF', 'main ' || doc FROM d WHERE b = 1 UNION ALL SELECT DISTINCT doc, 'main ' || doc, 'DEPENDS_ON', 'pkg ' || source FROM d WHERE b = 0"""
)
def spdx_relationships(spark, sf_dir):
    labels = _t(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    d = _t(spark, sf_dir, "documents").join(labels, "doc_id", "left").withColumn("doc", F.col("lang"))
    toxic = F.coalesce(F.col("toxic") == 1, F.lit(False))
    dep = lambda df: df.select("doc", F.concat(F.lit("pkg "), "source").alias("spdx_id"))
    return spdx.relationships(d.select("doc").distinct().select("doc", F.concat(F.lit("main "), "doc").alias("spdx_id")), d.select("doc", F.concat(F.lit("file "), F.col("doc_id").cast("string")).alias("spdx_id")), dep(d.filter(toxic)), dep(d.filter(~toxic)))


@query("SELECT lang AS doc, sha1(string_agg(sha1(text), '' ORDER BY sha1(text))) AS code FROM documents GROUP BY lang")
def verification_code(spark, sf_dir):
    return spdx.verification_code(_t(spark, sf_dir, "documents").select(F.col("lang").alias("doc"), F.sha1(F.col("text").cast("binary")).alias("sha1")))


@query("SELECT doc_id, 'PackageName: x' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'ExternalRef: a b c' || chr(10) || 'ExternalRef: PERSISTENT-ID gitoid gitoid:blob:sha1:' || sha1(text) || chr(10) ELSE 'ExternalRef: PERSISTENT-ID gitoid gitoid:blob:sha1:' || sha1(text) || chr(10) END || 'PackageChecksum: y' AS text FROM documents")
def sbom_insert_ref(spark, sf_dir):
    body = F.concat(F.lit("PackageName: x\n"), F.when(F.col("doc_id") % 2 == 0, F.lit("ExternalRef: a b c\n")).otherwise(F.lit("")), F.lit("PackageChecksum: y"))
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), body.alias("text"), F.sha1(F.col("text").cast("binary")).alias("bom_id"))
    return spdx.insert_ref_tag_value(docs, force=True).withColumnRenamed("doc", "doc_id")


@query(f"WITH {_EDGES_SQL} SELECT e.out_blob, 'b ' || count(*) AS n_inputs FROM order_edges e GROUP BY e.out_blob")
def rawlog_round_trip(spark, sf_dir):
    """Orders as build records, written as log text and parsed again."""
    edge = _order_edges(spark, sf_dir)
    none = F.array().cast("array<string>")
    entry = F.struct(F.lit(0).alias("pos"), F.col("in_blob").alias("blob"), F.concat(F.lit("/src/a b/"), F.substring("in_blob", 1, 6)).alias("path"), none.alias("has_cve"), none.alias("fixed_cve"), F.lit(None).cast("string").alias("prov_pkg"))
    blank = lambda c: F.lit(None).cast("string").alias(c)
    records = edge.groupBy("out_blob").agg(F.collect_list(entry).alias("infiles")).select(
        F.lit(1).cast("long").alias("seq"), blank("pid"), blank("exec_mode"), "out_blob", F.concat(F.lit("/out/"), "out_blob").alias("out_path"), F.lit("make").alias("build_cmd"),
        blank("build_tool"), blank("pkg_info"), blank("prune"), F.lit(False).alias("ignore"), "infiles", F.array().cast(f"array<{schemas.DYNLIB}>").alias("dynlibs"),
    )
    # Parsed records are a table, which every later step reads; else each would parse again.
    again = materialise(rawlog.parse_stanzas(records.select(F.col("seq"), F.regexp_replace(rawlog.stanza_text(), rawlog.END + ".*", "").alias("value"))), "records")
    return dag.edges(again).groupBy("out_blob").agg(F.concat(F.lit("b "), F.count(F.lit(1)).cast("string")).alias("n_inputs"))


@query(f"WITH {_EDGES_SQL} SELECT in_blob AS blob, count(DISTINCT out_blob) AS n_docs FROM order_edges GROUP BY in_blob")
def docs_with_blob(spark, sf_dir):
    ids = merkle.identify(_order_edges(spark, sf_dir), reuse_unary=False)
    lines = readers.doc_lines(ids.filter("doc IS NOT NULL").select(F.col("blob").alias("bom_id"), "doc"))
    return readers.docs_with(lines, lines.select("blob")).groupBy("blob").agg(F.count(F.lit(1)).alias("n_docs"))


@query(_MERKLE_SQL.format(bare="b.bom", reuse=_doc_sql(_FULL_LINE)))
def bare_and_restored_docs(spark, sf_dir):
    """Documents stripped of their separators and restored have the ids that they had."""
    ids = merkle.identify(_graph(spark, sf_dir), reuse_unary=False)
    again = readers.restored_docs(readers.bare_docs(ids.select("blob", "doc")))
    return again.select("blob", ident.gitoid_of_text(F.col("doc")).alias("bom_id"))


@query("SELECT c_custkey AS cmd_id, '/w/' || c_mktsegment || '/o' || c_custkey || '.o' AS out_path, 1 AS n_inputs FROM customer")
def command_records(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    key = F.col("c_custkey").cast("string")
    cmds = c.select(
        F.col("c_custkey").alias("cmd_id"), key.alias("pid"), F.concat(F.lit("/w/"), "c_mktsegment").alias("pwd"), F.lit("").alias("rootdir"), F.lit("/usr/bin/gcc").alias("prog"),
        F.concat(F.lit("gcc -O2 -I inc -c -o o"), key, F.lit(".o ../src/f"), key, F.lit(".c")).alias("argv"),
    )
    catalog = c.select(F.concat(F.lit("/w/"), "c_mktsegment", F.lit("/o"), key, F.lit(".o")).alias("path"), F.concat(F.lit("o"), key).alias("blob")).union(c.select(F.concat(F.lit("/w/src/f"), key, F.lit(".c")), F.concat(F.lit("s"), key)))
    made = commands.command_records(cmds, catalog)
    return made.select(F.regexp_extract("out_path", r"/o(\d+)\.o$", 1).cast("long").alias("cmd_id"), "out_path", F.size("infiles").alias("n_inputs"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    return pipelines.event_windows(_t(spark, sf_dir, "events"), size="1 hour").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@query(
    """WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s)
    SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, k"""
)
def event_sessions(spark, sf_dir):
    return pipelines.event_sessions(_t(spark, sf_dir, "events")).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT 'd' || (doc_id % 100) AS blob, arg_max('b' || n_chars, doc_id) AS bom_id, count(DISTINCT n_chars) AS n_boms, count(DISTINCT n_chars) > 1 AS conflict FROM documents GROUP BY doc_id % 100")
def bom_history(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select(F.concat(F.lit("d"), (F.col("doc_id") % 100).cast("string")).alias("blob"), F.col("doc_id").alias("seq"), F.concat(F.lit("b"), F.col("n_chars").cast("string")).alias("bom_id"))
    return sinks.bom_history(rows).select("blob", "bom_id", F.size("all_bom_ids").cast("long").alias("n_boms"), "conflict")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which identifiers the customers' artifacts get from their orders' inputs."""
    return merkle_customer(spark, sf_dir)


# Further queries register themselves here.
from stemma.plans import exchange, graphs  # noqa: E402,F401

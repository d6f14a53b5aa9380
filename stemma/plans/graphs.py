"""Queries of the remaining operators over graphs, packages, histories and documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stemma.functions import ident, text
from stemma.operators import closure, cvedb, dag, matching, merkle, packages, spdx
from stemma.plans.queries import _COVER_SQL, _EDGES_SQL, _FULL_LINE, _KNOWN_SQL, _MERKLE_SQL, _REGION_SQL, _customer_closure, _doc_sql, _g, _graph, _known_parts, _named, _order_edges, _part_status, _region_graph, _regions, _t, query
from stemma.plans.storage import materialise, scratch
from stemma.sources import sinks


def _c(*parts) -> F.Column:
    """Texts and columns (by expression) put together."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# ---- graph


@query("WITH RECURSIVE up AS (SELECT p_partkey AS a, p_partkey * 6 % (SELECT count(*) FROM part) AS b FROM part), reach AS (SELECT a AS r, b FROM up UNION SELECT r, up.b FROM reach JOIN up ON up.a = reach.b) SELECT 'p' || r AS blob FROM reach WHERE b = r")
def cycles(spark, sf_dir):
    """Numbers and their products by six form circles and ways into them."""
    part = materialise(_t(spark, sf_dir, "part").select("p_partkey"), "numbers")
    n = part.count()
    edge = part.select(_c("p", F.col("p_partkey")).alias("out_blob"), _c("p", F.col("p_partkey") * 6 % n).alias("in_blob"))
    stuck = closure.cyclic(edge)
    # What is on a circle is also stuck with all links turned round.
    return stuck.join(closure.cyclic(edge.select(F.col("in_blob").alias("out_blob"), F.col("out_blob").alias("in_blob"))), "blob", "left_semi")


@query(f"WITH {_EDGES_SQL}, second AS (SELECT DISTINCT c AS o, in_blob FROM customer_edges), kept AS (SELECT {_g('order', 'o')} AS out_blob, in_blob FROM second UNION SELECT out_blob, in_blob FROM order_edges WHERE o NOT IN (SELECT o FROM second)) SELECT out_blob AS blob, {_doc_sql(chr(39) + 'blob ' + chr(39) + ' || in_blob')} AS bom_id FROM kept GROUP BY out_blob")
def graft_graphs(spark, sf_dir):
    """Orders of a customer's number are made of that customer's orders instead, and their documents follow."""
    o = _t(spark, sf_dir, "orders")
    other = o.select(_named("order", "o_custkey").alias("out_blob"), _named("order", "o_orderkey").alias("in_blob"))
    grafted = merkle.graft([other, _order_edges(spark, sf_dir)])
    lines = grafted.groupBy("out_blob").agg(F.collect_list(ident.doc_line(F.col("in_blob"), F.lit(None).cast("string"))).alias("lines"))
    return lines.select(F.col("out_blob").alias("blob"), ident.bom_id(F.col("lines")).alias("bom_id"))


@query(_MERKLE_SQL.format(bare="CASE WHEN e.s <> 'F' THEN b.bom END", reuse=_doc_sql(_FULL_LINE)))
def merkle_unpruned(spark, sf_dir):
    """Orders of two statuses are pruned, and those of one are taken back."""
    orders = lambda *s: _t(spark, sf_dir, "orders").filter(F.col("o_orderstatus").isin(*s)).select(_named("order", "o_orderkey").alias("blob"))
    return merkle.identify(_graph(spark, sf_dir), merkle.unprune(orders("F", "P"), orders("P")), reuse_unary=False, docs=False).select("blob", "bom_id")


@query(f"WITH {_EDGES_SQL}, b AS (SELECT out_blob, o, {_doc_sql(chr(39) + 'blob ' + chr(39) + ' || in_blob')} AS bom FROM order_edges GROUP BY out_blob, o) SELECT out_blob AS blob, bom AS bom_id FROM b UNION ALL SELECT {_g('copy', 'o')}, bom FROM b WHERE o % 2 = 0")
def rewritten_files(spark, sf_dir):
    """Files that were written again with an id embedded take over the document of the old ones."""
    keys = _t(spark, sf_dir, "lineitem").select("l_orderkey").distinct().filter("l_orderkey % 2 = 0")
    again = keys.select(_named("copy", "l_orderkey").alias("new_blob"), _named("order", "l_orderkey").alias("old_blob"))
    return merkle.identify(merkle.reembedded(_order_edges(spark, sf_dir), again), docs=False).select("blob", "bom_id")


@query(f"WITH RECURSIVE {_REGION_SQL} SELECT root, blob, depth, CASE WHEN blob LIKE 'part %' THEN '/a/' || substr(blob, 6) END AS local_path FROM reach")
def closure_with_paths(spark, sf_dir):
    closed = closure.closure(_region_graph(spark, sf_dir), _regions(spark, sf_dir))
    key = F.col("p_partkey")
    files = _t(spark, sf_dir, "part").select(_c("part ", key).alias("blob"), F.explode(F.array(_c("/b/", key), _c("/a/", key))).alias("path"))
    return closure.attach_paths(closed, files)


@query(f"WITH RECURSIVE {_REGION_SQL} SELECT p_partkey, p_name FROM part WHERE 'part ' || p_partkey IN (SELECT blob FROM reach WHERE root = 'region 0')")
def truncated_table(spark, sf_dir):
    closed = closure.closure(_region_graph(spark, sf_dir), _regions(spark, sf_dir).filter("root = 'region 0'"))
    table = _t(spark, sf_dir, "part").withColumn("blob", _c("part ", F.col("p_partkey")))
    return closure.truncate(table, closed).select("p_partkey", "p_name")


@query(f"WITH RECURSIVE {_REGION_SQL} SELECT root, string_agg(DISTINCT blob, ',' ORDER BY blob) AS nations, count(DISTINCT blob) AS n FROM reach WHERE depth = 1 GROUP BY root")
def subtree_files(spark, sf_dir):
    """The part files of the subtrees, read again: what the first level below each root holds."""
    closed = materialise(closure.closure(_region_graph(spark, sf_dir), _regions(spark, sf_dir)), "closed")
    entries = closed.select("blob").distinct().select("blob", F.to_json(F.struct("blob")).alias("json"))
    folder = scratch(spark, "subtrees")
    sinks.write_subtrees(closed, entries, folder, levels=2)
    first = spark.read.schema("blob string, root string, depth int, json string, level int").json(folder).filter("level = 1")
    return first.groupBy("root").agg(F.array_join(F.array_sort(F.collect_set("blob")), ",").alias("nations"), F.count_distinct("blob").alias("n"))


@query(f"WITH RECURSIVE {_REGION_SQL}, {_KNOWN_SQL}, covered AS ({_COVER_SQL} FROM (SELECT DISTINCT root, blob FROM reach) LEFT JOIN known ON k = blob GROUP BY root) SELECT root, printf('%s: %d of %d blobs known (%.2f%%)', root, n_found, n_blobs, found_pct) AS line FROM covered")
def coverage_lines(spark, sf_dir):
    return sinks.coverage_report(closure.coverage(closure.closure(_region_graph(spark, sf_dir), _regions(spark, sf_dir)), _known_parts(spark, sf_dir)))


@query("SELECT 'part ' || p_partkey AS blob, p_name AS name, 'brand ' || p_brand AS prov_pkg FROM part WHERE p_size > 10 UNION ALL SELECT 'part ' || p_partkey, p_name, NULL FROM part WHERE p_size <= 10")
def nodes_with_packages(spark, sf_dir):
    part = _t(spark, sf_dir, "part").withColumn("blob", _c("part ", F.col("p_partkey")))
    return dag.with_packages(part.select("blob", F.col("p_name").alias("name")), part.filter("p_size > 10").select("blob", F.concat(F.lit("brand "), "p_brand").alias("prov_pkg")))


@query("SELECT 'part ' || l_partkey AS blob, string_agg(DISTINCT 'pkg ' || o_orderpriority, ',' ORDER BY 'pkg ' || o_orderpriority) AS pkgs FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' GROUP BY l_partkey")
def packages_of_inputs(spark, sf_dir):
    edge = _t(spark, sf_dir, "lineitem").select(_c("order ", F.col("l_orderkey")).alias("out_blob"), _c("part ", F.col("l_partkey")).alias("in_blob"))
    infos = F.when(F.col("o_orderstatus") == "F", F.array(F.concat(F.lit("pkg "), "o_orderpriority"))).otherwise(F.array().cast("array<string>"))
    node = _t(spark, sf_dir, "orders").select(_c("order ", F.col("o_orderkey")).alias("blob"), infos.alias("pkg_infos"))
    return packages.packages_of_inputs(edge, node).withColumn("pkgs", F.array_join("pkgs", ","))


@query("SELECT s_suppkey, 'gitoid:blob:sha1:' || sha1(s_name) AS one, CASE WHEN s_suppkey % 2 = 0 THEN 'gitoid,purl,cpe23Type' ELSE 'gitoid,cpe23Type' END AS refs FROM supplier")
def external_references(spark, sf_dir):
    bom = F.sha1(F.col("s_name").cast("binary"))
    refs = spdx.external_refs(bom, F.when(F.col("s_suppkey") % 2 == 0, F.lit("pkg:x/y@1")), F.lit("cpe:2.3:a:b"))
    return _t(spark, sf_dir, "supplier").select("s_suppkey", ident.uri(bom).alias("one"), F.array_join(F.transform(refs, lambda r: r["type"]), ",").alias("refs"))


# ---- vulnerabilities


_TREE_SQL = "up AS (SELECT c_custkey AS c, c_custkey // 3 AS p FROM customer WHERE c_custkey > 0), reach AS (SELECT c_custkey AS d, c_custkey AS a FROM customer UNION SELECT d, p FROM reach JOIN up ON c = a)"


def _ancestors(spark, sf_dir):
    people = _t(spark, sf_dir, "customer")
    parents = people.filter("c_custkey > 0").select(F.col("c_custkey").cast("string").alias("commit"), F.expr("c_custkey div 3").cast("string").alias("parent"))
    return materialise(cvedb.ancestry(parents, people.select(F.col("c_custkey").cast("string").alias("commit"))), "ancestors")


@query(f"WITH RECURSIVE {_TREE_SQL} SELECT 'CVE-1-' || f.c_nationkey AS cve, CAST(a.c_custkey AS VARCHAR) AS added, CAST(f.c_custkey AS VARCHAR) AS fixed FROM customer a JOIN reach ON reach.a = a.c_custkey JOIN customer f ON f.c_custkey = reach.d AND f.c_nationkey = a.c_nationkey WHERE a.c_custkey % 2 = 0 AND f.c_custkey % 2 = 1")
def fixing_commits(spark, sf_dir):
    commits = _t(spark, sf_dir, "customer").select(_c("CVE-1-", F.col("c_nationkey")).alias("cve"), F.when(F.col("c_custkey") % 2 == 0, "Added").otherwise("Fixed").alias("kind"), F.col("c_custkey").cast("string").alias("commit"))
    return cvedb.fixing_pairs(commits, _ancestors(spark, sf_dir))


@query(f"WITH RECURSIVE {_TREE_SQL} SELECT CAST(a AS VARCHAR) AS commit, string_agg(DISTINCT 'b' || d % 5, ',' ORDER BY 'b' || d % 5) AS branches FROM reach WHERE d % 2 = 1 GROUP BY a")
def branches_of_commits(spark, sf_dir):
    people = _t(spark, sf_dir, "customer")
    name = F.when(F.col("c_custkey") % 2 == 0, _c("x -> y", F.col("c_custkey"))).otherwise(_c("b", F.col("c_custkey") % 5))
    heads = people.select(name.alias("branch"), F.col("c_custkey").cast("string").alias("commit"))
    return cvedb.branches_with(heads, _ancestors(spark, sf_dir), people.select(F.col("c_custkey").cast("string").alias("commit"))).withColumn("branches", F.array_join("branches", ","))


@query("SELECT 'b' || (p_partkey % 97) AS blob, arg_min('/' || p_name, p_partkey) AS file_path, string_agg(DISTINCT 'CVE-2020-' || p_size, ',' ORDER BY 'CVE-2020-' || p_size) AS cves FROM part GROUP BY p_partkey % 97")
def statuses_of_contents(spark, sf_dir):
    rows = _t(spark, sf_dir, "part").select(_c("CVE-2020-", F.col("p_size")).alias("cve"), _c("b", F.col("p_partkey") % 97).alias("blob"), F.concat(F.lit("/"), "p_name").alias("file_path"), F.col("p_partkey").alias("ord"))
    return cvedb.statuses_of_blobs(rows).withColumn("cves", F.array_join("cves", ","))


@query(
    """WITH h AS (SELECT o_custkey AS p, 'b' || o_orderkey AS blob, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS ord, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
    SELECT 'CVE-' || p AS cve, CAST(p AS VARCHAR) AS path, blob, CASE WHEN ord = 1 OR ord = n THEN 'cve' ELSE 'not_in_range' END AS status FROM h WHERE n > 2"""
)
def ranges_add_up(spark, sf_dir):
    """Two ranges of one file: from its start up to the second content, and from the last one on."""
    w = Window.partitionBy("o_custkey")
    o = _t(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("path"), F.row_number().over(w.orderBy("o_orderkey")).cast("long").alias("ord"), _c("b", F.col("o_orderkey")).alias("blob"), F.count(F.lit(1)).over(w).alias("n")).filter("n > 2")
    cve, zero = F.concat(F.lit("CVE-"), "path").alias("cve"), F.lit("0" * 40)
    ranges = o.filter("ord = 2").select(cve, zero.alias("lo_blob"), F.col("blob").alias("hi_blob")).unionByName(o.filter("ord = n").select(cve, F.col("blob").alias("lo_blob"), zero.alias("hi_blob")))
    return cvedb.in_ranges(o.select("path", "ord", "blob"), ranges)


@query("WITH reach AS (SELECT DISTINCT o_custkey AS c, l_partkey AS p FROM orders JOIN lineitem ON l_orderkey = o_orderkey) SELECT 'customer ' || c AS root, string_agg('part ' || p, ',' ORDER BY 'part ' || p) AS blobs FROM reach JOIN part ON p_partkey = p WHERE p % 3 = 0 AND p_size < 10 GROUP BY c")
def vulnerable_parts(spark, sf_dir):
    """What in each customer's closure has one of a few vulnerabilities."""
    hit = cvedb.vulnerable_blobs(_part_status(spark, sf_dir).filter("status = 'cve'"), spark.createDataFrame([(f"CVE-2020-{1000 + k}",) for k in range(10)], "cve string"))
    flat = hit.select(F.explode("blobs").alias("blob")).distinct()
    return _customer_closure(spark, sf_dir).join(flat, "blob").groupBy("root").agg(F.array_join(F.array_sort(F.collect_set("blob")), ",").alias("blobs"))


# ---- packages


@query("SELECT 'l' || doc_id AS line, 'b' || doc_id AS blob, CASE WHEN doc_id % 3 = 0 THEN 'rpm ' || source WHEN doc_id % 3 = 1 THEN 'inner ' || source || ' 2' ELSE 'outer 1' END AS pkg_key, CASE WHEN doc_id % 3 = 0 THEN 'provided' ELSE 'egg' END AS owner_kind FROM documents UNION ALL SELECT 'other', 'o', NULL, 'none'")
def image_owners(spark, sf_dir):
    """Files of an image: provided ones, those in an egg's folder, and in a folder inside another egg's."""
    d = F.col("doc_id")
    path = F.when(d % 3 == 1, _c("/site/", F.col("source"), "/x/", d)).otherwise(_c("/site/y/", d))
    lines = _t(spark, sf_dir, "documents").select(_c("l", d).alias("line"), _c("b", d).alias("blob"), path.alias("file_path"), F.when(d % 3 == 0, F.concat(F.lit("rpm "), "source")).alias("prov_pkg"))
    lines = lines.unionByName(spark.createDataFrame([("other", "o", "/else/z", None)], "line string, blob string, file_path string, prov_pkg string"))
    eggs = _t(spark, sf_dir, "documents").select(F.concat(F.lit("/site/"), "source").alias("folder"), F.concat(F.lit("inner "), "source").alias("name"), F.lit("2").alias("version")).distinct()
    return packages.image_packages(lines, eggs.unionByName(spark.createDataFrame([("/site", "outer", "1")], "folder string, name string, version string")))


@query("SELECT 'blob ' || sha1(text) AS line, sha1(text) AS blob, CASE WHEN doc_id % 4 = 0 THEN 'img ' || lang ELSE 'prov ' || source END AS pkg_key FROM documents WHERE doc_id % 4 < 2 AND n_chars > 100")
def owned_files(spark, sf_dir):
    d, key = F.col("doc_id"), F.sha1(F.col("text").cast("binary"))
    entries = _t(spark, sf_dir, "documents").select(
        F.concat(F.lit("blob "), key).alias("line"), F.when(d % 4 == 1, F.concat(F.lit("prov "), "source")).when(d % 4 == 2, F.lit(packages.NO_PROVIDER)).alias("prov_pkg"), F.when(d % 4 == 0, F.concat(F.lit("img "), "lang")).alias("imag_pkg"))
    return packages.owned_image_files(entries, _t(spark, sf_dir, "documents").filter("n_chars > 100").select(key.alias("blob")))


@query("SELECT p_partkey AS ord, 'f' || (p_partkey % 50) AS filename, 'b' || p_size AS blob FROM part WHERE p_partkey % 50 < 20 AND p_size % 2 = 0")
def cached_archives(spark, sf_dir):
    part = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), _c("f", F.col("p_partkey") % 50).alias("filename"), _c("b", F.col("p_size")).alias("blob"), "p_size")
    return packages.reusable_archives(part.filter("ord % 50 < 20 AND p_size % 2 = 0"), part.drop("p_size").filter("ord % 50 < 20")).join(part.filter("p_size % 2 = 0").select("ord"), "ord", "left_semi").select("ord", "filename", "blob")


@query("SELECT 'p' || n_regionkey AS out_blob, 'm' || n_nationkey AS in_blob, CAST(dense_rank() OVER (ORDER BY n_regionkey) AS BIGINT) AS seq FROM nation")
def package_steps(spark, sf_dir):
    n = _t(spark, sf_dir, "nation")
    members = n.select(_c("a", F.col("n_regionkey")).alias("archive"), F.col("n_name").alias("path"), _c("m", F.col("n_nationkey")).alias("blob"))
    whole = n.select(_c("a", F.col("n_regionkey")).alias("archive"), _c("p", F.col("n_regionkey")).alias("blob"), F.lit("i").alias("pkg_info")).distinct()
    return dag.edges(packages.package_record(whole, members)).select("out_blob", "in_blob", "seq")


@query("SELECT source AS pkg_key, count(*) AS n FROM (SELECT source, text, doc_id FROM documents UNION SELECT 'src0', text, doc_id FROM documents WHERE doc_id % 2 = 0) GROUP BY source")
def pkg_merge(spark, sf_dir):
    index = _t(spark, sf_dir, "documents").select(F.col("source").alias("pkg_key"), ident.gitoid_of_text(F.col("text")).alias("blob"), F.col("doc_id").cast("string").alias("path"))
    return packages.merged(index, index.filter("path % 2 = 0").withColumn("pkg_key", F.lit("src0"))).groupBy("pkg_key").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'd' || doc_id AS blob, CASE WHEN lang = 'de' THEN 'INDEX best ' || source ELSE 'DERIVED_PKG ' || source || ' 1.' || (doc_id % 5) END AS pkg_key FROM documents")
def sbom_from_index(spark, sf_dir):
    """The best package of an index goes after a name that a path tells."""
    d = F.col("doc_id")
    path = F.when(F.col("lang") == "de", _c("/plain/", d)).otherwise(F.concat(F.lit("/usr/src/"), "source", _c("-1.", d % 5, "/lib/", d, ".c")))
    none = F.lit(None)
    node = _t(spark, sf_dir, "documents").select(_c("d", d).alias("blob"), path.alias("file_path"), none.cast("string").alias("prov_pkg"), none.cast("array<string>").alias("pkgs"))
    best = _t(spark, sf_dir, "documents").select(_c("d", d).alias("blob"), F.lit("best").alias("name"), F.col("source").alias("version"))
    groups = packages.sbom_groups(node.select(F.lit("r").alias("root"), "blob"), node, best)
    return groups.select(F.explode("blobs").alias("blob"), "pkg_key")


# ---- names


@query(
    """SELECT p_partkey, 'tool' || p_size AS image, p_size || '.' || (p_partkey % 9) AS version, 'https://h/r' || p_partkey || '.git' AS git, 'r' || p_partkey AS folder, CASE WHEN p_partkey % 2 = 0 THEN 'OpenSSL_1_1_' || p_size ELSE 'openssl-3.0.' || p_size END AS openssl,
    'a-' || p_size || '-%{other}-' || p_size || '.patch' AS spec, CASE p_partkey % 3 WHEN 0 THEN 'http://archive.ubuntu.com/ubuntu' WHEN 1 THEN 'http://ftp.debian.org/debian' ELSE '' END AS mirror, '/usr/lib64/x' AS usr FROM part"""
)
def release_names(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    told = text.image_name_version(_c("tool", s, "-", s, ".", k % 9, "-x86.img"))
    url = F.when(k % 3 == 0, _c("git://h/r", k, ".git;branch=x")).when(k % 3 == 1, _c("git+https://h/r", k, ".git")).otherwise(_c("gitsm://h/r", k, ".git;protocol=https"))
    spec = text.without_macro(text.without_macro(_c("a-%{?version}-%{other}-%{version}.patch"), "version", s.cast("string")), "version", s.cast("string"))
    release = F.when(k % 3 == 0, F.lit("jammy")).when(k % 3 == 1, F.lit("bookworm")).otherwise(F.lit("none"))
    return _t(spark, sf_dir, "part").select(
        "p_partkey", told["name"].alias("image"), told["version"].alias("version"), text.plain_git_url(url).alias("git"), text.clone_folder(text.plain_git_url(url)).alias("folder"),
        text.openssl_url_version(F.when(k % 2 == 0, _c("1.1.", s)).otherwise(_c("3.0.", s))).alias("openssl"), spec.alias("spec"), text.release_mirror(release).alias("mirror"), text.merged_usr(F.lit("/lib64/x")).alias("usr"),
    )


@query(
    """SELECT p_partkey, unnest(['lib' || p_size || '_1.2.orig.tar.xz', 'a' || p_size || '_1.2-3.debian.tar.xz', 'b-c-' || p_size || '.0.tar.gz', 'd-v' || p_size || '.1.zip', 'v' || p_size || '.5.tgz', 'plain.tar.bz2']) AS file,
    unnest(['lib' || p_size, 'a' || p_size, 'b-c', 'd', '', 'plain']) AS name, unnest(['1.2', '1.2-3', p_size || '.0', 'v' || p_size || '.1', 'v' || p_size || '.5', '']) AS version FROM part"""
)
def archive_names(spark, sf_dir):
    s = F.col("p_size")
    files = F.array(_c("lib", s, "_1.2.orig.tar.xz"), _c("a", s, "_1.2-3.debian.tar.xz"), _c("b-c-", s, ".0.tar.gz"), _c("d-v", s, ".1.zip"), _c("v", s, ".5.tgz"), F.lit("plain.tar.bz2"))
    rows = _t(spark, sf_dir, "part").select("p_partkey", F.explode(files).alias("file"))
    told = text.archive_name_version(F.col("file"))
    return rows.select("p_partkey", "file", told["name"].alias("name"), told["version"].alias("version"))


@query("SELECT page_id, '/' || array_to_string(list_filter(string_split(regexp_replace(url, '^[a-z]+:', '/w'), '/'), lambda x: x <> ''), '/') AS path, regexp_matches(url, 'example') AS is_hexless FROM pages")
def paths_of_pages(spark, sf_dir):
    """Addresses as relative paths: empty parts go, and the working folder comes in front."""
    inside = F.regexp_replace("url", "^[a-z]+:", ".")
    return _t(spark, sf_dir, "pages").select("page_id", text.normal_path(inside, F.lit("/w")).alias("path"), (~ident.is_hex(F.col("url"))).alias("is_hexless"))


_SIMILAR = """list_sum(list_transform(range(1, least(len({a}), len({b})) + 1), lambda k: CASE WHEN {a}[1:k] = {b}[1:k] THEN 1 ELSE 0 END))"""


@query(
    f"""WITH p AS (SELECT DISTINCT url, string_split(url, '/') AS u FROM pages), k AS (SELECT *, regexp_extract(url, '([^/?#]*)/?(?:[?#].*)?$', 1) AS base, list_reverse(u[1:len(u) - 1]) AS f FROM p),
    s AS (SELECT a.url AS path, 'mirror/' || b.url AS match, b.url AS ord, coalesce({_SIMILAR.format(a='a.u', b="list_prepend('mirror', b.u)")}, 0) + coalesce({_SIMILAR.format(a='a.f', b="list_append(b.f, 'mirror')")}, 0) AS score FROM k a JOIN k b ON a.base = b.base),
    r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, ord) AS n FROM s WHERE score >= 2)
    SELECT path, match, CAST(score AS INTEGER) AS score FROM r WHERE n = 1"""
)
def path_similarity_top1(spark, sf_dir):
    """Each address and the one of its last part, in a mirror's folder, whose folders are most alike: its own copy."""
    pages = _t(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.regexp_extract("url", r"([^/?#]*)/?(?:[?#].*)?$", 1).alias("base")).distinct()
    sources = pages.select(F.concat(F.lit("mirror/"), "path").alias("path"), "base", F.col("path").alias("ord"))
    return matching.most_similar(pages, sources, least=2)


@query(
    """SELECT '/bin/app' || s_suppkey AS path, unnest(['base.so', 'own.so', 'both.so']) AS soname, unnest(['/lib/base.so', '/run' || s_suppkey % 3 || '/own.so', '/lib/both.so']) AS lib_path FROM supplier"""
)
def library_priorities(spark, sf_dir):
    """The base map goes first, then the extra one, and a file's run paths, in their order, come last."""
    k = F.col("s_suppkey") % 3
    elf = _t(spark, sf_dir, "supplier").select(_c("/bin/app", F.col("s_suppkey")).alias("path"), F.lit(64).alias("bits"), F.array(F.lit("base.so"), F.lit("own.so"), F.lit("both.so"), F.lit("none.so")).alias("needed"), F.array(F.lit("/nowhere"), _c("/run", k), _c("/run", (k + 1) % 3)).alias("rpath"))
    lib = spark.createDataFrame([(64, "base.so", "/lib/base.so", 0), (64, "base.so", "/extra/base.so", 1), (64, "both.so", "/extra/both.so", 1), (64, "both.so", "/lib/both.so", 0), (32, "none.so", "/lib32/none.so", 0)], "bits int, soname string, path string, prio int")
    runs = spark.createDataFrame([(64, "own.so", f"/run{n}/own.so", 2) for n in range(3)], lib.schema)
    # Libraries of run paths are in no map: only a file's own search finds them.
    mapped = matching.needed_libraries(elf.withColumn("needed", F.array(F.lit("base.so"), F.lit("both.so"), F.lit("none.so"))), lib)
    searched = matching.searched_libraries(elf, runs).filter("soname = 'own.so'")
    return mapped.unionByName(searched)


# ---- bills of materials


@query(
    """SELECT 'SPDXRef-Package-' || substr(sha256('pkg ' || source), 1, 16) AS spdx_id, count(*) AS n FROM documents WHERE source NOT IN ('src1', 'src2') GROUP BY source
    UNION ALL SELECT 'known ' || source, count(*) FROM documents WHERE source IN ('src1', 'src2') GROUP BY source"""
)
def spdx_package_ids(spark, sf_dir):
    """Packages that a document has already keep their id."""
    d = _t(spark, sf_dir, "documents").withColumn("pkg_key", F.concat(F.lit("pkg "), "source"))
    existing = d.filter("source IN ('src1', 'src2')").select(F.col("pkg_key").alias("file_name"), F.concat(F.lit("known "), "source").alias("spdx_id")).distinct()
    wanted = spdx.wanted_packages(d.select("pkg_key").distinct().unionByName(spark.createDataFrame([(packages.UNKNOWN,), ("DERIVED_PKG x 1",), (None,)], "pkg_key string")))
    return d.join(spdx.reuse_existing(wanted, existing), "pkg_key").groupBy("spdx_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT lang AS doc, 'p' || doc_id AS spdx_id, CASE WHEN doc_id = min(doc_id) FILTER (WHERE doc_id % 3 = 0) OVER (PARTITION BY lang) THEN 'x,gitoid:blob:sha1:' || sha1(lang) WHEN doc_id % 3 = 0 THEN 'x' ELSE '' END AS refs FROM documents")
def spdx_inserted_refs(spark, sf_dir):
    d = F.col("doc_id")
    one = F.array(F.struct(F.lit("OTHER").alias("category"), F.lit("t").alias("type"), F.lit("x").alias("locator")))
    rows = _t(spark, sf_dir, "documents").select(F.col("lang").alias("doc"), d.alias("ord"), _c("p", d).alias("spdx_id"), F.when(d % 3 == 0, one).otherwise(F.filter(one, lambda r: F.lit(False))).alias("refs"))
    bom = rows.select("doc", F.sha1(F.col("doc").cast("binary")).alias("bom_id")).distinct()
    return spdx.insert_ref_packages(rows, bom).select("doc", "spdx_id", F.array_join(F.transform("refs", lambda r: r["locator"]), ",").alias("refs"))


@query("SELECT lang AS doc, 'pkg ' || source AS src, 'CONTAINS' AS type, 'f' || doc_id AS dst FROM documents WHERE source <> 'src0' UNION ALL SELECT lang, 'SPDXRef-Image', 'CONTAINS', 'f' || doc_id FROM documents WHERE source = 'src0'")
def image_relationships(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    sub = d.filter("source <> 'src0'").select(F.col("lang").alias("doc"), F.col("source").alias("pkg_key"), F.concat(F.lit("pkg "), "source").alias("spdx_id")).distinct()
    return spdx.image_contents(sub, d.select(F.col("lang").alias("doc"), F.col("source").alias("pkg_key"), _c("f", F.col("doc_id")).alias("spdx_id")))


@query("SELECT doc_id, lang AS doc, 'SPDXRef-File-' || substr(sha256(lang || chr(31) || 'd' || doc_id || '.c'), 1, 16) AS spdx_id, 'SOURCE' AS file_type, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents")
def spdx_files(spark, sf_dir):
    files = _t(spark, sf_dir, "documents").select(F.col("lang").alias("doc"), _c("d", F.col("doc_id"), ".c").alias("name"), F.col("text").cast("binary").alias("content"))
    return spdx.file_rows(files).select(F.regexp_extract("name", r"d(\d+)", 1).cast("long").alias("doc_id"), "doc", "spdx_id", "file_type", "sha1", "sha256")


@query("SELECT 'r' || n_regionkey AS doc, 'SPDX-2.3' AS version, 'name ' || n_regionkey AS name, count(*) AS n_packages, string_agg(sha1(n_name), ',' ORDER BY n_nationkey) AS digests, count(*) AS n_links, max('PackageName: ' || n_name) AS last_line FROM nation GROUP BY n_regionkey")
def spdx_texts(spark, sf_dir):
    """Documents as JSON, read again, and as tag-value text."""
    key, n = F.col("n_nationkey"), _t(spark, sf_dir, "nation")
    doc = _c("r", F.col("n_regionkey")).alias("doc")
    top = n.select(doc, _c("name ", F.col("n_regionkey")).alias("name"), F.lit("2020-01-01T00:00:00Z").alias("created")).distinct()
    ref = F.array(F.struct(F.lit("c").alias("category"), F.lit("t").alias("type"), F.lit("l").alias("locator")))
    pkgs = n.select(doc, _c("p", key).alias("spdx_id"), F.col("n_name").alias("name"), F.lit("1").alias("version"), ref.alias("refs"))
    files = n.select(doc, F.concat(F.lit("f"), F.lpad(key.cast("string"), 6, "0")).alias("spdx_id"), F.col("n_name").alias("name"), F.sha1(F.col("n_name").cast("binary")).alias("sha1"), F.lit("z").alias("sha256"))
    links = n.select(doc, F.lit("a").alias("src"), F.lit("CONTAINS").alias("type"), _c("f", key).alias("dst"))
    shape = "spdxVersion string, name string, packages array<struct<SPDXID:string>>, files array<struct<checksums:array<struct<algorithm:string,checksumValue:string>>>>, relationships array<struct<relatedSpdxElement:string>>"
    told = spdx.to_json(top, pkgs, files, links).select("doc", F.from_json("json", shape).alias("j"))
    lines = spdx.to_tag_value(pkgs).select("doc", F.array_max(F.filter(F.split("text", "\n"), lambda x: F.startswith(x, F.lit("PackageName: ")))).alias("last_line"))
    return told.join(lines, "doc").select(
        "doc", F.col("j.spdxVersion").alias("version"), F.col("j.name").alias("name"), F.size("j.packages").cast("long").alias("n_packages"),
        F.array_join(F.transform("j.files", lambda f: f["checksums"][0]["checksumValue"]), ",").alias("digests"), F.size("j.relationships").cast("long").alias("n_links"), "last_line",
    )

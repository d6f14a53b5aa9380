"""Vulnerability, package, process, matching, SPDX and streaming operators on small tables."""

import datetime

from pyspark.sql import functions as F

from stemma.functions import text
from stemma.operators import cvedb, matching, packages, processes, spdx
from stemma.sources import sinks
from stemma.streaming import pipelines


def val(spark, column):
    return spark.range(1).select(column).first()[0]


def test_paths_and_versions(spark):
    lit = F.lit
    assert val(spark, text.normal_path(lit("../a/./b"), lit("/x/y"))) == "/x/a/b" and val(spark, text.normal_path(lit("/../../a"))) == "/a"
    assert val(spark, text.normal_path(lit("b"), lit("/x"), lit("/root/"))) == "/root/x/b" and val(spark, text.merged_usr(lit("/lib/x"))) == "/usr/lib/x"
    assert val(spark, text.common_prefix_length(lit("abcd"), lit("abxy"))) == 2 and val(spark, text.common_suffix_length(lit("xyz"), lit("xyz"))) == 3 and val(spark, text.common_prefix_length(lit(""), lit("a"))) == 0
    assert val(spark, text.path_similarity(lit("a/b/c.java"), lit("a/b/c.class"))) == 4
    for v, ok in (("1.2.3", True), ("v4.2.8p15", True), ("2.31+gitAUTOINC+d4b75_cd9", True), ("1.2-r0", True), ("219", False), ("x1.2", False), ("1.2.3.4.5.6.7.8", False), ("", False)):
        assert val(spark, text.is_version(lit(v))) is ok, v
    assert val(spark, text.is_dotted_version(lit("219"), lit("systemd")))
    for path, name, version in (
        ("/usr/src/debug/zlib/1.2.11-r0/zlib-1.2.11/a.c", "zlib", "1.2.11"), ("/b/openssl/3.0.1/ssl/a.c", "openssl", "3.0.1"), ("/x/y/a.c", None, None),
        ("/w/foo-bar-2.1-beta/src/a.c", "foo-bar", "2.1-beta"), ("/lib/systemd-219/x.c", "systemd", "219"), ("libz-1.2.so", "libz", "1.2.so"),
    ):
        got = val(spark, text.component_of_path(lit(path)))
        assert (got["name"], got["version"]) == (name, version), path
    for f, name, version in (("hello_2.10.orig.tar.gz", "hello", "2.10"), ("hello_2.10-3.debian.tar.xz", "hello", "2.10-3"), ("zlib-1.2.11.tar.gz", "zlib", "1.2.11"), ("v1.2.tgz", "", "v1.2"), ("name.tar.xz", "name", "")):
        got = val(spark, text.archive_name_version(lit(f)))
        assert (got["name"], got["version"]) == (name, version), f
    got = val(spark, text.image_name_version(lit("openwrt-22.03.2-x86.img")))
    assert (got["name"], got["version"]) == ("openwrt", "22.03.2")
    assert val(spark, text.without_macro(lit("a-%{?dist}-%{dist}"), "dist", lit("el8"))) == "a-el8-%{dist}"
    assert val(spark, text.plain_git_url(lit("git://h/x.git;branch=main"))) == "https://h/x.git" and val(spark, text.clone_folder(lit("https://h/x.git"))) == "x"
    assert val(spark, text.openssl_url_version(lit("1.1.1k"))) == "OpenSSL_1_1_1k" and val(spark, text.deb_pool_url(lit("https://m"), lit("bash"), lit("f"))) == "https://m/pool/main/b/bash/f"
    assert [val(spark, text.is_source_file(lit(p))) for p in ("a/b.c", "README", "x.txt", "a.S", "noext")] == [True, False, False, True, False]
    info = F.array(*[lit(x) for x in ("Name : x", "License: GPL", "Description :", "line one", "line two")])
    assert val(spark, text.info_field(info, "Name")) == "x" and val(spark, text.info_field(info, "License")) == "GPL" and val(spark, text.info_description(info)) == "line one\nline two"
    assert val(spark, text.file_kind(lit(b"\x7fELF"))) == "elf" and val(spark, text.spdx_file_type(lit("a.c"), lit(b"int"))) == "SOURCE" and val(spark, text.spdx_file_type(lit("a.txt"), lit(b"x"))) == "TEXT"
    assert val(spark, text.purl("deb", lit("debian"), lit("a+b"), lit("1:2"), arch=lit(""))) == "pkg:deb/debian/a%2Bb@1%3A2"


def test_rule_predicates(spark):
    groups = lambda *g: F.array(*[F.array(*map(F.lit, x)) for x in g])
    none = F.array().cast("array<array<string>>")
    assert val(spark, text.rule_holds(F.lit("one two"), groups(["one"], ["x", "two"]), none)) and not val(spark, text.rule_holds(F.lit("one two"), groups(["one"]), groups(["two"])))
    assert val(spark, text.rule_verdict(F.lit(True), F.lit(True))) == "fixed" and val(spark, text.rule_verdict(F.lit(False), F.lit(False))) is None


def test_suffixes_and_history(spark):
    paths = spark.createDataFrame([("/x/src/a.c",), ("/x/ba.c",), ("/x/z.h",)], "path string")
    rules = spark.createDataFrame([("a.c", 2), ("src/a.c", 1), ("none.c", 0)], "src_file string, rule_ord int")
    assert {tuple(r) for r in cvedb.suffix_matches(paths, rules).collect()} == {("/x/src/a.c", "src/a.c"), ("/x/ba.c", "a.c")}
    assert cvedb.suffix_matches(paths, rules.limit(0)).count() == 0
    history = spark.createDataFrame([("f", n, b) for n, b in enumerate("edcba")], "path string, ord long, blob string")
    fixes = spark.createDataFrame([("C1", "f", "b", "c"), ("C2", "f", "unknown", "d")], "cve string, path string, pre_blob string, post_blob string")
    got = {(r["cve"], r["blob"]): r["status"] for r in cvedb.split_history(history, fixes).collect()}
    assert got == {("C1", "a"): "cve", ("C1", "b"): "cve", ("C1", "c"): "fixed", ("C1", "d"): "fixed", ("C1", "e"): "fixed", ("C2", "unknown"): "cve", ("C2", "d"): "fixed", ("C2", "e"): "fixed"}
    oldest = spark.createDataFrame([("f", n, b) for n, b in enumerate("abcde")], "path string, ord long, blob string")
    ranges = spark.createDataFrame([("C", "b", "c"), ("C", "d", "0" * 40), ("D", "0" * 40, "b")], "cve string, lo_blob string, hi_blob string")
    got = {(r["cve"], r["blob"]) for r in cvedb.in_ranges(oldest, ranges).filter("status = 'cve'").collect()}
    assert got == {("C", "b"), ("C", "d"), ("C", "e"), ("D", "a")}
    parents = spark.createDataFrame([("c", "b"), ("b", "a"), ("d", "a")], "commit string, parent string")
    up = cvedb.ancestry(parents, spark.createDataFrame([("c",), ("d",)], "commit string"))
    assert {tuple(r) for r in up.collect()} == {("c", "c"), ("c", "b"), ("c", "a"), ("d", "d"), ("d", "a")}
    commits = spark.createDataFrame([("C", "Added", "a"), ("C", "Fixed", "c"), ("D", "Added", "b"), ("D", "Fixed", "d")], "cve string, kind string, commit string")
    assert [tuple(r) for r in cvedb.fixing_pairs(commits, up).collect()] == [("C", "a", "c")]
    heads = spark.createDataFrame([("main", "c"), ("old", "d"), ("HEAD -> main", "c")], "branch string, commit string")
    got = {r["commit"]: r["branches"] for r in cvedb.branches_with(heads, up, spark.createDataFrame([("a",), ("b",)], "commit string")).collect()}
    assert got == {"a": ["main", "old"], "b": ["main"]}
    hints = spark.createDataFrame([("x", "p", ["C1"], ["C2"])], "blob string, path string, has_cve array<string>, fixed_cve array<string>")
    assert {(r["cve"], r["status"]) for r in cvedb.hint_rows(hints).collect()} == {("C1", "hint_cve"), ("C2", "hint_fixed")}


def test_image_packages(spark):
    lines = spark.createDataFrame([(1, "a", "/usr/lib/py/six/x.py", None), (2, "b", "/usr/bin/ls", "coreutils"), (3, "c", "/etc/x", None)], "line int, blob string, file_path string, prov_pkg string")
    eggs = spark.createDataFrame([("/usr/lib/py/six", "six", "1.16"), ("/usr/lib", "base", "1")], "folder string, name string, version string")
    got = {r["line"]: (r["pkg_key"], r["owner_kind"]) for r in packages.image_packages(lines, eggs).collect()}
    assert got == {1: ("six 1.16", "egg"), 2: ("coreutils", "provided"), 3: (None, "none")}
    cache = spark.createDataFrame([("a.tgz", "1"), ("a.tgz", "2")], "filename string, blob string")
    assert packages.reusable_archives(spark.createDataFrame([("a.tgz", "2")], "filename string, blob string"), cache).count() == 1


def test_process_trees(spark):
    spawns = spark.createDataFrame([(1, 10, 1), (3, 11, 10), (5, 12, 11), (9, 11, 12)], "line_no long, pid long, parent long")
    named = processes.named_processes(spawns)
    got = {r["proc"]: r["parent_proc"] for r in named.collect()}
    assert got == {"10@1": None, "11@3": "10@1", "12@5": "11@3", "11@9": "12@5"}
    deep = processes.depths(named)
    assert {r["proc"]: r["depth"] for r in deep.collect()} == {"10@1": 0, "11@3": 1, "12@5": 2, "11@9": 3}
    assert processes.tree_summary(deep).first()["max_depth"] == 3
    lines = spark.createDataFrame([(4, 11, "x"), (10, 11, "y"), (2, 10, "z")], "line_no long, pid long, raw string")
    assert {r["line_no"]: r["text"] for r in processes.indented(lines, named, deep).collect()} == {4: "  x", 10: "      y", 2: "z"}
    tree = processes.command_trees(named.withColumn("prog", F.lit("p")), deep).first()["tree"]
    assert tree == "10@1 p\n  11@3 p\n    12@5 p\n      11@9 p"


def test_java_and_libraries(spark):
    classes = spark.createDataFrame([("/out/com/x/A$B.class",), ("/out/com/y/A.class",)], "path string")
    java = spark.createDataFrame([("/src/com/x/A.java",), ("/src/com/y/A.java",)], "path string")
    assert matching.class_sources(classes, java).count() == 2
    assert matching.most_similar(spark.createDataFrame([("/p", "b")], "path string, base string"), spark.createDataFrame([("/q/r", "b", 1)], "path string, base string, ord int")).count() == 0
    elf = spark.createDataFrame([("/bin/a", 64, ["x.so", "own.so", "gone.so"], ["/opt"]), ("/lib/x.so", 64, ["y.so"], [])], "path string, bits int, needed array<string>, rpath array<string>")
    lib = spark.createDataFrame([(64, "x.so", "/lib/x.so", 0), (32, "x.so", "/lib32/x.so", 0), (64, "y.so", "/extra/y.so", 1)], "bits int, soname string, path string, prio int")
    own = spark.createDataFrame([(64, "own.so", "/opt/own.so", 5)], "bits int, soname string, path string, prio int")
    got = matching.library_closure(elf, lib.unionByName(own), spark.createDataFrame([("/bin/a",)], "root string"))
    assert {r["blob"]: r["depth"] for r in got.collect()} == {"/bin/a": 0, "/lib/x.so": 1, "/opt/own.so": 1, "/extra/y.so": 2}
    imports = spark.createDataFrame([("/p/q/m.py", "near", 1), ("/p/q/m.py", "top.sub", 0), ("/p/q/near.py", "m", 1), ("/p/q/m.py", "up", 2)], "path string, module string, level int")
    files = spark.createDataFrame([("/p/q/m.py",), ("/p/q/near.py",), ("/s/top/sub/__init__.py",), ("/p/up.py",)], "path string")
    got = matching.import_closure(imports, files, spark.createDataFrame([("/p/q/m.py",)], "root string"))
    assert {r["blob"] for r in got.collect()} == {"/p/q/m.py", "/p/q/near.py", "/s/top/sub/__init__.py", "/p/up.py"}


def test_spdx_documents(spark):
    import json

    doc = spark.createDataFrame([("d", "n", "2020-01-01T00:00:00Z")], "doc string, name string, created string")
    files = spdx.file_rows(spark.createDataFrame([("d", "a.c", b"x"), ("d", "b.bin", b"\x7fELF")], "doc string, name string, content binary"))
    pkgs = spark.createDataFrame([("d", "SPDXRef-P", "p", "1")], "doc string, spdx_id string, name string, version string")
    rel = spdx.relationships(pkgs.select("doc", "spdx_id"), files, pkgs.select("doc", "spdx_id").limit(0), pkgs.select("doc", "spdx_id").limit(0))
    body = json.loads(spdx.to_json(doc, pkgs, files, rel).first()["json"])
    assert body["spdxVersion"] == "SPDX-2.3" and len(body["files"]) == 2 and len(body["relationships"]) == 3 and body["packages"][0]["versionInfo"] == "1"
    refs = spdx.external_refs(F.lit("ab"), F.lit("pkg:rpm/x"), F.lit(None).cast("string"))
    assert [r["locator"] for r in val(spark, refs)] == ["gitoid:blob:sha1:ab", "pkg:rpm/x"]
    tag = spdx.to_tag_value(pkgs.withColumn("refs", refs)).first()["text"]
    assert "PackageName: p" in tag and "ExternalRef: PERSISTENT-ID gitoid gitoid:blob:sha1:ab" in tag
    rows = [("d", 1, "a", []), ("d", 2, "b", [("c", "t", "l")]), ("e", 1, "x", [])]
    table = spark.createDataFrame(rows, "doc string, ord int, spdx_id string, refs array<struct<category:string,type:string,locator:string>>")
    bom = spark.createDataFrame([("d", "ff"), ("e", "ee")], "doc string, bom_id string")
    sizes = lambda df: {r["spdx_id"]: len(r["refs"]) for r in df.collect()}
    assert sizes(spdx.insert_ref_packages(table, bom)) == {"a": 0, "b": 2, "x": 0} and sizes(spdx.insert_ref_packages(table, bom, force=True)) == {"a": 0, "b": 2, "x": 1}
    text_doc = spark.createDataFrame([("a", "x\nExternalRef: q\ny", "ff"), ("b", "x\nPackageChecksum: z", "ff"), ("c", "x", None)], "doc string, text string, bom_id string")
    got = {r["doc"]: r["text"] for r in spdx.insert_ref_tag_value(text_doc).collect()}
    assert got["a"].split("\n")[2].startswith("ExternalRef: PERSISTENT-ID") and got["b"] == "x\nPackageChecksum: z" and got["c"] == "x"
    assert {r["doc"]: r["text"] for r in spdx.insert_ref_tag_value(text_doc, force=True).collect()}["b"].split("\n")[1].startswith("ExternalRef:")
    assert spdx.image_contents(pkgs.withColumn("pkg_key", F.lit("k")), files.withColumn("pkg_key", F.lit("k"))).count() == 2
    kept = spdx.wanted_packages(spark.createDataFrame([("",), ("UNKNOWN_COMPONENT_VERSION",), ("DERIVED_PKG x 1",), ("real",)], "pkg_key string"))
    assert [r["pkg_key"] for r in kept.collect()] == ["real"]


def test_node_export(spark):
    import json

    node = spark.createDataFrame([("a", ["p", "q"], ["c"], [], [], None)], "blob string, file_paths array<string>, build_cmds array<string>, build_tools array<string>, pkg_infos array<string>, prune string")
    edge = spark.createDataFrame([("a", "z"), ("a", "y")], "out_blob string, in_blob string")
    assert json.loads(sinks.node_json(node, edge).first()["json"]) == {"file_path": "p", "file_paths": ["p", "q"], "hash_tree": ["y", "z"], "build_cmd": "c"}


def test_streams(spark, tmp_path):
    logs, out = tmp_path / "logs", tmp_path / "out"
    logs.mkdir()
    stanza = "outfile: {0} path: /{0}\ninfile: {1} path: /{1}\nbuild_cmd: x\n==== End of raw info for this process\n\n"
    (logs / "one").write_text(stanza.format("aa", "bb"))
    run = lambda: pipelines.ingest(spark, str(logs), str(out), str(tmp_path / "check")).awaitTermination()
    run()
    (logs / "two").write_text(stanza.format("cc", "aa"))
    run()
    run()
    assert {(r["out_blob"], r["in_blob"]) for r in spark.read.parquet(str(out / "edges")).collect()} == {("aa", "bb"), ("cc", "aa")}
    rows = [("k", 1, "a"), ("k", 2, "b"), ("k", 3, "a")], [("k", 4, "b"), ("j", 1, "b"), ("k", 5, "b")]
    for n, part in enumerate(rows):
        spark.createDataFrame(part, "key string, order long, kind string").selectExpr("cast(ascii(key) as long) as key", "order", "kind").coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
        events = spark.readStream.schema("key long, order long, kind string").parquet(str(tmp_path / "events"))
        pipelines.pair_micro_batches(events, "a", "b", str(tmp_path / "pairs"), str(tmp_path / "check2")).awaitTermination()
    assert {(r["before_order"], r["after_order"]) for r in spark.read.parquet(str(tmp_path / "pairs/pairs")).collect()} == {(1, 2), (3, 4)}
    spark.createDataFrame([(1, "v", 1.0, datetime.datetime(2024, 1, 1, 0, 1)), (2, "v", 2.0, datetime.datetime(2024, 1, 1, 0, 3)), (1, "w", 3.0, datetime.datetime(2024, 1, 1, 1, 0))], "user_id long, event_type string, value double, ts timestamp_ntz").write.parquet(str(tmp_path / "timed"))
    timed = spark.read.parquet(str(tmp_path / "timed"))
    assert {(r["event_type"], r["n"], r["total"]) for r in pipelines.event_windows(timed).collect()} == {("v", 2, 3.0), ("w", 1, 3.0)}
    assert pipelines.event_windows(timed, slide="1 minute").count() == 12 and pipelines.event_sessions(timed).count() == 3


def test_stateful_pairs(spark, tmp_path):
    for part in ([(1, 1, "a"), (1, 2, "b"), (1, 3, "a")], [(1, 4, "b"), (2, 1, "b"), (1, 5, "b"), (2, 7, "x")]):
        spark.createDataFrame(part, "key long, order long, kind string").coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
        events = spark.readStream.schema("key long, order long, kind string").parquet(str(tmp_path / "events"))
        query = pipelines.pair_stream(events, "a", "b").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(once=True).start()
        assert query.awaitTermination(60)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [(1, 1, 2), (1, 3, 4)]


def test_overlays_of_logs_and_packages(spark):
    from stemma.operators import dag

    one = spark.createDataFrame([(1, "a"), (2, "b")], "seq long, out_blob string")
    got = dag.concatenated_logs([one, one, one.limit(0)]).collect()
    assert sorted((r["seq"], r["out_blob"]) for r in got) == [(1, "a"), (2, "b"), (4, "a"), (5, "b")]
    node = spark.createDataFrame([("x", ["p 1"]), ("y", [])], "blob string, pkg_infos array<string>")
    edge = spark.createDataFrame([("x", "m"), ("y", "m"), ("y", "n")], "out_blob string, in_blob string")
    assert {r["blob"]: r["pkgs"] for r in packages.packages_of_inputs(edge, node).collect()} == {"m": ["p 1"]}
    told = dag.with_packages(spark.createDataFrame([("m",), ("k",)], "blob string"), spark.createDataFrame([("m", "p")], "blob string, prov_pkg string"))
    assert {r["blob"]: r["prov_pkg"] for r in told.collect()} == {"m": "p", "k": None}
    status = cvedb.statuses_of_blobs(spark.createDataFrame([("C2", "m", "b.c", 2), ("C1", "m", "a.c", 1)], "cve string, blob string, file_path string, ord int")).first()
    assert (status["file_path"], status["cves"]) == ("a.c", ["C1", "C2"])
    covered = spark.createDataFrame([("r", 4, 1, 25.0)], "root string, n_blobs long, n_found long, found_pct double")
    assert sinks.coverage_report(covered).first()["line"] == "r: 1 of 4 blobs known (25.00%)"


def test_subtree_files(spark, tmp_path):
    closed = spark.createDataFrame([("r", "r", 0), ("r", "a", 1), ("r", "b", 2)], "root string, blob string, depth int")
    sinks.write_subtrees(closed, spark.createDataFrame([("a", "{}")], "blob string, json string"), str(tmp_path / "parts"))
    assert {(r["blob"], r["level"]) for r in spark.read.json(str(tmp_path / "parts")).collect()} == {("r", 0), ("a", 1), ("b", 1)}

"""Identifiers, graph building and Merkle ids against published values, and properties that must hold."""

import hashlib
import random

from pyspark.sql import functions as F

from stemma.functions import ident
from stemma.operators import closure, dag, merkle, processes
from stemma.sources import rawlog
from tests.core import fixtures as fx


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def links(spark, pairs):
    return spark.createDataFrame(pairs, "out_blob string, in_blob string")


def log_text():
    text = ""
    for out, path, ins, cmd in ((fx.OBJECT, "/src/hello.o", fx.OBJECT_INPUTS, "cc -c -o hello.o hello.c"), (fx.PROGRAM, "/src/hello", fx.PROGRAM_INPUTS, "ld -o hello"), (fx.PROGRAM, "/src/hello", [fx.OBJECT], "cc -o hello hello.o")):
        text += f"\noutfile: {out} path: {path}\n" + "".join(f"infile: {b} path: /in/{b[:6]}\n" for b in ins) + f"build_cmd: {cmd}\n==== End of raw info for this process\n\n"
    return text


def test_identifiers(spark):
    assert one(spark, ident.gitoid(F.lit(b""))) == hashlib.sha1(b"blob 0\0").hexdigest()
    text = "größe\n"
    raw = text.encode()
    assert one(spark, ident.gitoid_of_text(F.lit(text))) == hashlib.sha1(b"blob %d\0" % len(raw) + raw).hexdigest()
    assert one(spark, ident.gitoid_of_text(F.lit(text), "sha256")) == hashlib.sha256(b"blob %d\0" % len(raw) + raw).hexdigest()
    pairs = [x.split() for x in fx.ARCHIVE_LINES]
    assert one(spark, ident.bom_id(F.array(*[ident.doc_line(F.lit(b), F.lit(c)) for b, c in reversed(pairs)]), with_header=False)) == fx.ARCHIVE_BOM
    b, c = fx.UNARY_LINE.split()
    assert one(spark, ident.bom_id(F.array(ident.doc_line(F.lit(b), F.lit(c))), with_header=False)) == fx.UNARY_BOM
    parsed = one(spark, ident.parse_line(F.lit(f"blob {b} bom {c}")))
    assert (parsed["blob"], parsed["bom"]) == (b, c)
    assert one(spark, ident.parse_line(F.lit(b)))["bom"] is None and one(spark, ident.parse_line(F.lit("blob xyz")))["blob"] is None
    note = ident.embedded_note(F.lit(b), F.lit("ab" * 32), "OWNER.")
    assert one(spark, ident.read_embedded_note(F.concat(F.lit(b"xx"), note), "OWNER.")) == b and one(spark, ident.read_embedded_note(note, "OWNER.", "sha256")) == "ab" * 32


def test_published_log(spark, tmp_path):
    (tmp_path / "log").write_text(log_text())
    records = rawlog.read_raw_log(spark, str(tmp_path / "log"))
    rows = records.orderBy("seq").collect()
    assert [len(r["infiles"]) for r in rows] == [22, 8, 1]
    edge = dag.edges(records)
    assert dag.merged_edges(edge).groupBy("out_blob").count().filter(F.col("out_blob") == fx.PROGRAM).first()["count"] == 8
    for ids in (merkle.identify(edge), merkle.identify_in_log_order(edge).groupBy("blob").agg(F.max_by("bom_id", "seq").alias("bom_id"))):
        got = {r["blob"]: r["bom_id"] for r in ids.collect()}
        assert got == {fx.OBJECT: fx.OBJECT_BOM, fx.PROGRAM: fx.PROGRAM_BOM}
    node = dag.nodes(records).filter(F.col("blob") == fx.PROGRAM).first()
    assert node["build_cmds"] == ["ld -o hello", "cc -o hello hello.o"] and node["file_paths"] == ["/src/hello"]


def test_log_round_trip(spark, tmp_path):
    text = (
        "PID: 12 pre_exec\noutfile: aa path: /b/x y.o\n==== End of raw info for this process\n"
        "\noutfile: bb path: /b/lib.so\ninfile: cc path: /b/a b.c has_cve:CVE-1-2,CVE-1-3 fixed_cve:CVE-2-1\ninfile: path: /b/none.h\ninfile: dd path: /p prov_pkg: src 1\ndynlib: ee path: /l.so\n"
        "build_cmd: cc  -o x\nbuild_tool: t\npkg_info: p\nprune: subtree\nignore_this_record: information only\n==== End of raw info for PID 4 process\n"
    )
    (tmp_path / "log").write_text(text)
    first = rawlog.read_raw_log(spark, str(tmp_path / "log"))
    rawlog.write_raw_log(first, str(tmp_path / "again"))
    again = rawlog.read_raw_log(spark, str(tmp_path / "again"))
    a, b = (sorted(map(str, d.drop("seq").collect())) for d in (first, again))
    assert a == b and len(a) == 2
    r = first.orderBy("seq").collect()
    assert (r[0]["pid"], r[0]["exec_mode"], r[0]["out_path"]) == ("12", "pre_exec", "/b/x y.o")
    assert r[1]["infiles"][0]["path"] == "/b/a b.c" and r[1]["infiles"][0]["has_cve"] == ["CVE-1-2", "CVE-1-3"] and r[1]["infiles"][1]["blob"] is None
    assert r[1]["infiles"][2]["prov_pkg"] == "src 1" and r[1]["ignore"] and r[1]["prune"] == "subtree" and r[1]["dynlibs"][0]["path"] == "/l.so"
    strict = rawlog.read_raw_log(spark, str(tmp_path / "log"), strict=True).orderBy("seq").collect()
    assert strict[0]["out_path"] == "/b/x"
    assert dag.edges(first).count() == 0
    assert rawlog.file_set(first).count() == 6
    index = spark.createDataFrame([("dd", "pkg 2")], "blob string, prov_pkg string")
    told = rawlog.annotate(first, index).orderBy("seq").collect()[1]["infiles"]
    assert [f["prov_pkg"] for f in told] == [None, None, "pkg 2"]
    assert rawlog.truncate(first, spark.createDataFrame([("bb",)], "blob string")).count() == 1
    assert {r["prune"] for r in rawlog.set_prune(first, spark.createDataFrame([("bb",)], "blob string"), None).collect()} == {None}
    assert {r["kind"] for r in rawlog.linker_inputs(first).collect()} == {"input", "dynlib"}


def random_graph(seed, n=40):
    rng = random.Random(seed)
    name = lambda k: hashlib.sha1(str(k).encode()).hexdigest()
    return [(name(k), name(j)) for k in range(5, n) for j in rng.sample(range(k), rng.randint(1, 4))]


def by_recursion(pairs, pruned=(), reuse=True):
    kids = {}
    for o, i in pairs:
        kids.setdefault(o, set()).add(i)
    memo = {}

    def bom(b):
        if b not in kids:
            return ""
        if b not in memo:
            lines = sorted(f"blob {i} bom {bom(i)}" if bom(i) and i not in pruned else f"blob {i}" for i in kids[b])
            if reuse and len(lines) == 1 and " bom " in lines[0]:
                memo[b] = lines[0].split(" bom ")[1]
            else:
                raw = ("gitoid:blob:sha1\n" + "\n".join(lines) + "\n").encode()
                memo[b] = hashlib.sha1(b"blob %d\0" % len(raw) + raw).hexdigest()
        return memo[b]

    return {b: bom(b) for b in kids}


def ids(spark, pairs, pruned=None, **options):
    p = None if pruned is None else spark.createDataFrame([(b,) for b in pruned], "blob string")
    return {r["blob"]: r["bom_id"] for r in merkle.identify(links(spark, pairs), p, **options).collect()}


def test_merkle_properties(spark):
    pairs = random_graph(1)
    want = by_recursion(pairs)
    assert ids(spark, pairs) == want
    shuffled = pairs * 2
    random.Random(2).shuffle(shuffled)
    assert ids(spark, shuffled) == want
    assert ids(spark, pairs, reuse_unary=False) == by_recursion(pairs, reuse=False)
    pruned = [pairs[10][0], pairs[20][0]]
    assert ids(spark, pairs, pruned) == by_recursion(pairs, pruned)
    edge = links(spark, pairs)
    marks = merkle.prune(spark.createDataFrame([], "blob string"), edge, spark.createDataFrame([(b,) for b in [*pruned, "leaf"]], "blob string"))
    assert {r[0] for r in marks.collect()} == set(pruned)
    assert merkle.unprune(marks, spark.createDataFrame([(b,) for b in pruned], "blob string")).count() == 0
    assert sorted(map(tuple, merkle.graft([edge, edge]).collect())) == sorted(set(pairs))
    other = links(spark, [(pairs[0][0], "z" * 40), ("y" * 40, "x" * 40)])
    assert ("y" * 40, "x" * 40) in {tuple(r) for r in merkle.graft([edge, other]).collect()} and (pairs[0][0], "z" * 40) not in {tuple(r) for r in merkle.graft([edge, other]).collect()}
    docs = merkle.identify(edge).filter("doc IS NOT NULL")
    assert merkle.bom_lines(docs).select("blob").distinct().count() <= 40


def test_cycles_are_told(spark):
    pairs = [("a", "b"), ("b", "a"), ("c", "a"), ("d", "e")]
    got = {r["blob"]: (r["bom_id"], r["cycle"]) for r in merkle.identify(links(spark, pairs)).collect()}
    assert got["d"][0] and not got["d"][1] and all(got[x] == (None, True) for x in "abc")
    assert {r[0] for r in closure.cyclic(links(spark, pairs)).collect()} == set("abc")


def test_log_order_matters(spark):
    a, b, c = "a" * 40, "b" * 40, "c" * 40
    edge = spark.createDataFrame([(a, b, 1), (b, c, 2), (b, a, 3)], "out_blob string, in_blob string, seq long")
    got = {(r["blob"], r["seq"]): r["bom_id"] for r in merkle.identify_in_log_order(edge, reuse_unary=False).collect()}
    line = lambda *x: by_recursion([("k", i) for i in x], reuse=False)["k"]
    assert got[(a, 1)] == line(b) and got[(b, 2)] == line(c)
    raw = f"gitoid:blob:sha1\nblob {a} bom {got[(a, 1)]}\nblob {c}\n".encode()
    assert got[(b, 3)] == hashlib.sha1(b"blob %d\0" % len(raw) + raw).hexdigest()


def test_closures(spark):
    pairs = random_graph(3)
    edge = links(spark, pairs)
    root = pairs[-1][0]
    closed = closure.closure(edge, spark.createDataFrame([(root,)], "root string"))
    seen, todo = {root: 0}, [root]
    for x in todo:
        for o, i in pairs:
            if o == x and i not in seen:
                seen[i] = seen[x] + 1
                todo.append(i)
    assert {r["blob"]: r["depth"] for r in closed.collect()} == seen
    outs = {o for o, _ in pairs}
    under = closure.leaves(closed, edge)
    assert {r["blob"] for r in under.collect()} == {b for b in seen if b not in outs}
    assert merkle.collapse(under.select("root", "blob")).first()["n_leaves"] == len([b for b in seen if b not in outs])
    targets = spark.createDataFrame([(pairs[0][1],), ("nobody",)], "blob string")
    counts = {r["blob"]: r["n_parents"] for r in closure.parent_counts(edge, targets).collect()}
    assert counts == {pairs[0][1]: len({o for o, i in pairs if i == pairs[0][1]}), "nobody": 0}
    node = spark.createDataFrame([("p", "c1"), ("q", "c2")], "blob string, build_cmd string")
    chain = closure.command_chains(links(spark, [("p", "q"), ("q", "r"), ("q", "s")]), node).collect()
    assert {r["blob"]: r["commands"] for r in chain} == {"p": ["c1", "c2"]}


def test_pre_exec_and_aliases(spark):
    from stemma.sources import schemas

    f = lambda b, p: (0, b, p, [], [], None)
    rows = [
        (1, "9", "pre_exec", "old", "/x", None, None, None, None, False, [], []), (2, "9", None, "new", "/x", "strip", None, None, None, False, [f("q", "/q")], []),
        (3, "9", None, "newer", "/x", "strip", None, None, None, False, [f("new", "/x")], []), (4, None, None, None, "/meta", "m", None, None, None, False, [f("k", "/k")], []),
        (5, None, None, "top", "/top", "t", None, None, None, False, [f("meta1", "/meta")], []), (6, None, None, "same", "/same", "t", None, None, None, False, [f("same", "/o")], []),
    ]
    records = spark.createDataFrame(rows, schemas.RECORD)
    ready = dag.resolve_aliases(dag.usable_records(dag.with_pre_exec(records)))
    got = {(r["out_blob"], r["in_blob"]) for r in dag.edges(ready).collect()}
    assert got == {("new", "old"), ("newer", "new"), ("meta1", "k"), ("top", "meta1")}
    kept = dag.with_pre_exec(records, replace_inputs=False)
    assert {(r["out_blob"], r["in_blob"]) for r in dag.edges(kept).collect()} >= {("new", "old"), ("new", "q")}


def test_as_of_and_pairs(spark):
    left = spark.createDataFrame([("k", 5, "x"), ("k", 1, "y"), ("j", 9, "z")], "key string, at long, name string")
    right = spark.createDataFrame([("k", 1, "v1"), ("k", 4, "v4"), ("k", 5, "v5")], "key string, at long, val string")
    assert {r["name"]: r["val"] for r in dag.latest_before(left, right, ["key"], "at", "val", "val").collect()} == {"x": "v4", "y": None, "z": None}
    events = spark.createDataFrame([("k", n, t) for n, t in enumerate(["a", "a", "b", "b", "a", "c", "b"])], "key string, at long, kind string")
    assert {(r["before_order"], r["after_order"]) for r in dag.paired_once(events, ["key"], "at", "kind", "a", "b").collect()} == {(1, 2), (4, 6)}


def test_deep_graphs(spark, monkeypatch):
    from stemma.plans import storage

    monkeypatch.setattr(storage.compacted, "__defaults__", (2,))
    chain = [(f"n{k:02}", f"n{k + 1:02}") for k in range(12)] + [(f"n{k:02}", f"leaf{k}") for k in range(12)]
    closed = closure.closure(links(spark, chain), spark.createDataFrame([("n00",)], "root string"))
    assert {r["blob"]: r["depth"] for r in closed.collect()} == {f"n{k:02}": k for k in range(13)} | {f"leaf{k}": k + 1 for k in range(12)}
    assert ids(spark, chain) == by_recursion(chain)
    single = spark.createDataFrame([(f"n{k:02}", f"c{k}") for k in range(12)], "blob string, build_cmd string")
    got = {r["blob"]: r["commands"] for r in closure.command_chains(links(spark, chain[:12]), single).collect()}
    assert got["n00"] == [f"c{k}" for k in range(12)] and got["n11"] == ["c11"]


def test_rounds_have_no_bound_and_cycles_are_told_apart(spark):
    chain = [(f"n{k}", f"n{k + 1}") for k in range(40)] + [("x", "y"), ("y", "x"), ("above", "x"), ("above", "n39"), ("cut", "z"), ("z", "cut")]
    edge = spark.createDataFrame(chain, "out_blob string, in_blob string")
    got = {r["blob"]: r for r in merkle.identify(edge, reuse_unary=False).collect()}
    assert {b for b, r in got.items() if r["cycle"]} == {"x", "y", "above", "cut", "z"} and all((r["bom_id"] is None) == r["cycle"] for r in got.values())
    want = None
    for k in reversed(range(40)):
        line = f"blob n{k + 1}" + (f" bom {want}" if want else "")
        doc = f"gitoid:blob:sha1\n{line}\n".encode()
        want = hashlib.sha1(b"blob %d\0" % len(doc) + doc).hexdigest()
        assert got[f"n{k}"]["bom_id"] == want
    broken = {r["blob"] for r in merkle.identify(edge, spark.createDataFrame([("cut",)], "blob string")).collect() if r["cycle"]}
    assert broken == {"x", "y", "above"}


def test_processes_that_are_their_own_ancestors(spark):
    tree = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("z", "y")], "proc string, parent_proc string")
    got = {r["proc"]: (r["root"], r["depth"]) for r in processes.depths(tree).collect()}
    assert got == {"a": ("a", 0), "b": ("a", 1), "c": ("a", 2), "x": (None, None), "y": (None, None), "z": (None, None)}
    lines = tree.withColumn("line_no", F.lit(1)).withColumn("prog", F.lit("p"))
    assert [r["root"] for r in processes.command_trees(lines, processes.depths(tree)).collect()] == ["a"]

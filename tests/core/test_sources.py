"""Readers, writers and command lines on small hand-written inputs."""

import gzip
import io
import json
import struct
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from stemma.functions import ident
from stemma.operators import merkle
from stemma.sources import commands, rawlog, readers, sinks

A, B, C = "a" * 40, "b" * 40, "c" * 40


def put(tmp_path, name, text):
    path = tmp_path / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text) if isinstance(text, bytes) else path.write_text(text)
    return str(path)


def test_cve_database(spark, tmp_path):
    path = put(tmp_path, "db.json", json.dumps({A: {"file_path": "x.c", "CVElist": ["CVE-1", "CVE-2"], "FixedCVElist": ["CVE-3"]}, B: {"file_path": "y.c", "NoCVElist": ["CVE-1"]}}))
    rows = readers.read_cve_db(spark, path)
    assert {(r["blob"], r["cve"], r["status"]) for r in rows.collect()} == {(A, "CVE-1", "cve"), (A, "CVE-2", "cve"), (A, "CVE-3", "fixed"), (B, "CVE-1", "no")}
    out = str(tmp_path / "out")
    sinks.write_json_db(sinks.cve_json(rows), out)
    text = "\n".join(r["value"] for r in spark.read.text(out).select("value", F.input_file_name().alias("f")).orderBy("f").collect())
    assert json.loads(text) == {A: {"file_path": "x.c", "CVElist": ["CVE-1", "CVE-2"], "FixedCVElist": ["CVE-3"]}, B: {"file_path": "y.c", "NoCVElist": ["CVE-1"]}}
    assert readers.read_doc_mapping(spark, str(tmp_path / "none"), put(tmp_path, "m.json", json.dumps({A: B}))).first().asDict() == {"blob": A, "bom_id": B}


def test_document_store(spark, tmp_path):
    docs = merkle.identify(spark.createDataFrame([(A, B), (A, C), (B, C)], "out_blob string, in_blob string"), reuse_unary=False)
    for r in docs.collect():
        put(tmp_path, f"store/objects/{r['bom_id'][:2]}/{r['bom_id'][2:]}", r["doc"])
    put(tmp_path, "store/other/notes.txt", "x")
    stored = readers.read_doc_store(spark, str(tmp_path / "store"))
    assert sorted(r["bom_id"] for r in stored.collect()) == sorted(r["bom_id"] for r in docs.collect())
    lines = readers.doc_lines(stored)
    assert lines.count() == 3 and lines.filter("child_bom IS NOT NULL").count() == 1
    assert readers.docs_with(lines, spark.createDataFrame([(C,)], "blob string")).count() == 2
    again = readers.restored_docs(readers.bare_docs(stored))
    assert sorted(map(str, again.collect())) == sorted(map(str, stored.collect()))
    kept = str(tmp_path / "kept")
    for _ in range(3):
        sinks.write_doc_store(docs, kept)
    sinks.write_doc_store(docs.withColumn("bom_id", F.lit("f" * 40)), kept)
    assert readers.read_doc_table(spark, kept).count() == 3
    assert sorted(map(str, readers.read_doc_table(spark, kept).filter("bom_id <> repeat('f', 40)").collect())) == sorted(map(str, stored.collect()))


def test_ranges_and_rules(spark, tmp_path):
    ranges = readers.read_cve_ranges(spark, put(tmp_path, "r.txt", f"# note\n\nCVE-1 {A} {B}\nCVE-2 {A}\n  CVE-3\t{A}  {C} \n"))
    assert [r["cve"] for r in ranges.orderBy("cve").collect()] == ["CVE-1", "CVE-3"]
    add = 'CVE-1:\n  src/a.c:\n    include:\n      - "one: two"\n      - any:\n          - x\n          - y\n    exclude:\n      - bad\nCVE-2:\n  b.c:\n    include:\n    - only\n'
    fix = "CVE-1:\n  src/a.c:\n    include: \n      - fixed\n"
    rules = {(r["cve"], r["rule_type"]): r for r in readers.read_cve_rules(spark, put(tmp_path, "add", add), put(tmp_path, "fix", fix)).collect()}
    assert rules[("CVE-1", "cveadd")]["include"] == [["one: two"], ["x", "y"]] and rules[("CVE-1", "cveadd")]["exclude"] == [["bad"]]
    assert rules[("CVE-2", "cveadd")]["include"] == [["only"]] and rules[("CVE-1", "cvefix")]["include"] == [["fixed"]] and len(rules) == 3
    put(tmp_path, "info/abc123.yml", "Fixed:\n  CVE-9:\n    src_files:\n      - a.c\n      - b.c\n")
    got = readers.read_cve_info(spark, str(tmp_path / "info")).first()
    assert (got["cve"], got["kind"], got["commit"], got["src_files"]) == ("CVE-9", "Fixed", "abc123", ["a.c", "b.c"])


def test_yaml_texts():
    text = """
# rules
CVE-1:   # first
  note: >
    folded text
    in two lines

    and more
  kept: |-
    one
      two
  files: [a.c, "b, c.h", 'it''s']
  many: [x,
     y, z]
  plain: goes on
    in the next line
CVE-2:
- first
- key: 1
  other: 2
-
  - inner
CVE-3: "quoted # not a comment"
"""
    got = readers.small_yaml(text)
    assert got["CVE-1"] == {"note": "folded text in two lines\n\nand more\n", "kept": "one\n  two", "files": ["a.c", "b, c.h", "it's"], "many": ["x", "y", "z"], "plain": "goes on in the next line"}
    assert got["CVE-2"] == ["first", {"key": "1", "other": "2"}, ["inner"]] and got["CVE-3"] == "quoted # not a comment"
    for bad in ("a: &x 1", "a: {b: 1}", "a:\n  b: 1\n c: 2", "a: 1\nno pair here", "a: [[1], 2]", "- a\nb: c"):
        with pytest.raises(ValueError):
            readers.small_yaml(bad)


def test_a_stanza_that_repeats_a_field(spark, tmp_path):
    rows = readers.read_deb822(spark, put(tmp_path, "S", "Package: a\nTag: one\nTag: two\n\nPackage: b\n")).collect()
    assert [r["fields"] for r in rows] == [{"Package": "a", "Tag": "one"}, {"Package": "b"}]


def test_deep_patch_names(spark, tmp_path):
    deep = "/".join(["d"] * 3000) + "/x.c"
    assert readers.read_patches(spark, put(tmp_path, "p", f"--- a/{deep}\n+++ b/{deep}\n")).first()["targets"] == [deep]


def test_version_control_text(spark, tmp_path):
    one, two = "1" * 40, "2" * 40
    log = f"commit {one}\nAuthor: x\n\n    message\n\n:100644 100644 {A} {B} M\tsrc/a.c\n:100644 100644 {A} {C} R100\told.c\tnew.c\n\ncommit {two}\n\n:000000 100644 {'0' * 40} {A} A\tsrc/a.c\n"
    changes = readers.read_git_log(spark, put(tmp_path, "log", log))
    rows = {(r["ord"], r["path"]): (r["commit"], r["src_blob"], r["dst_blob"], r["change"]) for r in changes.collect()}
    assert rows == {(0, "src/a.c"): (one, A, B, "M"), (0, "new.c"): (one, A, C, "R"), (1, "src/a.c"): (two, "0" * 40, A, "A")}
    assert readers.file_history(changes).count() == 3
    tree = readers.read_git_tree(spark, put(tmp_path, "tree", f"100644 blob {A}     12\tsrc/a.c\n100644 blob {B} 3\t.hidden\n040000 tree {C} -\tsrc\n"))
    assert [tuple(r) for r in tree.collect()] == [(A, 12, "src/a.c")]


def test_packages(spark, tmp_path):
    text = "Package: a\nVersion: 1-2\nDirectory: pool/a\nFiles:\n deadbeef 10 a.dsc\n deadbeef 20 a.tar.xz\n\nPackage: b\nVersion: 2\nDirectory: pool/b\n"
    rows = {r["package"]: r for r in readers.read_deb_sources(spark, put(tmp_path, "Sources", text)).collect()}
    assert [(f["size"], f["name"]) for f in rows["a"]["files"]] == [(10, "a.dsc"), (20, "a.tar.xz")] and rows["b"]["files"] == [] and rows["a"]["version"] == "1-2"
    recipe = json.dumps({"packages": [{"name": "recipe-zlib", "versionInfo": "1.2", "downloadLocation": "https://z"}, {"name": "x", "versionInfo": "1", "downloadLocation": "NOASSERTION"}]})
    r = readers.read_recipes(spark, put(tmp_path, "recipe.json", recipe)).first()
    assert (r["name"], r["version"], r["download_locations"]) == ("zlib", "1.2", ["https://z"])
    egg = readers.read_egg_info(spark, put(tmp_path, "PKG-INFO", "Metadata-Version: 1\nName: six\nVersion: 1.16\n")).first()
    assert (egg["name"], egg["version"]) == ("six", "1.16")
    spec = readers.read_rpm_spec(spark, put(tmp_path, "x.spec", "Name: hello\nVersion: 2.1\nRelease: 3\nPatch0: %{name}-%{version}-fix.patch\n")).first()
    assert (spec["name"], spec["version"], spec["patches"]) == ("hello", "2.1", ["hello-2.1-fix.patch"])


def test_traces(spark, tmp_path):
    trace = '10 execve("/usr/bin/make", ["make", "-j \\"2\\""], 0x1 /* 3 vars */) = 0\n10 vfork() = 11\n11 execve("/bin/no", ["no"], 0x1) = -1 ENOENT (No such file)\n11 execve("/bin/cc", ["cc", "a.c"], 0x1) = 0\n10 clone(child_stack=NULL, flags=CLONE) = 12\n'
    rows = readers.read_strace(spark, put(tmp_path, "trace", trace)).orderBy("line_no").collect()
    assert [(r["line_no"], r["pid"], r["child"], r["prog"]) for r in rows] == [(1, "10", None, "/usr/bin/make"), (2, "10", "11", None), (4, "11", None, "/bin/cc"), (5, "10", "12", None)]
    assert rows[2]["argv"] == "cc a.c"
    opened = '7 openat(AT_FDCWD, "/s/A.java", O_RDONLY) = 3\n7 openat(AT_FDCWD, "/o/A.class", O_WRONLY|O_CREAT) = 4\n7 openat(AT_FDCWD, "/o/B.class", O_RDONLY) = 4\n7 openat(AT_FDCWD, "/s/X.java", O_RDONLY) = -1 ENOENT\n7 openat(AT_FDCWD, "/o/A$1.class", O_WRONLY|O_CREAT) = 4\n'
    access = readers.read_class_access(spark, put(tmp_path, "java", opened))
    assert sorted(tuple(r) for r in readers.class_steps(access).collect()) == [("/o/A$1.class", "/s/A.java"), ("/o/A.class", "/s/A.java")]
    cmd = readers.read_shell_commands(spark, put(tmp_path, "cmd", "pid: 42\npwd: /w /root\n/usr/bin/cc\ncc -c a.c\n")).first()
    assert (cmd["pid"], cmd["pwd"], cmd["rootdir"], cmd["prog"], cmd["argv"]) == ("42", "/w", "/root", "/usr/bin/cc", "cc -c a.c")
    dep = readers.read_depend_files(spark, put(tmp_path, "a.d", "a.o: a.c \\\n  a.h /usr/b.h\n\na.h:\n")).first()
    assert (dep["target"], dep["depends"]) == ("a.o", ["a.c", "a.h", "/usr/b.h"])
    dot = readers.read_depend_files(spark, put(tmp_path, "a.dot", 'digraph "d" {\n header_1 [ shape="box", label="/x/a.c"];\n header_2 [ label="/x/b.h"];\n}\n')).first()
    assert dot["target"] is None and dot["depends"] == ["/x/a.c", "/x/b.h"]
    patch = "--- a/src/x.c\t2020\n+++ b/src/x.c\n@@\n--- a/gone.c\n+++ /dev/null\n--- /dev/null\n+++ b/new.c\n"
    assert readers.read_patches(spark, put(tmp_path, "p.patch", patch)).first()["targets"] == ["src/x.c", "gone.c", "new.c"]


def member(name, data):
    return name.ljust(16) + b"0".ljust(12) + b"0".ljust(6) + b"0".ljust(6) + b"644".ljust(8) + str(len(data)).encode().ljust(10) + b"`\n" + data + b"\n" * (len(data) % 2)


def cpio(files):
    out = b""
    for k, (name, data) in enumerate([*files.items(), ("TRAILER!!!", b"")]):
        fields = [k, 0o100644 if data else 0, 0, 0, 1, 0, len(data), 0, 0, 0, 0, len(name) + 1, 0]
        out += b"070701" + b"".join(b"%08X" % f for f in fields) + name.encode() + b"\0"
        out += bytes(-len(out) % 4) + data
        out += bytes(-len(out) % 4)
    return out


def rpm(tags, payload):
    def header(entries):
        store, index = b"", b""
        for tag, value in entries.items():
            index += struct.pack(">IIII", tag, 6, len(store), 1)
            store += value.encode() + b"\0"
        return b"\x8e\xad\xe8\x01\0\0\0\0" + struct.pack(">II", len(entries), len(store)) + index + store

    first = header({1: "sig"})
    return b"\xed\xab\xee\xdb" + bytes(92) + first + bytes(-(96 + len(first)) % 8) + header(tags) + gzip.compress(payload)


def test_files_and_archives(spark, tmp_path):
    put(tmp_path, "in/a.txt", "hello\n")
    put(tmp_path, "in/empty", "")
    files = readers.read_files(spark, str(tmp_path / "in"))
    want = spark.range(1).select(ident.gitoid(F.lit(b"hello\n"))).first()[0]
    assert [(r["blob"], r["size"]) for r in files.collect()] == [(want, 6)]
    tar, z = io.BytesIO(), io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w:gz") as t:
        info = tarfile.TarInfo("d/a.txt")
        info.size = 6
        t.addfile(info, io.BytesIO(b"hello\n"))
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("M/b.txt", "hello\n")
    ar = b"!<arch>\n" + b"m.o/".ljust(16) + b"0".ljust(12) * 1 + b"0".ljust(6) + b"0".ljust(6) + b"644".ljust(8) + b"6".ljust(10) + b"`\n" + b"hello\n"
    for name, raw in (("x.tgz", tar.getvalue()), ("x.jar", z.getvalue()), ("x.a", ar), ("x.bin", b"nothing")):
        put(tmp_path, f"arch/{name}", raw)
    with tarfile.open(fileobj=(data := io.BytesIO()), mode="w:xz") as t:
        t.addfile(info, io.BytesIO(b"hello\n"))
    with tarfile.open(fileobj=(control := io.BytesIO()), mode="w:gz") as t:
        told = b"Package: hi\nVersion: 1-2\nArchitecture: amd64\n"
        head = tarfile.TarInfo("./control")
        head.size = len(told)
        t.addfile(head, io.BytesIO(told))
    put(tmp_path, "arch/x.deb", b"!<arch>\n" + member(b"debian-binary", b"2.0\n") + member(b"control.tar.gz", control.getvalue()) + member(b"data.tar.xz", data.getvalue()))
    put(tmp_path, "arch/x.rpm", rpm({1000: "hi", 1001: "1", 1002: "2", 1022: "x86_64", 1044: "hi.src.rpm"}, cpio({"./usr/a": b"hello\n", "./b": b"12345"})))
    put(tmp_path, "arch/cut.rpm", rpm({1000: "cut"}, cpio({"a": b"hello\n"}))[:-40])
    rows = readers.expand_archives(spark, str(tmp_path / "arch")).collect()
    found = {(r["archive"].rsplit("/", 1)[-1], r["path"]): r["blob"] for r in rows if not r["error"]}
    assert found.pop(("x.rpm", "./b")) == spark.range(1).select(ident.gitoid(F.lit(b"12345"))).first()[0]
    assert found == {("x.tgz", "d/a.txt"): want, ("x.jar", "M/b.txt"): want, ("x.a", "m.o"): want, ("x.deb", "d/a.txt"): want, ("x.rpm", "./usr/a"): want}
    assert sorted(r["archive"].rsplit("/", 1)[-1] for r in rows if r["error"]) == ["cut.rpm", "x.bin"]
    assert len(next(r["blob"] for r in readers.expand_archives(spark, str(tmp_path / "arch"), "*.a", alg="sha256").collect())) == 64
    heads = {r["path"].rsplit("/", 1)[-1]: tuple(r)[1:] for r in readers.read_package_headers(spark, str(tmp_path / "arch")).filter("path NOT LIKE '%cut%'").collect()}
    assert heads == {"x.deb": ("deb", "hi", "1-2", "amd64", None), "x.rpm": ("rpm", "hi", "1-2", "x86_64", "hi.src.rpm")}
    note = spark.range(1).select(ident.embedded_note(F.lit(A), F.lit(None).cast("string"), "OWN")).first()[0]
    put(tmp_path, "elf/x", b"\x7fELF12" + bytes(note) + b"zz")
    put(tmp_path, "elf/y", b"\x7fELF")
    with zipfile.ZipFile(z := io.BytesIO(), "w") as f:
        f.writestr("META-INF/OWN", f"x {B}\n")
        f.writestr("M.class", "c")
    put(tmp_path, "elf/j", z.getvalue())
    inner = b"\x7fELF12" + bytes(note)
    put(tmp_path, "elf/a", b"!<arch>\n" + member(b"m.o/", inner) + member(b"n.o/", b"zz"))
    got = readers.read_embedded_ids(spark, str(tmp_path / "elf"), "OWN").collect()
    assert {(r["path"][-1], r["member"]): r["bom_id"] for r in got} == {("x", None): A, ("y", None): None, ("j", None): B, ("j", "META-INF/OWN"): B, ("j", "M.class"): None, ("a", None): None, ("a", "m.o"): A, ("a", "n.o"): None}


def test_python_imports(spark):
    text = "import os\nfrom . import near\nfrom ..up import thing as t\ntry:\n    import fast\nexcept ImportError:\n    import slow\n"
    rows = readers.python_imports(spark.createDataFrame([("/p/q/m.py", text), ("/p/bad.py", "def (")], "path string, text string")).collect()
    assert {(r["module"], r["level"], r["in_except"]) for r in rows} == {("os", 0, False), ("near", 1, False), ("up", 2, False), ("up.thing", 2, False), ("fast", 0, True), ("slow", 0, True)}


@pytest.mark.parametrize(
    "prog,argv,outs,ins",
    [
        ("/usr/bin/gcc", "gcc -O2 -Iinc -DX=1 -c -o a.o a.c", ["a.o"], ["a.c"]),
        ("gcc-12", "gcc-12 -c src/b.c", ["b.o"], ["src/b.c"]),
        ("x86_64-linux-gnu-g++", "g++ -o app main.o libx.a -L lib -lfoo", ["app"], ["main.o", "libx.a"]),
        ("/usr/bin/ld", "ld -m elf_x86_64 -o app -dynamic-linker /l.so crt1.o a.o -lc", ["app"], ["crt1.o", "a.o"]),
        ("ar", "ar rcs libx.a a.o b.o", ["libx.a"], ["a.o", "b.o"]),
        ("ar", "ar t libx.a", [], []),
        ("rustc", "rustc --crate-name foo --crate-type lib --out-dir out src/lib.rs --extern dep=libdep.rlib", ["out/libfoo.rlib"], ["src/lib.rs", "libdep.rlib"]),
        ("/go/compile", "compile -o pkg.a -p main a.go b.go", ["pkg.a"], ["a.go", "b.go"]),
        ("javac", "javac -d out A.java", ["out/A.class"], ["A.java"]),
        ("jar", "jar cf x.jar A.class B.class", ["x.jar"], ["A.class", "B.class"]),
        ("strip", "strip -g app", ["app"], ["app"]),
        ("strip", "strip -o small app", ["small"], ["app"]),
        ("objcopy", "objcopy -O binary vmlinux bin", ["bin"], ["vmlinux"]),
        ("ranlib", "ranlib libx.a", ["libx.a"], ["libx.a"]),
        ("install", "install -m 644 a b", ["b"], ["a"]),
        ("install", "install -D -m 644 a s/b dir", ["dir/a", "dir/b"], ["a", "s/b"]),
        ("install", "install -t dir a", ["dir/a"], ["a"]),
        ("install", "install -d x y", [], []),
        ("gcc", "gcc -c a.c src/b.c", ["a.o", "b.o"], ["a.c", "src/b.c"]),
        ("gcc", "gcc -S a.c", ["a.s"], ["a.c"]),
        ("gcc", "gcc a.c", ["a.out"], ["a.c"]),
        ("patch", "patch -p1 -i x.patch", [], ["x.patch"]),
        ("patch", "patch -p1 -d src < x.patch", [], ["x.patch"]),
        ("patch", "patch -p1 -i fix.patch src/a.c", ["src/a.c"], ["src/a.c", "fix.patch"]),
        ("dpkg-deb", "dpkg-deb -b tree x.deb", ["x.deb"], ["tree"]),
        ("ls", "ls -l", [], []),
    ],
)
def test_command_lines(prog, argv, outs, ins):
    _, got_outs, got_ins, _, _ = commands.parse(prog, argv)
    assert (got_outs, got_ins) == (outs, ins)


def test_command_records(spark):
    cmds = spark.createDataFrame([(1, "9", "/w", "", "/usr/bin/gcc", "gcc -o app a.o -L lib -lx"), (2, "9", "/w", "", "/usr/bin/ld", "ld -o app a.o"), (3, "9", "/w", "", "/bin/ls", "ls")], "cmd_id long, pid string, pwd string, rootdir string, prog string, argv string")
    catalog = spark.createDataFrame([("/w/app", A), ("/w/a.o", B), ("/w/lib/libx.so", C)], "path string, blob string")
    rows = {r["seq"] + 1: r for r in commands.command_records(cmds, catalog).collect()}
    assert rows[1]["ignore"] and not rows[2]["ignore"] and len(rows) == 2
    assert [f["path"] for f in rows[1]["dynlibs"]] == ["/w/lib/libx.so"] and [f["blob"] for f in rows[2]["infiles"]] == [B]
    assert commands.watched(cmds, ["/usr/bin/ld", "ls", "-cc"]).count() == 2
    assert commands.read_watch_list("# x\ngcc\n---\nstrip\n===\nconfigure\n+++\nrpmbuild\n") == {"watched": ["gcc"], "pre_exec": ["strip"], "detach": ["configure"], "umbrella": ["rpmbuild"]}


COMMAND = "cmd_id long, pid string, pwd string, rootdir string, prog string, argv string"


def made(spark, cmds, paths, **options):
    catalog = spark.createDataFrame([(p, "id " + p) for p in paths], "path string, blob string")
    records = commands.command_records(spark.createDataFrame(cmds, COMMAND), catalog, **options).collect()
    return {r["out_path"]: [f["path"] for f in r["infiles"]] for r in sorted(records, key=lambda r: r["seq"])}, records


def test_a_command_with_many_outputs(spark):
    n = 1500
    words = " ".join(f"C{k}.java" for k in range(n))
    cmds = [(1, "9", "/w", "", "javac", f"javac {words}"), (2, "9", "/w", "", "gcc", "gcc -c a.c b.c")]
    paths = [f"/w/C{k}.{e}" for k in range(n) for e in ("java", "class")] + ["/w/a.c", "/w/a.o", "/w/b.c", "/w/b.o", "/w/h.h"]
    got, records = made(spark, cmds, paths, headers=spark.createDataFrame([(2, "/w/h.h")], "cmd_id long, path string"))
    assert sorted(r["seq"] for r in records) == list(range(n + 2)) and [r["out_path"] for r in sorted(records, key=lambda r: r["seq"])][-2:] == ["/w/a.o", "/w/b.o"]
    assert got["/w/a.o"] == ["/w/a.c", "/w/h.h"] and got["/w/b.o"] == ["/w/b.c", "/w/h.h"] and got["/w/C7.class"] == ["/w/C7.java"]
    assert [f["pos"] for r in records if r["out_path"] == "/w/a.o" for f in r["infiles"]] == [0, 1]


def test_files_that_other_files_tell(spark):
    cmds = [(1, "9", "/w", "", "patch", "patch -p1 -d src -i ../x.patch"), (2, "9", "/w", "", "/go/compile", "compile -o p.a -importcfg cfg a.go"), (3, "9", "/w", "", "gcc", "gcc @args -o app"), (4, "9", "/w", "", "patch", "patch < x.patch")]
    frame = spark.createDataFrame(cmds, COMMAND)
    patches = spark.createDataFrame([("/x.patch", ["never"]), ("/w/x.patch", ["a/lib/f.c", "a/g.c"])], "file string, targets array<string>")
    frame = frame.withColumn("argv", F.replace("argv", F.lit("../x"), F.lit("x")))
    tables = spark.createDataFrame([("/w/cfg", "# import config\npackagefile fmt=/go/fmt.a\npackagefile os=/go/os.a\n")], "file string, text string")
    frame = commands.with_responses(frame, spark.createDataFrame([("/w/args", "-O2\nm.c  n.c\n")], "path string, text string"))
    assert frame.filter("cmd_id = 3").first()["argv"] == "gcc -O2 m.c  n.c -o app"
    listed = commands.patched_files(frame, patches).unionByName(commands.imported_files(frame, tables))
    paths = ["/w/src/lib/f.c", "/w/src/g.c", "/w/f.c", "/w/x.patch", "/w/p.a", "/w/a.go", "/go/fmt.a", "/go/os.a", "/w/app", "/w/m.c", "/w/n.c"]
    got, _ = made(spark, [tuple(r) for r in frame.select(*[c.split()[0] for c in COMMAND.split(", ")]).collect()], paths, listed=listed)
    assert got == {"/w/src/lib/f.c": ["/w/src/lib/f.c", "/w/x.patch", "/w/src/g.c"], "/w/src/g.c": ["/w/src/lib/f.c", "/w/x.patch", "/w/src/g.c"], "/w/f.c": ["/w/f.c", "/w/x.patch"], "/w/p.a": ["/w/a.go", "/go/fmt.a", "/go/os.a"], "/w/app": ["/w/m.c", "/w/n.c"]}


def test_printed_tool_output(spark, tmp_path):
    cache = "/lib64: (from /etc/ld.so.conf)\n\tlibz.so.1 -> libz.so.1.2.11\n/usr/lib:\n\tliby.so -> liby.so.2\n"
    assert {tuple(r) for r in readers.read_library_cache(spark, put(tmp_path, "cache", cache)).collect()} == {("libz.so.1", "/lib64/libz.so.1.2.11"), ("liby.so", "/usr/lib/liby.so.2")}
    section = " 0x1 (NEEDED)  Shared library: [libc.so.6]\n 0x1 (NEEDED) Shared library: [libm.so]\n 0xf (RUNPATH) Library runpath: [$ORIGIN/../lib:/opt]\n"
    r = readers.read_dynamic_sections(spark, put(tmp_path, "dyn/usr%bin%app.txt", section)).first()
    assert (r["path"], r["needed"], r["rpath"]) == ("/usr/bin/app", ["libc.so.6", "libm.so"], ["/usr/bin/../lib", "/opt"])
    tags = spark.createDataFrame([("c1", "tag v1\n\nFixed:\n  CVE-7:\n    src_files:\n      - a.c\n")], "commit string, text string")
    assert [tuple(r) for r in readers.cve_info_of_messages(tags).collect()] == [("CVE-7", "Fixed", "c1", ["a.c"])]


def test_class_files(spark):
    names = ["x/Main", "java/lang/Object", "SourceFile", "Main.java"]
    pool = b"".join(b"\x01" + struct.pack(">H", len(n)) + n.encode() for n in names) + b"\x07\0\x01" + b"\x07\0\x02"
    raw = b"\xca\xfe\xba\xbe\0\0\0\x34" + struct.pack(">H", 7) + pool + struct.pack(">HHHHHH", 1, 5, 6, 0, 0, 0) + struct.pack(">HHIH", 1, 3, 2, 4)
    got = readers.class_files(spark.createDataFrame([("a.class", raw), ("b", b"no")], "path string, content binary")).collect()
    assert [tuple(r) for r in got] == [("a.class", "x/Main", "Main.java"), ("b", None, None)]


def test_packages_as_records(spark):
    from stemma.functions import text
    from stemma.operators import closure, dag, packages

    members = spark.createDataFrame([("p.rpm", "/usr/a", B), ("p.rpm", "/usr/b", C)], "archive string, path string, blob string")
    record = packages.package_record(spark.createDataFrame([("p.rpm", A, "p 1")], "archive string, blob string, pkg_info string"), members)
    assert {(r["out_blob"], r["in_blob"]) for r in dag.edges(record).collect()} == {(A, B), (A, C)}
    assert merkle.identify(merkle.reembedded(dag.edges(record), spark.createDataFrame([("e" * 40, A)], "new_blob string, old_blob string"))).select("bom_id").distinct().count() == 1
    entries = spark.createDataFrame([(f"blob {A}", "p", None), (f"blob {B}", None, "i"), (f"blob {C}", packages.NO_PROVIDER, None), ("file_path", "p", None)], "line string, prov_pkg string, imag_pkg string")
    assert {r["pkg_key"] for r in packages.owned_image_files(entries, spark.createDataFrame([(A,), (B,), (C,)], "blob string")).collect()} == {"p", "i"}
    closed = spark.createDataFrame([("r", A, 0)], "root string, blob string, depth int")
    assert closure.attach_paths(closed, spark.createDataFrame([("/z", A), ("/y", A)], "path string, blob string")).first()["local_path"] == "/y"
    row = spark.range(1).select(text.release_mirror(F.lit("bullseye")), text.release_mirror(F.lit("x")), text.is_regular_mode(F.lit(0o100644)), text.is_regular_mode(F.lit(0o120777))).first()
    assert tuple(row) == ("http://ftp.debian.org/debian", "", True, False)


def test_long_commands_of_raw_logs_stay_whole(spark):
    command = "ld " + "a.o " * 300_000 + "-o app"
    stanza = f"outfile: {'1' * 40} path: /b/app\nbuild_cmd: {command}\n"
    got = rawlog.parse_stanzas(spark.createDataFrame([(1, stanza)], "seq long, value string")).first()
    assert len(got["build_cmd"]) == len(command) and got["build_cmd"] == command

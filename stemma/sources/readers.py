"""Readers of the other exchange formats.  All parse in the JVM but archives, YAML and Python sources."""

from __future__ import annotations

import ast
import io
import json
import re
import tarfile
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.functions import ident, text
from stemma.operators import cvedb
from stemma.sources import schemas


def _whole(spark: SparkSession, path: str, name: str = "text") -> DataFrame:
    """(file, text) of whole files; Spark's file paths are percent-encoded, these are not."""
    file = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return spark.read.text(path, wholetext=True).select(file.alias("file"), F.col("value").alias(name))


# ---- databases and documents


def read_json_db(spark: SparkSession, path: str, entry: str) -> DataFrame:
    """(key, value) of a JSON object of objects, each of the declared type ``entry``; several files add up."""
    rows = _whole(spark, path).select(F.from_json("text", f"map<string,{entry}>").alias("db"))
    return rows.select(F.explode("db").alias("key", "value"))


def read_cve_db(spark: SparkSession, path: str) -> DataFrame:
    """``cve_status`` rows of an exported vulnerability table."""
    return cvedb.long(read_json_db(spark, path, schemas.CVE_ENTRY).select(F.col("key").alias("blob"), "value.*"))


def read_doc_mapping(spark: SparkSession, path: str, fallback: str | None = None) -> DataFrame:
    """(blob, bom_id); the file at ``fallback`` where there is none at ``path``."""
    from pyspark.errors import AnalysisException

    try:
        return read_json_db(spark, path, "string").select(F.col("key").alias("blob"), F.col("value").alias("bom_id"))
    except AnalysisException:
        if fallback is None:
            raise
        return read_doc_mapping(spark, fallback)


#: Fixed value: where a document store keeps an id, the first two digits as folder.
_STORED = r"/([0-9a-f]{2})/([0-9a-f]{38}|[0-9a-f]{62})$"


def read_doc_table(spark: SparkSession, path: str) -> DataFrame:
    """(bom_id, doc) of the store that ``sinks.write_doc_store`` keeps."""
    return spark.read.parquet(path).select("bom_id", "doc")


def read_doc_store(spark: SparkSession, path: str) -> DataFrame:
    """(bom_id, doc) of a document store, at any depth; hidden folders are skipped."""
    docs = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    rows = docs.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("doc")).filter(F.col("file").rlike(_STORED) & ~F.col("file").rlike(r"/\.git/"))
    return rows.select(F.concat(F.regexp_extract("file", _STORED, 1), F.regexp_extract("file", _STORED, 2)).alias("bom_id"), "doc")


def doc_lines(docs: DataFrame) -> DataFrame:
    """(bom_id, blob, child_bom, line) of documents, without their header."""
    lines = docs.select("bom_id", F.explode(F.split("doc", "\n")).alias("line")).filter("line <> '' AND NOT startswith(line, 'gitoid:')")
    return lines.withColumn("p", ident.parse_line(F.col("line"))).select("bom_id", "p.blob", F.col("p.bom").alias("child_bom"), "line").filter("blob IS NOT NULL")


def docs_with(lines: DataFrame, blobs: DataFrame) -> DataFrame:
    """(blob, bom_id): the documents that mention each of ``blobs(blob)``."""
    told = lines.select(ident.packed(F.col("blob")).alias("blob"), ident.packed(F.col("bom_id")).alias("bom_id")).repartition("blob").dropDuplicates(["blob", "bom_id"])
    asked = blobs.select(ident.packed(F.col("blob")).alias("blob")).distinct()
    return told.join(asked, "blob", "left_semi").select(ident.unpacked(F.col("blob")).alias("blob"), ident.unpacked(F.col("bom_id")).alias("bom_id"))


def bare_docs(docs: DataFrame) -> DataFrame:
    """Documents without their header and separators: what is left is identifiers."""
    return docs.withColumn("doc", F.regexp_replace(F.regexp_replace(F.regexp_replace("doc", r"^gitoid:[^\n]*\n", ""), "(?m)^blob ", ""), " bom ", ""))


def restored_docs(docs: DataFrame) -> DataFrame:
    """The inverse of ``bare_docs``; the algorithm is told by the length of the lines."""
    first = F.length(F.split("doc", "\n")[0])
    alg = F.when(first.isin(64, 128), "sha256").otherwise("sha1")
    size = F.when(alg == "sha256", 64).otherwise(40)
    lines = F.transform(F.filter(F.split("doc", "\n"), lambda x: x != ""), lambda x: F.concat(F.lit("blob "), F.substring(x, F.lit(1), size), F.when(F.length(x) > size, F.concat(F.lit(" bom "), F.substring(x, size + 1, size))).otherwise(F.lit(""))))
    return docs.withColumn("doc", F.concat(F.lit("gitoid:blob:"), alg, F.lit("\n"), F.array_join(lines, "\n"), F.lit("\n")))


# ---- vulnerability inputs


def read_cve_ranges(spark: SparkSession, path: str) -> DataFrame:
    """(cve, lo_blob, hi_blob) of lines with exactly three words; comments and others are skipped."""
    words = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("w")).filter((F.size("w") == 3) & ~F.startswith(F.col("w")[0], F.lit("#")))
    return words.select(F.col("w")[0].alias("cve"), F.col("w")[1].alias("lo_blob"), F.col("w")[2].alias("hi_blob"))


def _yaml_rows(text: str) -> list[tuple[int, str]]:
    """(depth, line) without blank lines and comments; lists and texts that go over several lines are put on one."""
    out, lines, k = [], text.splitlines(), 0
    while k < len(lines):
        line, k = lines[k], k + 1
        body = line.strip()
        if not body or body.startswith("#") or body in ("---", "..."):
            continue
        if "\t" in line[: len(line) - len(line.lstrip())]:
            raise ValueError(f"line {k}: a tab as indentation")
        depth = len(line) - len(line.lstrip())
        if (block := re.search(r"(?:^|[:-]\s)\s*([|>])([+-]?)$", body)) is not None:
            own = []
            while k < len(lines) and (not lines[k].strip() or len(lines[k]) - len(lines[k].lstrip()) > depth):
                own.append(lines[k])
                k += 1
            edge = min((len(x) - len(x.lstrip()) for x in own if x.strip()), default=0)
            parts = [x[edge:].rstrip() for x in own]
            value = "\n".join(parts).strip("\n") if block[1] == "|" else re.sub(r"(?<!\n)\n(?!\n)", " ", "\n".join(parts).strip("\n"))
            body = body[: block.start(1)] + json.dumps(value + ("" if block[2] == "-" else "\n"))
        else:
            plain = re.sub(r"""("(?:[^"\\]|\\.)*"|'[^']*')|\s+#.*$""", lambda m: m[1] or "", body)
            while plain.count("[") > plain.count("]") and re.search(r"(?:^|[:-]\s)\s*\[", plain) and k < len(lines):
                plain, k = plain + " " + lines[k].strip(), k + 1
            # A plain text goes on in deeper lines that are no pairs and no items.
            while re.search(r"(?::|-)\s+[^\s\[\"'{|>&*!][^\n]*$", plain) and k < len(lines):
                more = lines[k].strip()
                if not more or len(lines[k]) - len(lines[k].lstrip()) <= depth or more.startswith(("- ", "#")) or re.match(r"[^:'\"\s][^:]*:(?:\s|$)", more):
                    break
                plain, k = f"{plain} {more}", k + 1
            body = plain.rstrip()
        out.append((depth, body))
    return out


def small_yaml(text: str) -> object:
    """Mappings and lists by indentation, of plain, quoted and block texts and of lists in brackets: what rule files use of YAML.

    Anything else is refused with ``ValueError``, not skipped.
    """
    rows = _yaml_rows(text)

    def scalar(x: str):
        x = x.strip()
        if x[:1] == '"':
            return json.loads(x)
        if x[:1] == "'":
            if len(x) < 2 or x[-1] != "'":
                raise ValueError(f"quotes that do not end: {x}")
            return x[1:-1].replace("''", "'")
        if x[:1] == "[":
            if x[-1] != "]":
                raise ValueError(f"brackets that do not end: {x}")
            items = re.findall(r"""\s*("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^,\[\]{}]+)\s*(?:,|$)""", x[1:-1])
            if re.sub(r"[\s,]", "", x[1:-1]) != re.sub(r"[\s,]", "", "".join(items)):
                raise ValueError(f"lists in lists: {x}")
            return [scalar(i) for i in items]
        if x[:1] in "{&*!|>%@`" and x:
            raise ValueError(f"not supported: {x}")
        return x

    def pair(x: str):
        found = re.match(r"""((?:"(?:[^"\\]|\\.)*"|'[^']*'|[^:'"\s\[{][^:]*?))\s*:(?:\s+(.*))?$""", x)
        return (scalar(found[1]), found[2]) if found else None

    def block(at: int, depth: int):
        if rows[at][1].startswith("- ") or rows[at][1] == "-":
            out: object = []
            while at < len(rows) and rows[at][0] == depth and (rows[at][1].startswith("- ") or rows[at][1] == "-"):
                rest = rows[at][1][1:].strip()
                if not rest and at + 1 < len(rows) and rows[at + 1][0] > depth:
                    value, at = block(at + 1, rows[at + 1][0])
                elif pair(rest):
                    rows[at] = (depth + len(rows[at][1]) - len(rest), rest)
                    value, at = block(at, rows[at][0])
                else:
                    value, at = scalar(rest) if rest else None, at + 1
                out.append(value)
        else:
            out = {}
            while at < len(rows) and rows[at][0] == depth and (found := pair(rows[at][1])):
                key, rest = found
                at += 1
                if rest:
                    out[key] = scalar(rest)
                elif at < len(rows) and (rows[at][0] > depth or rows[at][0] == depth and rows[at][1].startswith("- ")):
                    out[key], at = block(at, rows[at][0])
                else:
                    out[key] = None
        if at < len(rows) and rows[at][0] >= depth and not (rows[at][0] == depth and isinstance(out, list) and pair(rows[at][1])):
            raise ValueError(f"cannot read: {rows[at][1]}")
        return out, at

    if not rows:
        return {}
    value, at = block(0, rows[0][0])
    if at < len(rows):
        raise ValueError(f"cannot read: {rows[at][1]}")
    return value


def _texts(df: DataFrame, make, schema: str) -> DataFrame:
    """Rows that ``make(file, text)`` gives for each of a few small files."""
    names = [x.split()[0] for x in re.split(r",\s*(?![^<]*>)", schema)]

    def run(batches):
        for batch in batches:
            made = [r for f, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in make(f, t)]
            if made:
                columns = list(zip(*made, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) if any(v is not None for v in c) else pa.nulls(len(c), pa.string()) for c in columns], names)

    return df.mapInArrow(run, schema)


def _groups(items) -> list[list[str]]:
    """Rule items: a word stands for itself, a mapping's list for a choice of words."""
    out = []
    for item in items or []:
        if isinstance(item, dict):
            out += [[str(x) for x in (v if isinstance(v, list) else [v])] for v in item.values()]
        else:
            out.append([str(item)])
    return out


def read_cve_rules(spark: SparkSession, add_path: str, fix_path: str) -> DataFrame:
    """Rules of both kinds (``schemas.CVE_RULE``), numbered in file order."""

    def rules(kind):
        def make(_, text):
            n = 0
            for cve, files in (small_yaml(text) or {}).items():
                for src, rule in (files or {}).items():
                    yield n, cve, src, kind, _groups((rule or {}).get("include")), _groups((rule or {}).get("exclude"))
                    n += 1

        return make

    schema = "rule_ord long, cve string, src_file string, rule_type string, include array<array<string>>, exclude array<array<string>>"
    parts = [_texts(_whole(spark, p), rules(k), schema) for p, k in ((add_path, "cveadd"), (fix_path, "cvefix"))]
    return parts[0].unionByName(parts[1])


def read_cve_info(spark: SparkSession, path: str) -> DataFrame:
    """(cve, kind, commit, src_files) of YAML notes named by commit: ``Added`` or ``Fixed``, then vulnerabilities and files."""

    def make(file, text):
        yield from _notes(re.sub(r"\.[^.]*$", "", file.rsplit("/", 1)[-1]), text)

    return _texts(_whole(spark, path), make, "cve string, kind string, commit string, src_files array<string>")


# ---- exported version control text


def read_git_log(spark: SparkSession, path: str) -> DataFrame:
    """``schemas.GIT_CHANGE`` rows of a ``--raw`` log with full ids, commits numbered from the newest, 0.

    The log is split at ``commit`` lines by the reader, so its size does not matter.
    """
    from stemma.sources.rawlog import number_stanzas

    rows = spark.read.option("lineSep", "\ncommit ").text(path)
    placed = rows.select(F.regexp_replace("value", "^commit ", "").alias("value"), F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    commits = number_stanzas(placed).select((F.col("seq") - 1).alias("ord"), F.regexp_extract("value", "^([0-9a-f]{40,64})", 1).alias("commit"), F.explode(F.split("value", "\n")).alias("line"))
    raw = r"^:\d+ \d+ ([0-9a-f]+) ([0-9a-f]+) ([A-Z])\d*\t([^\t]+)(?:\t(.+))?$"
    part = lambda k: F.regexp_extract("line", raw, k)
    return commits.filter(F.col("line").rlike(raw)).select("ord", "commit", F.coalesce(F.nullif(part(5), F.lit("")), part(4)).alias("path"), part(1).alias("src_blob"), part(2).alias("dst_blob"), part(3).alias("change"))


def file_history(changes: DataFrame) -> DataFrame:
    """(path, ord, blob): each file's contents, newest first."""
    return changes.select("path", "ord", F.col("dst_blob").alias("blob")).filter(~ident.is_zero(F.col("blob")))


def read_git_tree(spark: SparkSession, path: str) -> DataFrame:
    """(blob, size, path) of lines ``mode blob id size<tab>path``; names that start with a dot are left out."""
    line = r"^\d+ blob ([0-9a-f]+)\s+(\d+)\t(.+)$"
    part = lambda k: F.regexp_extract("value", line, k)
    rows = spark.read.text(path).filter(F.col("value").rlike(line)).select(part(1).alias("blob"), part(2).cast("long").alias("size"), part(3).alias("path"))
    return rows.filter(~F.col("path").rlike(r"(^|/)\.[^/]*$"))


# ---- packages


def read_deb822(spark: SparkSession, path: str) -> DataFrame:
    """(fields map<string,string>) of each stanza between blank lines; continued lines are kept under their field.

    Of a field that a stanza repeats the first counts.
    """
    stanza = spark.read.option("lineSep", "\n\n").text(path).filter(F.trim("value") != "")
    joined = F.regexp_replace("value", r"\n(?=[ \t])", "\x1e")
    pairs = F.transform(F.filter(F.split(joined, "\n"), lambda x: x.rlike(r"^[A-Za-z0-9-]+:")), lambda x: F.struct(F.regexp_extract(x, "^([A-Za-z0-9-]+):", 1).alias("k"), F.trim(F.replace(F.regexp_replace(x, "^[A-Za-z0-9-]+:", ""), F.lit("\x1e"), F.lit("\n"))).alias("v")))
    names = F.array_distinct(F.transform("pairs", lambda p: p["k"]))
    first = F.transform(names, lambda k: F.get(F.filter("pairs", lambda p: p["k"] == k), F.lit(0))["v"])
    return stanza.select(pairs.alias("pairs")).select(F.map_from_arrays(names, first).alias("fields"))


def read_deb_sources(spark: SparkSession, path: str) -> DataFrame:
    """(package, version, directory, files) of a source index; files are (size, name)."""
    rows = read_deb822(spark, path).filter("fields['Package'] IS NOT NULL")
    listed = F.filter(F.transform(F.split(F.col("fields")["Files"], "\n"), lambda x: F.split(F.trim(x), r"\s+")), lambda w: F.size(w) == 3)
    files = F.transform(listed, lambda w: F.struct(w[1].cast("long").alias("size"), w[2].alias("name")))
    return rows.select(F.col("fields")["Package"].alias("package"), F.col("fields")["Version"].alias("version"), F.col("fields")["Directory"].alias("directory"), F.coalesce(files, F.array().cast("array<struct<size:bigint,name:string>>")).alias("files"))


def read_recipes(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, version, download_locations) of recipe documents; names lose their ``recipe-``."""
    doc = F.from_json("text", "struct<packages:array<struct<name:string,versionInfo:string,downloadLocation:string>>>")
    rows = _whole(spark, path).select("file", doc["packages"].alias("p"))
    known = F.filter(F.transform("p", lambda p: p["downloadLocation"]), lambda x: x.isNotNull() & ~x.isin("NOASSERTION", "NONE"))
    return rows.select("file", F.regexp_replace(F.col("p")[0]["name"], "^recipe-", "").alias("name"), F.col("p")[0]["versionInfo"].alias("version"), F.array_distinct(known).alias("download_locations"))


def read_egg_info(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, version) of Python package metadata."""
    field = lambda k: F.nullif(F.trim(F.regexp_extract("text", rf"(?m)^{k}:(.*)$", 1)), F.lit(""))
    return _whole(spark, path).select("file", field("Name").alias("name"), field("Version").alias("version"))


def read_rpm_spec(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, version, release, patches): tags with their ``%{name}`` and ``%{version}`` filled in."""
    tag = lambda k: F.trim(F.regexp_extract("text", rf"(?mi)^{k}:(.*)$", 1))
    fill = lambda c: F.replace(F.replace(c, F.lit("%{name}"), tag("Name")), F.lit("%{version}"), tag("Version"))
    patches = F.transform(F.regexp_extract_all("text", F.lit(r"(?mi)^Patch\d*:\s*(\S+)"), F.lit(1)), fill)
    return _whole(spark, path).select("file", tag("Name").alias("name"), tag("Version").alias("version"), fill(tag("Release")).alias("release"), patches.alias("patches"))


# ---- traces


def read_strace(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, pid, child, prog, argv, raw) of process calls; calls that failed are left out."""
    lines = numbered_lines(spark, path).filter(~F.col("raw").rlike(r" = -1 [A-Z]+"))
    spawn = r"^(\d+)\s.*\b(?:clone3?|v?fork)\(.*\)?\s*= (\d+)\s*$"
    resumed = r"^(\d+)\s.*<\.\.\. (?:clone3?|v?fork) resumed>.*= (\d+)\s*$"
    execve = r"^(\d+)\s.*\bexecve\(\"([^\"]*)\", \[(.*?)\](?:,|$)"
    part = lambda p, k: F.nullif(F.regexp_extract("raw", p, k), F.lit(""))
    child = F.coalesce(part(spawn, 2), part(resumed, 2))
    argv = F.regexp_extract_all(part(execve, 3), F.lit(r'"((?:[^"\\]|\\.)*)"'), F.lit(1))
    return lines.select("line_no", F.nullif(F.regexp_extract("raw", r"^(\d+)\s", 1), F.lit("")).alias("pid"), child.alias("child"), part(execve, 2).alias("prog"), F.array_join(argv, " ").alias("argv"), "raw")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, raw) of text lines, from 1."""
    from stemma.sources.rawlog import number_stanzas

    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    return number_stanzas(rows).select(F.col("seq").alias("line_no"), F.col("value").alias("raw"))


def read_class_access(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, pid, path, mode): Java sources that a trace opens to read, and class files it opens to write."""
    opened = r"^(?:(\d+)\s)?.*\bopenat\([^,]*, \"([^\"]+\.(java|class))\", ([A-Z_|]+)"
    part = lambda k: F.regexp_extract("raw", opened, k)
    rows = numbered_lines(spark, path).filter(F.col("raw").rlike(opened) & ~F.col("raw").rlike(r" = -1 "))
    told = rows.select("line_no", F.nullif(part(1), F.lit("")).alias("pid"), part(2).alias("path"), part(3).alias("kind"), part(4).alias("flags"))
    read, write = (F.col("kind") == "java") & F.contains("flags", F.lit("O_RDONLY")), (F.col("kind") == "class") & F.contains("flags", F.lit("O_WRONLY"))
    return told.filter(read | write).select("line_no", "pid", "path", F.when(read, "read").otherwise("write").alias("mode"))


def class_steps(access: DataFrame) -> DataFrame:
    """(class_path, java_path): each written class with the source its process last read."""
    from stemma.operators.dag import latest_before

    reads = access.filter("mode = 'read'").select("pid", "line_no", F.col("path").alias("java_path"))
    return latest_before(access.filter("mode = 'write'"), reads, ["pid"], "line_no", "java_path", "java_path").select(F.col("path").alias("class_path"), "java_path")


def read_shell_commands(spark: SparkSession, path: str) -> DataFrame:
    """(file, pid, pwd, rootdir, prog, argv) of captured commands: four lines each, the fourth may go on."""
    lines = F.split("text", "\n")
    where = F.split(F.regexp_replace(F.get(lines, F.lit(1)), "^pwd: ", ""), " ")
    return _whole(spark, path).select(
        "file", F.regexp_extract(lines[0], r"pid: (\d+)", 1).alias("pid"), where[0].alias("pwd"), F.coalesce(F.get(where, F.lit(1)), F.lit("")).alias("rootdir"),
        F.get(lines, F.lit(2)).alias("prog"), F.rtrim(F.array_join(F.slice(lines, 4, F.size(lines)), "\n"), F.lit("\n")).alias("argv"),
    )


def read_depend_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, target, depends): a make rule's first stanza with its continued lines, or the edges of a dot graph's names."""
    dot = F.col("text").rlike(r"^\s*digraph")
    flat = F.replace("text", F.lit("\\\n"), F.lit(" "))
    rule = F.split(flat, "\n")[0]
    target = F.trim(F.regexp_extract(rule, r"^(.*?):(?:\s|$)", 1))
    words = F.filter(F.split(F.trim(F.regexp_replace(rule, r"^.*?:(?=\s|$)", "")), r"\s+"), lambda x: x != "")
    labels = F.array_distinct(F.regexp_extract_all("text", F.lit(r'label="([^"]+)"'), F.lit(1)))
    return _whole(spark, path).select("file", F.when(~dot, target).alias("target"), F.when(dot, labels).otherwise(words).alias("depends"))


def read_patches(spark: SparkSession, path: str, strip: int = 1) -> DataFrame:
    """(file, targets): the files a patch changes, without ``strip`` leading folders; of both names the one that is not null."""
    head = r"(?m)^--- ([^\t\n]+).*\n\+\+\+ ([^\t\n]+)"
    pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(head), F.lit(1)).alias("a"), F.regexp_extract_all("text", F.lit(head), F.lit(2)).alias("b"))
    parts = lambda c: F.split(F.trim(c), "/")
    cut = lambda c: F.array_join(F.slice(parts(c), strip + 1, F.size(parts(c))), "/")
    return _whole(spark, path).select("file", F.array_distinct(F.transform(pairs, lambda p: F.when(p["b"].startswith("/dev/null"), cut(p["a"])).otherwise(cut(p["b"])))).alias("targets"))


# ---- files and archives


def read_files(spark: SparkSession, path: str, glob: str | None = None, *, alg: str = "sha1") -> DataFrame:
    """(path, blob, size, magic): a folder's non-empty regular files with their identifiers."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).filter("length > 0").select("path", ident.gitoid(F.col("content"), alg).alias("blob"), F.col("length").alias("size"), F.substring("content", 1, 512).alias("magic"))


_MEMBER = "archive string, path string, content binary, error string"


def _cpio(raw: bytes):
    """Regular files of a ``newc`` archive."""
    at = 0
    while raw[at : at + 5] == b"07070":
        mode, size, length = (int(raw[at + k : at + k + 8], 16) for k in (14, 54, 94))
        name = raw[at + 110 : at + 110 + length - 1].decode("utf-8", "replace")
        start = at + 110 + length + -(at + 110 + length) % 4
        if name == "TRAILER!!!":
            return
        if mode & 0o170000 == 0o100000:
            yield name, raw[start : start + size]
        at = start + size + -(start + size) % 4
    raise ValueError("a cpio archive without its end")


def _inflated(raw: bytes) -> bytes:
    """What a gzip, xz, bzip2 or zstd file holds; other content as it is."""
    import bz2
    import gzip
    import lzma

    if raw[:2] == b"\x1f\x8b":
        return gzip.decompress(raw)
    if raw[:6] == b"\xfd7zXZ\0" or raw[:3] == b"\x5d\0\0":
        return lzma.decompress(raw)
    if raw[:3] == b"BZh":
        return bz2.decompress(raw)
    if raw[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    return raw


def _rpm_header(raw: bytes, at: int) -> tuple[dict[int, str], int]:
    """Texts of a header by tag, and where it ends."""
    import struct

    if raw[at : at + 3] != b"\x8e\xad\xe8":
        raise ValueError("no rpm header")
    count, size = struct.unpack_from(">II", raw, at + 8)
    store = at + 16 + 16 * count
    found = {}
    for k in range(count):
        tag, kind, offset, _ = struct.unpack_from(">IIII", raw, at + 16 + 16 * k)
        if kind in (6, 9):
            found[tag] = raw[store + offset : raw.index(b"\0", store + offset)].decode("utf-8", "replace")
    return found, store + size


def rpm_parts(raw: bytes) -> tuple[dict[int, str], bytes]:
    """An rpm file's header texts by tag, and its payload, packed as it is."""
    if raw[:4] != b"\xed\xab\xee\xdb":
        raise ValueError("no rpm file")
    _, end = _rpm_header(raw, 96)
    header, end = _rpm_header(raw, end + -end % 8)
    return header, raw[end:]


def _ar(raw: bytes):
    at, names = 8, b""
    while at + 60 <= len(raw):
        name, size = raw[at : at + 16].decode("latin1").strip(), int(raw[at + 48 : at + 58])
        data = raw[at + 60 : at + 60 + size]
        if len(data) < size:
            raise ValueError("a member without its end")
        if name == "//":
            names = data
        elif name.startswith("/") and name[1:].isdigit():
            yield names[int(name[1:]) :].split(b"/\n", 1)[0].decode("utf-8", "replace"), data
        elif name.startswith("#1/"):
            length = int(name[3:])
            yield data[:length].rstrip(b"\0").decode("utf-8", "replace"), data[length:]
        elif name not in ("", "/", "/SYM64/"):
            yield name.rstrip("/"), data
        at += 60 + size + size % 2


def _tar(raw: bytes):
    with tarfile.open(fileobj=io.BytesIO(raw)) as t:
        yield from ((m.name, t.extractfile(m).read()) for m in t if m.isreg())


def archive_members(raw: bytes):
    """(path, content) of the regular files in an archive; ``ValueError`` for other content.

    Of a deb package the files of its data archive, of an rpm those of its
    payload.
    """
    if raw[:4] == b"PK\x03\x04":
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            yield from ((i.filename, z.read(i)) for i in z.infolist() if not i.is_dir())
    elif raw[:8] == b"!<arch>\n":
        found = list(_ar(raw))
        if found and found[0][0] == "debian-binary":
            for name, data in found:
                if name.startswith("data.tar"):
                    yield from _tar(_inflated(data))
        else:
            yield from found
    elif raw[:4] == b"\xed\xab\xee\xdb":
        yield from _cpio(_inflated(rpm_parts(raw)[1]))
    elif raw[:5] == b"07070":
        yield from _cpio(raw)
    else:
        yield from _tar(_inflated(raw))


def _unpacked(alg: str | None):
    """Members of archives (path, content), with their content or, given an algorithm, their identifier and size."""
    import hashlib

    def run(batches):
        for batch in batches:
            for archive, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                try:
                    for name, data in archive_members(raw.as_py() or b""):
                        if alg is None:
                            rows.append((archive, name, data, None))
                        else:
                            rows.append((archive, name, hashlib.new(alg, b"blob %d\0" % len(data) + data).hexdigest(), len(data), None))
                except Exception as e:  # whatever a damaged file makes its reader raise is told in its row
                    rows.append((archive, *[None] * (2 if alg is None else 3), f"{type(e).__name__}: {e}"))
                if rows:
                    kinds = (pa.string(), pa.string(), pa.binary(), pa.string()) if alg is None else (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string())
                    names = ["archive", "path", "content", "error"] if alg is None else ["archive", "path", "blob", "size", "error"]
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def expand_archives(spark: SparkSession, path: str, glob: str | None = None, *, alg: str = "sha1") -> DataFrame:
    """(archive, path, blob, size, error) of the regular files in tar, zip (jar, wheel), ``ar``, deb, rpm and cpio archives.

    An archive is read by one task, a member at a time.  A file that is damaged
    or no archive has a row that says so in ``error``, after what could be read.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", "content").mapInArrow(_unpacked(alg), "archive string, path string, blob string, size long, error string")


#: Tags of a package header.
_RPM_TAGS = {"name": 1000, "version": 1001, "release": 1002, "arch": 1022, "source_rpm": 1044}


def read_package_headers(spark: SparkSession, path: str) -> DataFrame:
    """(path, pkg_type, name, version, arch, source) of deb and rpm files, from their own headers; other files are left out."""

    def about(raw: bytes):
        if raw[:4] == b"\xed\xab\xee\xdb":
            header, _ = rpm_parts(raw)
            told = {k: header.get(t) for k, t in _RPM_TAGS.items()}
            return "rpm" if told["source_rpm"] else "src.rpm", told["name"], f"{told['version']}-{told['release']}", told["arch"], told["source_rpm"]
        for name, data in _ar(raw):
            if name.startswith("control.tar"):
                for inner, content in _tar(_inflated(data)):
                    if inner.rsplit("/", 1)[-1] == "control":
                        found = dict(re.findall(r"(?m)^([A-Za-z-]+):[ \t]*(.*)$", content.decode("utf-8", "replace")))
                        return "deb", found.get("Package"), found.get("Version"), found.get("Architecture"), found.get("Source")
        return None

    def run(batches):
        for batch in batches:
            rows = []
            for file, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = raw.as_py() or b""
                if raw[:4] == b"\xed\xab\xee\xdb" or raw[:8] == b"!<arch>\n" and b"debian-binary" in raw[8:24]:
                    rows.append((file, *(about(raw) or [None] * 5)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in zip(*rows, strict=True)], ["path", "pkg_type", "name", "version", "arch", "source"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInArrow(run, "path string, pkg_type string, name string, version string, arch string, source string")


def read_embedded_ids(spark: SparkSession, path: str, owner: str, alg: str = "sha1") -> DataFrame:
    """(path, member, blob, bom_id) of files with the document id that is embedded in them, or null.

    ``owner`` names the note section in object files.  Archives (``ar``, zip)
    carry the id as the content of a member of that name, or as notes in their
    members, which are rows of their own; ``member`` is null for a file itself.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    inner = rows.filter(text.file_kind(F.col("content")).isin("archive", "zip")).mapInArrow(_unpacked(None), _MEMBER)
    label = f"{alg}:" if alg != "sha1" else ""
    told = F.when(F.element_at(F.split("path", "/"), -1) == F.lit(owner), F.regexp_extract(F.decode("content", "UTF-8"), rf"{label}\b([0-9a-f]{{{ident.ALGORITHMS[alg]}}})\b", 1))
    members = inner.filter("error IS NULL").select(
        F.col("archive").alias("path"), F.col("path").alias("member"), ident.gitoid(F.col("content"), alg).alias("blob"),
        F.coalesce(F.nullif(told, F.lit("")), ident.read_embedded_note(F.col("content"), owner, alg)).alias("bom_id"),
    )
    whole = F.when(~text.file_kind(F.col("content")).isin("archive", "zip"), ident.read_embedded_note(F.col("content"), owner, alg))
    own = rows.select("path", ident.gitoid(F.col("content"), alg).alias("blob"), whole.alias("bom_id"))
    named = members.filter(F.element_at(F.split("member", "/"), -1) == F.lit(owner)).groupBy("path").agg(F.min("bom_id").alias("inside"))
    own = own.join(named, "path", "left").select("path", F.lit(None).cast("string").alias("member"), "blob", F.coalesce("inside", "bom_id").alias("bom_id"))
    return own.unionByName(members)


def chosen_bom(recorded: Column, embedded: Column, *, prefer_embedded: bool = False) -> Column:
    """The document of a file that may have one recorded and one embedded."""
    return F.coalesce(embedded, recorded) if prefer_embedded else F.coalesce(recorded, embedded)


def python_imports(files: DataFrame) -> DataFrame:
    """(path, module, lineno, level, in_except) of sources (path, text), from their syntax trees alone.

    ``from m import n`` names both ``m`` and ``m.n``, since either may be a
    file.  A source that does not parse imports nothing.
    """

    def found(text: str):
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError):
            return
        handled = {id(x) for t in ast.walk(tree) if isinstance(t, ast.Try) for part in (t.body, *(h.body for h in t.handlers)) for s in part for x in ast.walk(s)}
        for node in ast.walk(tree):
            if isinstance(node, ast.Import):
                for name in node.names:
                    yield name.name, node.lineno, 0, id(node) in handled
            elif isinstance(node, ast.ImportFrom):
                base = node.module or ""
                names = [base] if base else []
                names += [f"{base}.{n.name}" if base else n.name for n in node.names if n.name != "*"]
                for name in names:
                    yield name, node.lineno, node.level, id(node) in handled

    def run(batches):
        for batch in batches:
            rows = [(p, *r) for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in found(t or "")]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_()), strict=True)], ["path", "module", "lineno", "level", "in_except"])

    return files.select("path", "text").mapInArrow(run, "path string, module string, lineno int, level int, in_except boolean")


# ---- what other tools print


def cve_info_of_messages(messages: DataFrame) -> DataFrame:
    """(cve, kind, commit, src_files) of annotated tags (commit, text) whose messages hold the same notes as files do."""

    def make(commit, text):
        body = "\n".join(x for x in (text or "").splitlines() if re.match(r"\s*(-|Added:|Fixed:|CVE-|src_files:|\S+\.\w+$)", x))
        for cve, kind, _, files in _notes(commit, body):
            yield cve, kind, commit, files

    return _texts(messages.select("commit", "text"), make, "cve string, kind string, commit string, src_files array<string>")


def _notes(commit: str, text: str):
    for kind, cves in (small_yaml(text) or {}).items():
        for cve, about in (cves if isinstance(cves, dict) else {c: None for c in cves or []}).items():
            files = about.get("src_files") if isinstance(about, dict) else about
            yield cve, kind, commit, files.split() if isinstance(files, str) else list(files or [])


def read_library_cache(spark: SparkSession, path: str) -> DataFrame:
    """(soname, path) of a printed loader cache: a folder's line ends with a colon, and its libraries follow."""
    rows = numbered_lines(spark, path).withColumn("folder", F.nullif(F.regexp_extract("raw", r"^(/[^:]*):(?:$|\s)", 1), F.lit("")))
    from stemma.operators.dag import latest_before

    links = rows.filter(F.contains("raw", F.lit(" -> "))).select("line_no", F.regexp_extract("raw", r"^\s*(\S+) -> (\S+)", 1).alias("soname"), F.regexp_extract("raw", r"^\s*(\S+) -> (\S+)", 2).alias("name"), F.lit(1).alias("cache"))
    folders = rows.filter("folder IS NOT NULL").select("line_no", F.lit(1).alias("cache"), F.col("folder").alias("lib_dir"))
    return latest_before(links, folders, ["cache"], "line_no", "lib_dir", "folder").select("soname", F.concat_ws("/", "folder", "name").alias("path"))


def read_dynamic_sections(spark: SparkSession, path: str, folder: str = "/") -> DataFrame:
    """(path, needed, rpath) of printed dynamic sections, one file for each object, named after it; ``$ORIGIN`` is its folder."""
    values = lambda kind: F.flatten(F.transform(F.regexp_extract_all("text", F.lit(rf"\((?:{kind})\)[^\[\n]*\[([^\]]*)\]"), F.lit(1)), lambda v: F.split(v, ":")))
    name = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.txt$", "")
    own = F.concat(F.lit(folder.rstrip("/") + "/"), F.replace(name, F.lit("%"), F.lit("/")))
    here = F.regexp_replace("path", "/[^/]*$", "")
    rows = _whole(spark, path).select(own.alias("path"), values("NEEDED").alias("needed"), values("RPATH|RUNPATH").alias("rpath"))
    return rows.withColumn("rpath", F.transform("rpath", lambda p: F.replace(F.replace(p, F.lit("${ORIGIN}"), here), F.lit("$ORIGIN"), here)))


def class_files(files: DataFrame) -> DataFrame:
    """(path, class_name, source_file) of compiled classes (path, content), from their constant pools."""
    import struct

    def about(raw: bytes):
        if raw[:4] != b"\xca\xfe\xba\xbe":
            return None, None
        at, pool, k = 10, {}, 1
        count = struct.unpack_from(">H", raw, 8)[0]
        sizes = {3: 4, 4: 4, 5: 8, 6: 8, 7: 2, 8: 2, 9: 4, 10: 4, 11: 4, 12: 4, 15: 3, 16: 2, 17: 4, 18: 4, 19: 2, 20: 2}
        while k < count:
            tag = raw[at]
            if tag == 1:
                n = struct.unpack_from(">H", raw, at + 1)[0]
                pool[k] = raw[at + 3 : at + 3 + n].decode("utf-8", "replace")
                at += 3 + n
            else:
                pool[k] = struct.unpack_from(">H", raw, at + 1)[0]
                at += 1 + sizes[tag]
            k += 2 if tag in (5, 6) else 1
        name = pool.get(pool.get(struct.unpack_from(">H", raw, at + 2)[0]))
        at += 6
        at += 2 + 2 * struct.unpack_from(">H", raw, at)[0]

        def attributes(at):
            found = {}
            n, at = struct.unpack_from(">H", raw, at)[0], at + 2
            for _ in range(n):
                key, size = struct.unpack_from(">HI", raw, at)
                found[pool.get(key)] = at + 6
                at += 6 + size
            return found, at

        for _ in range(2):  # fields, then methods
            n, at = struct.unpack_from(">H", raw, at)[0], at + 2
            for _ in range(n):
                _, at = attributes(at + 6)
        found, _ = attributes(at)
        source = pool.get(struct.unpack_from(">H", raw, found["SourceFile"])[0]) if "SourceFile" in found else None
        return name, source

    def run(batches):
        for batch in batches:
            told = [about(c.as_py() or b"") for c in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t[0] for t in told], pa.string()), pa.array([t[1] for t in told], pa.string())], ["path", "class_name", "source_file"])

    return files.select("path", "content").mapInArrow(run, "path string, class_name string, source_file string")

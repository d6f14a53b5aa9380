"""Build-step logs: text to records and back.

A log is a row of stanzas that each end with a line ``==== End of raw info for
...``.  That line's start serves as record separator, so Spark splits a log of
any size; what is left of the line leads the next stanza and is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stemma.functions.ident import packed, unpacked
from stemma.plans.storage import lean_writes
from stemma.sources import schemas

#: Fixed value: how a stanza ends.
END = "==== End of raw info for "


def read_raw_log(spark: SparkSession, path: str, *, strict: bool = False) -> DataFrame:
    """Records (``schemas.RECORD``) of a log, numbered in its order.

    With ``strict`` a path ends at its first space, as tools that split at
    white space read it; otherwise it runs up to the next known token.
    """
    stanza = spark.read.option("lineSep", END).text(path)
    placed = stanza.select(F.col("value"), F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    return parse_stanzas(number_stanzas(placed), strict=strict)


def number_stanzas(placed: DataFrame) -> DataFrame:
    """(seq, value): stanzas (value, f, b, i) numbered in file order.

    Numbers are those of the blocks' sums plus the place in a block, so that no
    task holds a whole log.  A block's rows lie together in one task, so a place
    is what ``i`` (``monotonically_increasing_id``) is above the block's first,
    and no text is dealt.  Should a second reading cut the files otherwise, some
    place falls outside of its block, and the job fails.
    """
    blocks = placed.groupBy("f", "b").agg(F.min("i").alias("first"), F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy(F.lit(0)).orderBy("f", "b").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("f", "b", "first", "rows", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    place = F.col("i") - F.col("first")
    seq = F.when((place >= 0) & (place < F.col("rows")), F.col("start") + place + 1).otherwise(F.raise_error(F.lit("log blocks changed between two readings")))
    # One row for each block of a file.
    return placed.join(F.broadcast(starts), ["f", "b"], "left").select(seq.cast("long").alias("seq"), "value")


def _lines(value: Column) -> Column:
    return F.filter(F.transform(F.split(value, "\n"), lambda x: F.trim(x)), lambda x: x != "")


#: What may follow a path on its line.
_AFTER_PATH = r" (?:has_cve:|fixed_cve:|bomid: |prov_pkg: ).*$"


def _file(line: Column, strict: bool) -> tuple[Column, Column]:
    """Identifier and path of ``key: <id> path: <path>``; the identifier may be missing."""
    plain = F.regexp_replace(line, _AFTER_PATH, "")
    at = F.instr(plain, " path: ")
    path = F.when(at > 0, F.substring(plain, at + 7, F.length(plain)))
    head = F.split(F.substring(plain, F.lit(1), at - 1), " ")
    blob = F.when((at > 0) & (F.size(head) == 2), head[1])
    return F.nullif(blob, F.lit("")), F.nullif(F.split(path, " ")[0] if strict else path, F.lit(""))


def _list(line: Column, key: str) -> Column:
    found = F.regexp_extract(line, rf" {key}(CVE-\S+)", 1)
    return F.when(found != "", F.split(found, ",")).otherwise(F.array().cast("array<string>"))


def parse_stanzas(stanzas: DataFrame, *, strict: bool = False) -> DataFrame:
    """Records from (seq, value); stanzas that name neither an output nor a process are left out."""
    lines = _lines(F.col("value"))
    rows = stanzas.select("seq", lines.alias("lines"))
    one = lambda key: F.get(F.transform(F.filter("lines", lambda x: x.startswith(key)), lambda x: F.substring(x, F.lit(len(key) + 1), F.length(x))), F.lit(0))
    # Of several outputs, as logs without ends leave them behind, the last counts.
    outs = F.filter("lines", lambda x: x.startswith("outfile: "))
    out = F.get(outs, F.size(outs) - 1)
    blob, path = _file(out, strict)

    def infile(line: Column, pos: Column) -> Column:
        b, p = _file(line, strict)
        return F.struct(pos.alias("pos"), b.alias("blob"), p.alias("path"), _list(line, "has_cve:").alias("has_cve"), _list(line, "fixed_cve:").alias("fixed_cve"), F.nullif(F.regexp_extract(line, r" prov_pkg: (.*)$", 1), F.lit("")).alias("prov_pkg"))

    def dynlib(line: Column, pos: Column) -> Column:
        b, p = _file(line, strict)
        return F.struct(pos.alias("pos"), b.alias("blob"), p.alias("path"))

    pid = one("PID: ")
    made = rows.select(
        "seq", F.split(pid, r"\s+")[0].alias("pid"), F.get(F.split(pid, r"\s+"), F.lit(1)).alias("exec_mode"), blob.alias("out_blob"), path.alias("out_path"),
        one("build_cmd: ").alias("build_cmd"), one("build_tool: ").alias("build_tool"), one("pkg_info: ").alias("pkg_info"), F.split(one("prune: "), r"\s+")[0].alias("prune"),
        F.exists("lines", lambda x: x.startswith("ignore_this_record:")).alias("ignore"),
        F.transform(F.filter("lines", lambda x: x.startswith("infile: ")), infile).alias("infiles"), F.transform(F.filter("lines", lambda x: x.startswith("dynlib: ")), dynlib).alias("dynlibs"),
    )
    return made.filter("out_path IS NOT NULL OR out_blob IS NOT NULL OR size(infiles) > 0")


def stanza_text(*, end: str = "this process") -> Column:
    """The text of a record, over the columns of ``schemas.RECORD``."""
    given = lambda key, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{key}: "), F.col(c)))
    place = lambda key, b, p: F.concat(F.lit(f"{key}: "), F.coalesce(F.concat(b, F.lit(" ")), F.lit("")), F.lit("path: "), p)
    hints = lambda f: F.concat(
        F.when(F.size(f["has_cve"]) > 0, F.concat(F.lit(" has_cve:"), F.array_join(f["has_cve"], ","))).otherwise(F.lit("")),
        F.when(F.size(f["fixed_cve"]) > 0, F.concat(F.lit(" fixed_cve:"), F.array_join(f["fixed_cve"], ","))).otherwise(F.lit("")),
        F.coalesce(F.concat(F.lit(" prov_pkg: "), f["prov_pkg"]), F.lit("")),
    )
    return F.concat(
        F.lit("\n"),
        F.concat_ws(
            "\n",
            F.when(F.col("pid").isNotNull(), F.concat_ws(" ", F.lit("PID:"), "pid", "exec_mode")),
            F.when(F.col("out_path").isNotNull(), place("outfile", F.col("out_blob"), F.col("out_path"))),
            F.nullif(F.array_join(F.transform("infiles", lambda f: F.concat(place("infile", f["blob"], f["path"]), hints(f))), "\n"), F.lit("")),
            F.nullif(F.array_join(F.transform("dynlibs", lambda f: place("dynlib", f["blob"], f["path"])), "\n"), F.lit("")),
            given("build_cmd", "build_cmd"), given("build_tool", "build_tool"), given("pkg_info", "pkg_info"), given("prune", "prune"),
            F.when(F.coalesce(F.col("ignore"), F.lit(False)), F.lit("ignore_this_record: information only")),
            F.lit(END + end),
        ),
        F.lit("\n"),
    )


def write_raw_log(records: DataFrame, path: str, *, in_order: bool = False, compression: str | None = None) -> None:
    """A folder of part files, in log order from one part to the next.

    ``in_order`` says that the records lie in log order already, and are not
    dealt again.  Packed parts (``gzip``) are read back as they are, each by one task.
    """
    ordered = records if in_order else records.repartitionByRange("seq").sortWithinPartitions("seq")
    with lean_writes(records.sparkSession):
        ordered.select(stanza_text().alias("value")).write.text(path, compression=compression)


def file_set(records: DataFrame, *, with_dynlibs: bool = True) -> DataFrame:
    """Distinct (blob, path) of all files a log names."""
    own = F.array(F.struct(F.col("out_blob").alias("blob"), F.col("out_path").alias("path")))
    listed = lambda c: F.coalesce(F.transform(c, lambda f: F.struct(f["blob"].alias("blob"), f["path"].alias("path"))), F.array().cast("array<struct<blob:string,path:string>>"))
    # All files of a record at once: the log is read and parsed once.
    files = records.select(F.explode(F.concat(own, listed("infiles"), *([listed("dynlibs")] if with_dynlibs else []))).alias("f")).filter("f.path IS NOT NULL")
    once = files.select(packed(F.col("f.blob")).alias("blob"), F.col("f.path").alias("path")).distinct()
    return once.select(unpacked(F.col("blob")).alias("blob"), "path")


def annotate(records: DataFrame, blob_package: DataFrame) -> DataFrame:
    """Records whose inputs name their providing package, from (blob, prov_pkg)."""
    inputs = records.select("seq", F.explode("infiles").alias("f")).select("seq", "f.*")
    told = inputs.drop("prov_pkg").join(blob_package.select("blob", "prov_pkg"), "blob", "left")
    fields = ["pos", "blob", "path", "has_cve", "fixed_cve", "prov_pkg"]
    grouped = told.groupBy("seq").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("__in"))
    empty = F.array().cast(f"array<{schemas.INFILE}>")
    return records.join(grouped, "seq", "left").withColumn("infiles", F.coalesce("__in", empty)).drop("__in").select(*records.columns)


def truncate(records: DataFrame, blobs: DataFrame) -> DataFrame:
    """Records whose output is one of ``blobs(blob)``."""
    return records.join(blobs.select(F.col("blob").alias("out_blob")).distinct(), "out_blob", "left_semi").select(*records.columns)


def set_prune(records: DataFrame, blobs: DataFrame, value: str | None = "subtree") -> DataFrame:
    """Records with ``prune`` set for outputs in ``blobs(blob)``, or taken away where ``value`` is None."""
    named = blobs.select(F.col("blob").alias("out_blob"), F.lit(True).alias("__hit")).distinct()
    return records.join(named, "out_blob", "left").withColumn("prune", F.when(F.col("__hit"), F.lit(value)).otherwise(F.col("prune"))).select(*records.columns)


def linker_inputs(records: DataFrame) -> DataFrame:
    """(seq, kind, path) of one linker record's inputs: temporary objects, other inputs and shared libraries."""
    ins = records.select("seq", F.explode("infiles").alias("f")).select("seq", F.col("f.path").alias("path"))
    kinds = ins.select("seq", F.when(F.col("path").rlike(r"^/tmp/.*\.o$"), "temporary").otherwise("input").alias("kind"), "path")
    libs = records.select("seq", F.explode("dynlibs").alias("f")).select("seq", F.lit("dynlib").alias("kind"), F.col("f.path").alias("path"))
    return kinds.unionByName(libs)

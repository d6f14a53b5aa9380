"""Writers: JSON exports, the document store, symlink tables, part files and reports.

Canonical results stay Parquet tables; these render them for tools that read
the exchange formats.  Rendering happens in the executors, a row at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.operators import cvedb
from stemma.plans.storage import lean_writes


def promoted(names, singular: str, plural: str):
    """Struct fields for a list of names: the first as ``singular``, and all as ``plural`` if there are several."""
    return [F.get(names, F.lit(0)).alias(singular), F.when(F.size(names) > 1, names).alias(plural)]


def node_json(node: DataFrame, edge: DataFrame) -> DataFrame:
    """(blob, json): an artifact's entry, with the sorted list of its inputs; absent values are left out."""
    trees = edge.groupBy(F.col("out_blob").alias("blob")).agg(F.array_sort(F.collect_set("in_blob")).alias("hash_tree"))
    body = F.struct(*promoted(F.col("file_paths"), "file_path", "file_paths"), F.col("hash_tree"), *promoted(F.col("build_cmds"), "build_cmd", "build_cmds"), *promoted(F.col("build_tools"), "build_tool", "build_tools"), *promoted(F.col("pkg_infos"), "pkg_info", "pkg_infos"), F.col("prune"))
    return node.join(trees, "blob", "left").select("blob", F.to_json(body).alias("json"))


def cve_json(status: DataFrame) -> DataFrame:
    """(blob, json) of a vulnerability table; empty lists are left out."""
    wide = cvedb.wide(status)
    lists = [F.when(F.size(c) > 0, F.col(c)).alias(c) for c in cvedb.STATUS_LISTS.values()]
    return wide.select("blob", F.to_json(F.struct("file_path", *lists)).alias("json"))


def write_json_db(entries: DataFrame, path: str, *, key: str = "blob", parts: int | None = None) -> None:
    """One JSON object ``{key: entry}`` as part files in key order; the parts, one after another, are the whole text.

    With ``parts=1`` it is one file, for tools that read a small table whole.

    Each row is one line ``"key": entry`` and only the first carries the
    opening and only the last the closing brace.  An empty table is ``{}``.
    """
    first, last = entries.agg(F.min(key), F.max(key)).first()
    if first is None:
        entries.sparkSession.createDataFrame([("{}",)], "value string").write.text(path)
        return
    pair = F.to_json(F.struct(F.col(key).alias("k"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col(key).alias("k")))) - 6)
    line = F.concat(F.when(F.col(key) == first, F.lit("{")).otherwise(F.lit("")), pair, F.lit(": "), F.col("json"), F.when(F.col(key) == last, F.lit("}")).otherwise(F.lit(",")))
    dealt = entries.repartitionByRange(parts, key) if parts else entries.repartitionByRange(key)
    dealt.sortWithinPartitions(key).select(line.alias("value")).write.text(path)


def write_doc_store(docs: DataFrame, path: str) -> None:
    """Add the documents that the store has not yet, each once, under ``path/prefix=xx``: its id's first two digits.

    A document that is there is not written again, whoever wrote it.
    """
    from pyspark.errors import AnalysisException

    rows = docs.filter("doc IS NOT NULL").select("bom_id", "doc", F.lit(False).alias("known"))
    try:
        rows = rows.unionByName(docs.sparkSession.read.parquet(path).select("bom_id", F.lit(None).cast("string").alias("doc"), F.lit(True).alias("known")))
    except AnalysisException:
        pass  # no store yet
    # Texts are dealt once, to where they are told apart and written.
    dealt = rows.withColumn("prefix", F.substring("bom_id", 1, 2)).repartition("prefix")
    once = dealt.groupBy("prefix", "bom_id").agg(F.max("doc").alias("doc"), F.max("known").alias("known")).filter("NOT known")
    with lean_writes(docs.sparkSession):
        once.select("bom_id", "doc", "prefix").write.mode("append").partitionBy("prefix").parquet(path)


def bom_history(boms: DataFrame) -> DataFrame:
    """(blob, bom_id, all_bom_ids, conflict): the latest document of each artifact and all it ever had, from (blob, seq, bom_id)."""
    return boms.groupBy("blob").agg(F.max_by("bom_id", "seq").alias("bom_id"), F.array_sort(F.collect_set("bom_id")).alias("all_bom_ids")).withColumn("conflict", F.size("all_bom_ids") > 1)


def write_subtrees(closed: DataFrame, node_entries: DataFrame, path: str, *, levels: int = 1) -> None:
    """Each root's artifacts down to ``levels`` as part files of their own, deeper ones in one more."""
    rows = closed.join(node_entries, "blob", "left").withColumn("level", F.least("depth", F.lit(levels)))
    rows.repartition("level", "root").sortWithinPartitions("root", "depth", "blob").write.partitionBy("level").json(path)


def coverage_report(covered: DataFrame) -> DataFrame:
    """(root, line): one readable line for each root of a coverage table."""
    return covered.select("root", F.format_string("%s: %d of %d blobs known (%.2f%%)", "root", F.col("n_found"), F.col("n_blobs"), F.col("found_pct")).alias("line"))

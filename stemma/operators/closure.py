"""Reachability over the graph: expansion from roots, leaves, parents, cycles and unary chains.

Frontier loops: each round follows the edges of the nodes found last and drops
what was seen before, so a node enters the frontier once for each root, however
many paths lead to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.functions.ident import packed, unpacked
from stemma.plans.storage import compacted, discard, lean_writes, materialise, union_all


#: Rows of a round that are sent to all tasks, so that what was found before is not dealt again for them.
SMALL = 200_000


def _unseen(step: DataFrame, seen: DataFrame) -> DataFrame:
    """The rows of a round that were not found before, as a table.

    A small round is looked up where the found rows lie; only its own hits are
    then taken from it.
    """
    step = materialise(step, "step")
    if step.limit(SMALL + 1).count() <= SMALL:
        seen = seen.join(F.broadcast(step.select("root", "blob")), ["root", "blob"], "left_semi")
    fresh = materialise(step.join(seen, ["root", "blob"], "left_anti"), "frontier")
    discard(step)
    return fresh


def closure(edge: DataFrame, roots: DataFrame, *, include_roots: bool = True) -> DataFrame:
    """(root, blob, depth): everything under each root of ``roots(root)`` with its least depth."""
    with lean_writes(edge.sparkSession):
        dealt = edge.select(packed(F.col("out_blob")).alias("blob"), packed(F.col("in_blob")).alias("child")).repartition("blob")
        links = materialise(dealt.dropDuplicates(["blob", "child"]), "links")
        start = roots.select(packed(F.col("root")).alias("root")).distinct().select("root", F.col("root").alias("blob"), F.lit(0).alias("depth"))
        frontier = materialise(start, "frontier")
        found = [frontier]
        while not frontier.isEmpty():
            seen = union_all([part.select("root", "blob") for part in found])
            step = frontier.join(links, "blob").select("root", F.col("child").alias("blob"), (F.col("depth") + 1).alias("depth")).distinct()
            frontier = _unseen(step, seen)
            # The frontier stays a table of its own while the next round reads it.
            found = [*compacted(found), frontier]
        discard(links)
    out = union_all(found).select(unpacked(F.col("root")).alias("root"), unpacked(F.col("blob")).alias("blob"), "depth")
    return out if include_roots else out.filter("depth > 0")


def leaves(closed: DataFrame, edge: DataFrame) -> DataFrame:
    """The rows of a closure whose artifact is made of nothing."""
    own = closed.select(packed(F.col("root")).alias("root"), packed(F.col("blob")).alias("blob"), "depth")
    left = own.join(edge.select(packed(F.col("out_blob")).alias("blob")).distinct(), "blob", "left_anti")
    return left.select(unpacked(F.col("root")).alias("root"), unpacked(F.col("blob")).alias("blob"), "depth")


def parents(edge: DataFrame, targets: DataFrame) -> DataFrame:
    """(in_blob, out_blob): what each target is a direct input of."""
    return edge.join(targets.select(F.col("blob").alias("in_blob")).distinct(), "in_blob", "left_semi").select("in_blob", "out_blob").distinct()


def parent_counts(edge: DataFrame, targets: DataFrame) -> DataFrame:
    """(blob, n_parents) for every target, 0 included."""
    counted = parents(edge, targets).groupBy(F.col("in_blob").alias("blob")).agg(F.count(F.lit(1)).alias("n"))
    return targets.select("blob").distinct().join(counted, "blob", "left").select("blob", F.coalesce("n", F.lit(0)).alias("n_parents"))


def cyclic(edge: DataFrame) -> DataFrame:
    """(blob): artifacts on a cycle or above one, what is left when ready artifacts are peeled off level by level."""
    left = materialise(edge.select("out_blob", "in_blob").distinct(), "peel")
    while True:
        outs = left.select(F.col("out_blob").alias("in_blob")).distinct()
        blocked = left.join(outs, "in_blob", "left_semi").select("out_blob").distinct()
        kept = materialise(left.join(blocked, "out_blob", "left_semi"), "peel")
        same = kept.count() == left.count()
        discard(left)
        left = kept
        if same or left.isEmpty():
            return left.select(F.col("out_blob").alias("blob")).distinct()


def command_chains(edge: DataFrame, node: DataFrame) -> DataFrame:
    """(blob, commands): build commands from an artifact down its single-input chain, up to where it fans in or ends."""
    fan = edge.select("out_blob", "in_blob").distinct().groupBy("out_blob").agg(F.count(F.lit(1)).alias("n"), F.min("in_blob").alias("child"))
    single = fan.filter("n = 1").select(F.col("out_blob").alias("blob"), "child")
    cmd = node.select("blob", "build_cmd")
    frontier = materialise(single.select(F.col("blob").alias("start"), "blob", F.lit(0).alias("depth")), "chain")
    parts = [frontier]
    while not frontier.isEmpty():
        step = frontier.join(single, "blob").select("start", F.col("child").alias("blob"), (F.col("depth") + 1).alias("depth"))
        seen = union_all([part.select("start", "blob") for part in parts])
        frontier = materialise(step.join(seen, ["start", "blob"], "left_anti"), "chain")
        parts = [*compacted(parts), frontier]
    walked = union_all(parts)
    with_cmd = walked.join(cmd, "blob").filter("build_cmd IS NOT NULL")
    return with_cmd.groupBy(F.col("start").alias("blob")).agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", "build_cmd"))), lambda x: x["build_cmd"]).alias("commands"))


def truncate(table: DataFrame, closed: DataFrame, column: str = "blob") -> DataFrame:
    """The rows of a table whose artifact is in a closure."""
    return table.join(closed.select(F.col("blob").alias(column)).distinct(), column, "left_semi")


def same_bom_blobs(closed: DataFrame, bom_map: DataFrame) -> DataFrame:
    """(root, blob): a closure's artifacts, and others that share a document with one of them."""
    boms = closed.join(bom_map.select("blob", "bom_id"), "blob").select("root", "bom_id").distinct()
    return closed.select("root", "blob").union(boms.join(bom_map.select("blob", "bom_id"), "bom_id").select("root", "blob")).distinct()


def coverage(closed: DataFrame, known: DataFrame) -> DataFrame:
    """(root, n_blobs, n_found, found_pct, n_known, known_pct): how much of a closure a table knows, and the reverse."""
    total = known.select("blob").distinct()
    marked = closed.select("root", "blob").distinct().join(total.withColumn("known", F.lit(1)), "blob", "left")
    sums = marked.groupBy("root").agg(F.count(F.lit(1)).alias("n_blobs"), F.count("known").alias("n_found"))
    n_known = F.lit(total.count())
    return sums.select(
        "root", "n_blobs", "n_found", (F.col("n_found") * F.lit(100.0) / F.col("n_blobs")).alias("found_pct"), n_known.alias("n_known"), (F.col("n_found") * F.lit(100.0) / F.nullif(n_known, F.lit(0))).alias("known_pct")
    )


def attach_paths(closed: DataFrame, files: DataFrame) -> DataFrame:
    """A closure with the path of a local file of the same content, from files(path, blob): the first by name."""
    return closed.join(files.groupBy("blob").agg(F.min("path").alias("local_path")), "blob", "left")

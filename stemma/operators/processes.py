"""Process trees from trace lines: recycled process numbers, depths and indented logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemma.plans.storage import materialise


def incarnations(spawns: DataFrame) -> DataFrame:
    """(line_no, pid, parent, incarnation) from spawns(line_no, pid, parent).

    A process number that turns up with another parent than before is a new
    process; incarnations of a number count from 1.
    """
    w = Window.partitionBy("pid").orderBy("line_no")
    changed = (~F.lag("parent").over(w).eqNullSafe(F.col("parent"))).cast("int")
    return spawns.withColumn("__new", changed).withColumn("incarnation", F.sum("__new").over(w)).drop("__new")


def named_processes(spawns: DataFrame) -> DataFrame:
    """(proc, parent_proc, line_no) with names ``pid@line`` of where a process first turned up; roots have no parent."""
    told = incarnations(spawns)
    first = told.groupBy("pid", "parent", "incarnation").agg(F.min("line_no").alias("line_no"))
    named = first.withColumn("proc", F.concat_ws("@", F.col("pid").cast("string"), F.col("line_no").cast("string")))
    # The parent is the incarnation of its number that was last seen before the child.
    from stemma.operators.dag import latest_before

    births = named.select(F.col("pid").alias("parent"), "line_no", F.col("proc").alias("__proc"))
    joined = latest_before(named, births, ["parent"], "line_no", "__proc", "parent_proc")
    return joined.select("proc", "parent_proc", "line_no", "pid")


def depths(tree: DataFrame, node: str = "proc", parent: str = "parent_proc") -> DataFrame:
    """``(node, root, depth)`` in a forest, by doubling: each round joins a table of ancestors with itself.

    A node whose way up runs into a circle has neither root nor depth.
    """
    known = materialise(tree.select(F.col(node).alias("n")), "nodes")
    reach, nodes = 1, known.count()
    up = tree.select(F.col(node).alias("n"), F.col(parent).alias("a")).join(known.select(F.col("n").alias("a")), "a", "left_semi")
    up = known.join(up, "n", "left").select("n", F.coalesce("a", "n").alias("a"), F.when(F.col("a").isNull(), 0).otherwise(1).alias("d"))
    while True:
        up = materialise(up, "depth")
        above = up.select(F.col("n").alias("a"), F.col("a").alias("aa"), F.col("d").alias("dd"))
        following = up.join(above, "a").select("n", F.col("aa").alias("a"), (F.col("d") + F.col("dd")).alias("d"), (F.col("dd") > 0).alias("moved"))
        following = materialise(following, "depth")
        reach *= 2
        # Beyond the number of nodes, what still moves goes round.
        if reach > 2 * nodes or following.filter("moved").isEmpty():
            found = lambda c: F.when(~F.col("moved"), F.col(c))
            return following.select(F.col("n").alias(node), found("a").alias("root"), found("d").alias("depth"))
        up = following.drop("moved")


def tree_summary(deep: DataFrame) -> DataFrame:
    """(root, n_processes, max_depth)."""
    return deep.groupBy("root").agg(F.count(F.lit(1)).alias("n_processes"), F.max("depth").alias("max_depth"))


def indented(lines: DataFrame, births: DataFrame, deep: DataFrame, indent: str = "  ") -> DataFrame:
    """(line_no, text): each line moved in by the depth of the process that was its number's at that line."""
    from stemma.operators.dag import latest_before

    own = latest_before(lines.withColumn("line_no", F.col("line_no") + 0.5), births.select("pid", F.col("line_no").cast("double").alias("line_no"), "proc"), ["pid"], "line_no", "proc", "proc")
    joined = own.join(deep.select("proc", "depth"), "proc", "left")
    return joined.select(F.floor("line_no").alias("line_no"), F.concat(F.repeat(F.lit(indent), F.coalesce("depth", F.lit(0))), F.col("raw")).alias("text"))


def command_trees(tree: DataFrame, deep: DataFrame) -> DataFrame:
    """(root, tree): an indented listing of each root's processes in the order of a walk down.

    A process sorts by the births along its way from the root, so no nesting is
    built; processes without a root are left out.
    """
    deep = deep.filter("root IS NOT NULL")
    tree = tree.join(deep.select("proc"), "proc", "left_semi")
    step = tree.select(F.col("proc").alias("n"), F.col("parent_proc").alias("a"), F.lpad(F.col("line_no").cast("string"), 12, "0").alias("key"), "prog")
    way = step.select(F.col("n").alias("proc"), "a", F.col("key").alias("way"), "prog")
    while True:
        way = materialise(way, "way")
        if way.filter("a IS NOT NULL").isEmpty():
            break
        above = step.select(F.col("n").alias("a"), F.col("a").alias("up"), "key")
        way = way.join(above, "a", "left").select("proc", F.col("up").alias("a"), F.concat_ws("/", "key", "way").alias("way"), "prog")
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.col("proc"), F.lit(" "), F.coalesce("prog", F.lit("")))
    rows = way.join(deep, "proc").select("root", F.struct("way", line.alias("line")).alias("w"))
    return rows.groupBy("root").agg(F.array_join(F.transform(F.array_sort(F.collect_list("w")), lambda w: w["line"]), "\n").alias("tree"))

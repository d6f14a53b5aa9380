"""From build records to the node and edge tables of the dependency graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered_distinct(value: str, seq: str) -> Column:
    """Aggregate: the distinct non-null values of a group in the order in which they first stand."""
    pairs = F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(F.col(seq).alias("seq"), F.col(value).alias("value")))))
    return F.array_distinct(F.transform(pairs, lambda p: p["value"]))


def usable_records(records: DataFrame) -> DataFrame:
    """Records that make a graph step: not marked to be ignored, with an output; an output without id goes by its path."""
    named = records.withColumn("out_blob", F.coalesce(F.nullif("out_blob", F.lit("")), F.nullif("out_path", F.lit(""))))
    return named.filter(~F.coalesce(F.col("ignore"), F.lit(False)) & F.col("out_blob").isNotNull())


def resolve_aliases(records: DataFrame) -> DataFrame:
    """Outputs that go by their path get the id under which that path is first used as an input later on."""
    used = records.select(F.col("seq").alias("later"), F.explode("infiles").alias("f")).select("later", F.col("f.path").alias("path"), F.col("f.blob").alias("blob"))
    used = used.filter("blob <> ''")
    nameless = records.filter(F.col("out_blob") == F.col("out_path")).select("seq", "out_path")
    first = nameless.join(used, (F.col("out_path") == F.col("path")) & (F.col("later") > F.col("seq"))).groupBy("seq").agg(F.min_by("blob", "later").alias("real"))
    return records.join(first, "seq", "left").withColumn("out_blob", F.coalesce("real", "out_blob")).drop("real")


def with_pre_exec(records: DataFrame, *, replace_inputs: bool = True) -> DataFrame:
    """Drop ``pre_exec`` records; the next record of the same process and output has the earlier content as its input.

    Each earlier hash is used once, by the nearest later record.  With
    ``replace_inputs`` it stands in place of all inputs, else beside them.
    """
    same = Window.partitionBy("pid", "out_path").orderBy("seq")
    is_pre = F.coalesce(F.col("exec_mode") == "pre_exec", F.lit(False))
    marked = records.withColumn("__pre", is_pre).withColumn("__prev_pre", F.lag("__pre").over(same)).withColumn("__prev_blob", F.lag("out_blob").over(same))
    own = F.array(F.struct(F.lit(0).alias("pos"), F.col("__prev_blob").alias("blob"), F.col("out_path").alias("path")))
    given = F.coalesce("infiles", F.array().cast(dict(records.dtypes)["infiles"]))
    takes = F.col("__prev_pre") & F.col("pid").isNotNull()
    fields = [f.name for f in records.schema["infiles"].dataType.elementType.fields]
    earlier = F.transform(own, lambda x: F.struct(*[x[n].alias(n) if n in ("pos", "blob", "path") else F.lit(None).cast(records.schema["infiles"].dataType.elementType[n].dataType).alias(n) for n in fields]))
    inputs = earlier if replace_inputs else F.concat(earlier, given)
    return marked.filter(~F.col("__pre")).withColumn("infiles", F.when(takes, inputs).otherwise(given)).drop("__pre", "__prev_pre", "__prev_blob")


def is_same_content(records: DataFrame) -> Column:
    """Whether a record's output equals one of its inputs."""
    return F.exists(F.coalesce("infiles", F.array().cast(dict(records.dtypes)["infiles"])), lambda i: i["blob"] == F.col("out_blob"))


def edges(records: DataFrame) -> DataFrame:
    """(out_blob, in_blob, seq, pos) of the records that change content; inputs without id have no edge."""
    steps = usable_records(records).filter(~is_same_content(records))
    inputs = steps.select("out_blob", "seq", F.explode("infiles").alias("f"))
    return inputs.select("out_blob", F.col("f.blob").alias("in_blob"), "seq", F.col("f.pos").alias("pos")).filter("in_blob <> ''")


def merged_edges(edge: DataFrame) -> DataFrame:
    """One edge for each (out_blob, in_blob), at its first place in the log: the union of an output's input lists."""
    return edge.groupBy("out_blob", "in_blob").agg(F.min(F.struct("seq", "pos")).alias("at")).select("out_blob", "in_blob", "at.seq", "at.pos")


def nodes(records: DataFrame) -> DataFrame:
    """One row for each artifact: its first and all names, commands, tools and package infos, in log order."""
    usable = usable_records(records)
    changed = ~is_same_content(records)
    empty = F.array().cast(dict(records.dtypes)["infiles"])
    outs = usable.select(
        F.col("out_blob").alias("blob"), F.col("out_path").alias("file_path"), (F.col("seq") * 2).alias("at"), F.lit(-1).alias("pos"),
        *[F.when(changed, F.col(c)).alias(c) for c in ("build_cmd", "build_tool", "pkg_info", "prune")],
    )
    ins = usable.select((F.col("seq") * 2 + 1).alias("at"), F.explode(F.coalesce("infiles", empty)).alias("f")).filter("f.blob <> ''")
    ins = ins.select(F.col("f.blob").alias("blob"), F.col("f.path").alias("file_path"), "at", F.col("f.pos").alias("pos"), *[F.lit(None).cast("string").alias(c) for c in ("build_cmd", "build_tool", "pkg_info", "prune")])
    rows = outs.unionByName(ins).withColumn("order", F.struct("at", "pos"))
    return rows.groupBy("blob").agg(
        F.min_by("file_path", "order").alias("file_path"), ordered_distinct("file_path", "order").alias("file_paths"),
        F.min_by("build_cmd", F.when(F.col("build_cmd").isNotNull(), F.col("order"))).alias("build_cmd"), ordered_distinct("build_cmd", "order").alias("build_cmds"),
        F.min_by("build_tool", F.when(F.col("build_tool").isNotNull(), F.col("order"))).alias("build_tool"), ordered_distinct("build_tool", "order").alias("build_tools"),
        ordered_distinct("pkg_info", "order").alias("pkg_infos"), F.max("prune").alias("prune"), F.min("at").alias("first_seq"),
    )


def with_packages(node: DataFrame, blob_package: DataFrame) -> DataFrame:
    """Add each artifact's providing package from the index (blob, prov_pkg), one row for each blob."""
    return node.join(blob_package.select("blob", "prov_pkg"), "blob", "left")


def merge_by_id(rows: DataFrame, key: str, name: str, order: str) -> DataFrame:
    """(key, first_name, names, n): the first and all distinct names under one id."""
    return rows.groupBy(key).agg(F.min_by(name, order).alias("first_name"), ordered_distinct(name, order).alias("names"), F.count(F.lit(1)).alias("n"))


def last_of_each(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value): what was written last wins."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def first_of_each(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Whole rows, the first of each key in an order."""
    first = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__nth", F.row_number().over(first)).filter("__nth = 1").drop("__nth")


def overlay(tables: list[DataFrame], key: str) -> DataFrame:
    """Rows of several tables by key; the table named earlier wins."""
    out = None
    for n, table in enumerate(tables):
        part = table.withColumn("__rank", F.lit(n))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return first_of_each(out, [key], ["__rank"]).drop("__rank")


def concatenated_logs(logs: list[DataFrame]) -> DataFrame:
    """Records of several logs one after another: each log's numbers go on where the one before ends."""
    out, start = None, F.lit(0).cast("long")
    for log in logs:
        part = log.withColumn("seq", F.col("seq") + start)
        ends = (part.agg(F.max("seq")).first() or [None])[0]
        start = F.lit((ends or 0) + 1).cast("long")
        out = part if out is None else out.unionByName(part)
    return out


def latest_before(left: DataFrame, right: DataFrame, keys: list[str], order: str, value: str, into: str) -> DataFrame:
    """As-of join: for each left row the value of the right row with its keys and the greatest order below its own.

    One sort by key and order over both tables and a running last value: no
    pair of rows is ever joined, whatever the number of rows under a key.
    """
    kind = dict(right.dtypes)[value]
    both = left.withColumns({"__value": F.lit(None).cast(kind), "__right": F.lit(0)}).unionByName(
        right.select(*keys, order, F.col(value).alias("__value"), F.lit(1).alias("__right")), allowMissingColumns=True
    )
    # Rows of equal order are not before each other: a left row comes first.
    running = Window.partitionBy(*keys).orderBy(order, "__right").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(into, F.last("__value", ignorenulls=True).over(running)).filter("__right = 0").drop("__value", "__right")


def paired_once(events: DataFrame, keys: list[str], order: str, kind: str, before: str, after: str) -> DataFrame:
    """Each ``after`` row with the ``before`` row directly ahead of it under its keys; a ``before`` row is used once.

    Returns keys, the two orders.
    """
    own = events.filter(F.col(kind).isin(before, after))
    w = Window.partitionBy(*keys).orderBy(order)
    return own.withColumn("__kind", F.lag(kind).over(w)).withColumn("before_order", F.lag(order).over(w)).filter(
        (F.col(kind) == after) & (F.col("__kind") == before)
    ).select(*keys, "before_order", F.col(order).alias("after_order"))

"""Connected components of a table of links, by hooking roots and jumping pointers.

Every round rewrites the links between the current roots, hooks each root onto
its smallest linked root and flattens the hooks.  All steps are joins and
aggregations over tables in the shared folder; nothing is gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.plans.storage import discard, materialise


def _flatten(hooks: DataFrame) -> DataFrame:
    """Point every vertex of a forest (v, root), root < v, at its tree's root."""
    while True:
        up = hooks.select(F.col("v").alias("root"), F.col("root").alias("higher"))
        jumped = materialise(hooks.join(up, "root", "left").select("v", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")), "jump")
        moved = not jumped.filter("moved").isEmpty()
        discard(hooks)
        hooks = jumped.select("v", "root")
        if not moved:
            return hooks


def components(links: DataFrame) -> DataFrame:
    """(v, root) for each vertex of ``links(a, b)`` that is not its component's smallest; ``root`` is that smallest one."""
    found = None
    edges = links.filter("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    while True:
        hooks = materialise(edges.groupBy(F.col("hi").alias("v")).agg(F.min("lo").alias("root")), "hooks")
        if hooks.isEmpty():
            return hooks if found is None else found
        hooks = _flatten(hooks)
        if found is None:
            found = hooks
        else:
            above = hooks.select(F.col("v").alias("root"), F.col("root").alias("higher"))
            merged = found.join(above, "root", "left").select("v", F.coalesce("higher", "root").alias("root"))
            found = materialise(merged.unionByName(hooks).groupBy("v").agg(F.min("root").alias("root")), "roots")
        for end in ("lo", "hi"):
            up = found.select(F.col("v").alias(end), F.col("root").alias("to"))
            edges = edges.join(up, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        edges = materialise(edges.filter("lo <> hi").select(F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi")).distinct(), "edges")

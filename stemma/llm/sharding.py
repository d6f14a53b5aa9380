"""Sharding by proportional stratified interleaving [native].

Rows are shuffled by a seeded hash inside each source and ranked; rank ``r`` of
``n`` becomes the fraction ``(r - u) / n`` with ``u`` in (0, 1) drawn once per
source, so all sources are spread evenly over [0, 1).  Sorting by the fraction
interleaves them in proportion, and cutting the sorted row into equal parts
gives shards that each match the mixture, with row counts at most one apart.

No rank is taken over a whole source in one task.  The seeded hash is a uniform
hex string, so its first three digits split any source, however large, into
4096 blocks whose counts are added up first; a row's rank is its block's offset
plus its place in the block.  The total order over fractions uses 4096 equal
slices of [0, 1) the same way.

Defined results: a null source is a source of its own; a null text has no
bytes; rows are shuffled by id and text, so null and repeated ids are told apart
by their texts, and rows equal in both are interchangeable; an empty table gives no rows; further columns
are ignored by ``assign_shards`` and kept by ``write_shards``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemma.plans.storage import materialise

#: Fractions are cut into this many slices, and each source into this many blocks (three hex digits).
SLICES = 4096


def source_key(col: Column) -> Column:
    """A key that is never null: null sources form a group of their own, after all others in code point order."""
    return F.when(col.isNotNull(), F.concat(F.lit("0"), col)).otherwise(F.lit("1"))


def seeded_hash(seed: int, col: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(col.cast("string"), F.lit("null"))).cast("binary"))


def row_hash(seed: int, id_col: Column, text_col: Column) -> Column:
    """The hash that shuffles rows: of their id and text, so that rows without an id, or of one id, do not meet in one place."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(id_col.cast("string"), F.lit("null")), F.md5(F.coalesce(text_col, F.lit("")).cast("binary"))).cast("binary"))


def _unit(seed: int, col: Column) -> Column:
    """A fixed number in (0, 1) for each key."""
    digits = F.substring(seeded_hash(seed, col), 1, 8)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)


def interleave(df: DataFrame, *, id_col: str, source_col: str, text_col: str, seed: int) -> DataFrame:
    """Narrow rows (row_id, src, size, crc, h, frac): each row's fraction of its source's shuffled order."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(
        F.col(id_col).alias("row_id"),
        source_key(F.col(source_col)).alias("src"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        row_hash(seed, F.col(id_col), F.col(text_col)).alias("h"),
    ).withColumn("block", F.substring("h", 1, 3))
    rows = materialise(rows, "interleave")
    counts = rows.groupBy("src", "block").agg(F.count(F.lit(1)).alias("n_block"))
    whole = Window.partitionBy("src")
    before = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        "src",
        "block",
        F.coalesce(F.sum("n_block").over(before), F.lit(0)).alias("offset"),
        F.sum("n_block").over(whole).alias("n_source"),
    )
    place = Window.partitionBy("src", "block").orderBy("h", "crc", "size", "row_id")
    rank = F.col("offset") + F.row_number().over(place)
    return rows.join(counts, ["src", "block"]).select(
        "row_id", "src", "size", "crc", "h", ((rank - _unit(seed, F.col("src"))) / F.col("n_source")).alias("frac")
    )


def assign_shards(
    df: DataFrame,
    shards: int = 8,
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    seed: int = 7,
) -> DataFrame:
    """(row_id, size, crc, shard, slot) for every row of ``df``; shard sizes in rows differ by one at most."""
    rows = materialise(
        interleave(df, id_col=id_col, source_col=source_col, text_col=text_col, seed=seed)
        .withColumn("slice", F.least(F.floor(F.col("frac") * SLICES).cast("int"), F.lit(SLICES - 1))),
        "shards",
    )
    # At most SLICES rows, whatever the input: a window over them and a broadcast are bounded.
    everything = Window.partitionBy(F.lit(0))
    slices = (
        rows.groupBy("slice").agg(F.count(F.lit(1)).alias("n_slice"))
        .select(
            "slice",
            F.coalesce(F.sum("n_slice").over(everything.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"),
            F.sum("n_slice").over(everything).alias("n_all"),
        )
    )
    order = Window.partitionBy("slice").orderBy("frac", "src", "h", "crc", "size", "row_id")
    ranked = rows.join(F.broadcast(slices), "slice").withColumn("place", F.col("ahead") + F.row_number().over(order) - 1)
    shard = F.expr(f"(place * {shards}) div n_all")
    return ranked.withColumn("shard", shard.cast("int")).select(
        "row_id",
        "size",
        "crc",
        "shard",
        F.expr(f"place - ((CAST(shard AS BIGINT) * n_all + {shards - 1}) div {shards})").alias("slot"),
    )


def write_shards(df: DataFrame, path: str, shards: int = 8, *, id_col: str = "doc_id", into: str = "shard", **columns) -> None:
    """Write ``df`` as ``path/<into>=k``; ids must be unique, since rows meet their shard by id.

    ``into`` gets underscores at its end while the table has a column of that name.
    """
    while into in df.columns:
        into += "_"
    placed = assign_shards(df, shards, id_col=id_col, **columns).select(
        F.col("row_id").alias("__sh_id"), F.col("shard").alias(into), F.col("slot").alias("__sh_slot")
    )
    joined = df.join(placed, df[id_col].eqNullSafe(F.col("__sh_id"))).drop("__sh_id")
    dealt = joined.repartition(F.col(into), F.floor(F.col("__sh_slot") / 100_000)).sortWithinPartitions(into, "__sh_slot")
    dealt.drop("__sh_slot").write.partitionBy(into).parquet(path)

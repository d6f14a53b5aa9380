"""Cross-site line dedup by distinct-site spread [native].

Every non-blank line is hashed (96 bits) and one HyperLogLog sketch of the
sites that carry it is built per hash by map-side partial aggregation, so a
line that stands in a third of all documents costs one sketch per task.  Lines
whose estimate is clear of the threshold are decided by it; lines within four
standard errors are counted again exactly.  A line on ``min_sites`` sites or
more is boilerplate: it stays in the document with the smallest id that has it
and goes from all others, so a text that many sites copied keeps one whole
copy.

Only hashes and positions are shuffled by line; texts are shuffled once, by
row, to take their removals.

Defined results: lines are split at newlines and compared without ASCII spaces,
tabs and carriage returns around them; blank lines never go; a null text stays
null with 0 lines; a null site is one site of its own; rows with a null id are
never a line's first; rows with equal id and text are cleaned alike; every
row and further column is kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.llm.sharding import source_key
from stemma.plans.storage import materialise

#: Sites that make a line boilerplate, and the sketches' size (a standard error of 1.04 / sqrt(2 ** LG_K)).
MIN_SITES, LG_K, ERRORS = 10, 10, 4


def _row_keys(df: DataFrame, id_col: str, text_col: str) -> list[Column]:
    return [
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("__ld_k1"),
        F.hash(F.col(text_col), F.col(id_col)).alias("__ld_k2"),
    ]


def _lines(df: DataFrame, id_col: str, site_col: str, text_col: str) -> DataFrame:
    """(first_id, site, row keys, pos, h1, h2) for each non-blank line."""
    split = df.filter(F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("row_id"),
        source_key(F.col(site_col)).alias("site"),
        *_row_keys(df, id_col, text_col),
        F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("pos", "line"),
    )
    trimmed = split.withColumn("line", F.btrim("line", F.lit(" \t\r"))).filter(F.col("line") != "")
    return trimmed.select("row_id", "site", "__ld_k1", "__ld_k2", "pos", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"))


def boilerplate(
    df: DataFrame, *, id_col: str = "doc_id", site_col: str = "source", text_col: str = "text", min_sites: int = MIN_SITES, lg_k: int = LG_K
) -> DataFrame:
    """(h1, h2, first_id) of the lines on ``min_sites`` sites or more."""
    error = ERRORS * 1.04 / math.sqrt(2**lg_k)
    low, high = math.floor(min_sites * (1 - error)), math.ceil(min_sites * (1 + error))
    lines = _lines(df, id_col, site_col, text_col)
    spread = lines.groupBy("h1", "h2").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("sites"), F.min("row_id").alias("first_id")
    )
    wide = materialise(spread.filter(F.col("sites") >= low), "spread")
    near = wide.filter(F.col("sites") <= high).select("h1", "h2")
    exact = (
        lines.select("h1", "h2", "site").join(near, ["h1", "h2"], "left_semi")
        .distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("exact"))
        .filter(F.col("exact") >= min_sites)
    )
    sure = wide.filter(F.col("sites") > high).select("h1", "h2", "first_id")
    close = wide.filter(F.col("sites") <= high).join(exact, ["h1", "h2"], "left_semi").select("h1", "h2", "first_id")
    return materialise(sure.unionByName(close), "boilerplate")


def dedup_lines(
    df: DataFrame, *, id_col: str = "doc_id", site_col: str = "source", text_col: str = "text", min_sites: int = MIN_SITES, lg_k: int = LG_K
) -> DataFrame:
    """``df`` with ``text_col`` cleaned, and the columns ``n_lines`` and ``removed_lines`` (both int), in place of any of these names."""
    df = df.drop("n_lines", "removed_lines")
    found = boilerplate(df, id_col=id_col, site_col=site_col, text_col=text_col, min_sites=min_sites, lg_k=lg_k)
    gone = (
        _lines(df, id_col, site_col, text_col)
        .join(found, ["h1", "h2"])
        .filter(~F.col("row_id").eqNullSafe(F.col("first_id")))
        .groupBy("__ld_k1", "__ld_k2")
        .agg(F.collect_set("pos").alias("__ld_gone"))
    )
    keyed = df.withColumns({"__ld_k1": _row_keys(df, id_col, text_col)[0], "__ld_k2": _row_keys(df, id_col, text_col)[1]})
    joined = keyed.join(gone, ["__ld_k1", "__ld_k2"], "left")
    # A flag for each line, in order: kept positions and removed ones, sorted together.
    lines = F.split(F.col(text_col), "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__ld_gone"))
    flags = F.array_sort(
        F.concat(
            F.transform(kept, lambda p: F.struct(p.alias("p"), F.lit(False).alias("gone"))),
            F.transform(F.col("__ld_gone"), lambda p: F.struct(p.alias("p"), F.lit(True).alias("gone"))),
        )
    )
    clean = F.array_join(F.zip_with(lines, flags, lambda line, flag: F.when(~flag["gone"], line)), "\n")
    hit = F.col("__ld_gone").isNotNull()
    others = [F.when(hit, clean).otherwise(F.col(text_col)).alias(text_col) if c == text_col else F.col(c) for c in df.columns]
    return joined.select(
        *others,
        F.coalesce(F.when(F.col(text_col).isNotNull(), F.size(lines)), F.lit(0)).alias("n_lines"),
        F.coalesce(F.when(hit, F.size("__ld_gone")), F.lit(0)).alias("removed_lines"),
    )

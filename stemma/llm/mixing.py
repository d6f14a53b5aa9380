"""Mixing sources to target weights by entropy balancing [native].

Of all document rates that meet the token target of each source, and keep the
mix's token-weighted mean log length at the corpus's, entropy balancing takes
those of least token-weighted divergence from the corpus as it is.  Its dual is
convex and its solution is exponentially tilted: ``rate = exp(lambda + mu * z)``
with a multiplier ``lambda`` for each source and one, ``mu``, that all sources
share, for the length ``z``.  So a source's long documents are taken more often
than its short ones where the sources' weights alone would shorten the mix.

Newton's method solves the dual.  Each step is one distributed aggregation: the
gradient and the Hessian are sums over documents, by source and in all.  The
Hessian is a diagonal with one border, so a step needs one number from all
sources together, and each source then moves by itself.  The iteration ends
when the gradient vanishes.  Documents whose rate is above ``most`` are then
held there and the rest is balanced again, until there is none.  Source targets
hold exactly; the length is held softly, by a ridge on ``mu``, since the sources
may leave no way to hold it.

The rates become copies: a document is taken ``floor(rate + u)`` times, ``u``
seeded in [0, 1).  What is then missing or too much of a source's target is
made up in a seeded shuffle of its documents, the last one in part, so that the
sum is exact.  Running sums are kept by 4096 hash blocks, so no source is sorted
in one task; sources themselves are numbered by ranges.

Defined results: a null source is a source of its own, last; a null or blank
text has size 0 and is taken 0 words; sources without words get target 0;
repeated rows count as rows; null and repeated ids are told apart by their
texts, and rows equal in both are interchangeable; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemma.llm.sharding import row_hash, source_key
from stemma.plans.storage import broadcast_if_small, materialise, numbered

#: ASCII white space separates words.
WORD = r"[^\x20\x09-\x0D]+"
#: Sources in code point order weigh these, again and again.
WEIGHTS = (5, 2, 1)
#: Words of the mix for each word of the corpus, and most times that a source or a document is taken.
SHARE, MOST = 1.5, 2
#: How softly the mean log length is held; the gradient, in shares of the targets, at which the iteration ends; its longest steps.
RIDGE, CLOSE, LONGEST = 0.02, 1e-10, (1.0, 0.5)
#: Sources that may be broadcast.
SMALL = 200_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(src, source_size, target) from (src, source_size).

    Targets are ``least(most * size, level * weight)`` for the one level at
    which they add up to ``share`` of all sizes.  Sources that the level fills
    are set aside and the level rises, until it fills no more.
    """
    listed = F.array(*[F.lit(float(w)) for w in weights])
    weighed = numbered(sizes, ["src"]).select(
        "src", "source_size", F.element_at(listed, (F.col("nth") % len(weights) + 1).cast("int")).alias("weight"), (F.col("source_size") * most).cast("double").alias("cap")
    )
    weighed = materialise(weighed, "weights")
    everything = weighed.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    if everything["size"] is None:
        return weighed.select("src", "source_size", F.col("cap").alias("target"))
    budget, level, filled = everything["size"] * float(share), 0.0, -1
    full, open_weight = 0.0, everything["weight"]
    while open_weight:
        level = (budget - full) / open_weight
        is_full = F.col("cap") / F.col("weight") <= F.lit(level)
        now = weighed.agg(F.count(F.when(is_full, 1)).alias("n"), F.sum(F.when(is_full, F.col("cap"))).alias("full"), F.sum(F.when(~is_full, F.col("weight"))).alias("open")).first()
        if now["n"] == filled:
            break
        filled, full, open_weight = now["n"], now["full"] or 0.0, now["open"]
    fair = F.col("cap") if not open_weight else F.least("cap", F.lit(level) * F.col("weight"))
    return weighed.select("src", "source_size", fair.alias("target"))


def _length(size: Column, mean: float) -> Column:
    return F.log(size.cast("double") + F.lit(1.0)) - F.lit(mean)


def _held(z: Column, most: int) -> Column:
    """Whether a document's rate was above ``most`` when the iteration came to rest before."""
    return F.exists("held", lambda h: h["lambda"] + h["mu"] * z > F.lit(math.log(most)))


def tilts(plan: DataFrame, cells: DataFrame, most: int = MOST, ridge: float = RIDGE) -> tuple[DataFrame, float, float]:
    """((src, source_size, target, lambda, held), mu, mean): the balancing tilts, from the plan and cells (src, size, words).

    A cell is the documents of one source and size, which have one rate.
    """
    words = cells.agg(F.sum("words").alias("n"), F.sum(F.col("words") * F.log(F.col("size") + F.lit(1.0))).alias("z")).first()
    mean = words["z"] / words["n"] if words["n"] else 0.0
    pull = (plan.agg(F.sum("target")).first()[0] or 0.0) * ridge
    start = F.when((F.col("source_size") > 0) & (F.col("target") > 0), F.log(F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    # Sources taken whole as often as can be have nothing to balance.
    whole = F.col("target") >= F.col("source_size") * most
    at = lambda lam, mu: F.struct(lam.alias("lambda"), F.lit(mu).alias("mu"))
    none = F.array().cast("array<struct<lambda:double,mu:double>>")
    tilt = plan.select("src", "source_size", "target", start.alias("lambda"), F.when(whole, F.array(at(F.lit(1e9), 0.0))).otherwise(none).alias("held"))
    mu, sources = 0.0, ["src", "source_size", "target", "lambda", "held"]
    cells = cells.filter("size > 0")
    while True:
        tilt = materialise(tilt, "tilts")
        z = _length(F.col("size"), mean)
        own = cells.join(broadcast_if_small(tilt, SMALL), "src").select(*sources, "words", z.alias("z"), _held(z, most).alias("is_held"))
        own = own.withColumn("mass", F.col("words") * F.when(F.col("is_held"), F.lit(float(most))).otherwise(F.exp(F.col("lambda") + F.lit(mu) * F.col("z"))))
        free = lambda c: F.sum(F.when(~F.col("is_held"), c).otherwise(F.lit(0.0)))  # noqa: E731,B023
        over = ~F.col("is_held") & (F.col("lambda") + F.lit(mu) * F.col("z") > F.lit(math.log(most)))
        # The gradient and the Hessian, by source.
        sums = own.groupBy(*sources[:4]).agg(
            F.first("held").alias("held"), (F.sum("mass") - F.col("target")).alias("g"), free(F.col("mass")).alias("d"), free(F.col("mass") * F.col("z")).alias("b"),
            F.sum(F.col("mass") * F.col("z")).alias("gz"), free(F.col("mass") * F.col("z") * F.col("z")).alias("c"), F.max(over).alias("over"),
        )
        sums = materialise(sums, "newton")
        d = F.nullif(F.col("d"), F.lit(0.0))
        step = sums.agg(
            F.sum("gz").alias("gz"), F.sum("c").alias("c"), F.sum(F.col("b") * F.col("b") / d).alias("bb"), F.sum(F.col("b") * F.col("g") / d).alias("bg"),
            F.max(F.when(d.isNotNull(), F.abs("g") / F.greatest("target", F.lit(1.0)))).alias("off"), F.max("over").alias("over"),
        ).first()
        if step["gz"] is None or step["off"] is None:
            return tilt, mu, mean
        gradient = step["gz"] + pull * mu
        rest = plan.join(sums.select("src"), "src", "left_anti").select("src", "source_size", "target", F.lit(0.0).alias("lambda"), none.alias("held"))
        if step["off"] <= CLOSE and abs(gradient) <= CLOSE * max(pull / ridge, 1.0):
            if not step["over"]:
                return tilt, mu, mean
            # At rest: what is above ``most`` is held there from now on.
            tilt = sums.select(*sources[:4], F.concat("held", F.array(at(F.col("lambda"), mu))).alias("held")).unionByName(rest)
            continue
        by = (gradient - (step["bg"] or 0.0)) / (step["c"] - (step["bb"] or 0.0) + pull)
        by = min(max(by, -LONGEST[1]), LONGEST[1])
        move = F.coalesce((F.col("g") - F.col("b") * F.lit(by)) / d, F.lit(0.0))
        move = F.greatest(F.lit(-LONGEST[0]), F.least(F.lit(LONGEST[0]), move))
        mu -= by
        tilt = sums.select(*sources[:3], (F.col("lambda") - move).alias("lambda"), "held").unionByName(rest)


def mix(
    df: DataFrame,
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    seed: int = 11,
    weights=WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
) -> DataFrame:
    """(row_id, h, size, source_size, target, rate, taken) for every row; ``taken`` counts words, repeats included."""
    rows = materialise(
        df.select(
            F.col(id_col).alias("row_id"),
            source_key(F.col(source_col)).alias("src"),
            word_count(F.col(text_col)).alias("size"),
            row_hash(seed, F.col(id_col), F.col(text_col)).alias("h"),
        ).withColumn("block", F.substring("h", 1, 3)),
        "mix",
    )
    cells = materialise(rows.groupBy("src", "size").agg(F.sum("size").alias("words")), "cells")
    plan = materialise(targets(cells.groupBy("src").agg(F.sum("words").alias("source_size")), weights, share, most), "plan")
    tilt, mu, mean = tilts(plan, cells, most)

    # A source's tilt goes to each of its blocks, so that no join meets a whole source in one place.
    blocks = rows.select("src", "block").distinct().join(tilt, "src")
    z = _length(F.col("size"), mean)
    rate = F.when((F.col("size") > 0) & (F.col("target") > 0), F.when(_held(z, most), F.lit(float(most))).otherwise(F.exp(F.col("lambda") + F.lit(mu) * z))).otherwise(F.lit(0.0))
    unit = F.conv(F.substring("h", 9, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    rated = rows.join(blocks, ["src", "block"]).select(*rows.columns, "source_size", "target", rate.alias("rate"), unit.alias("u"))
    copies = F.least(F.lit(most), F.floor(F.col("rate") + F.col("u"))).cast("long")
    rounded = materialise(rated.select(*rows.columns, "source_size", "target", "rate", copies.alias("copies")), "rounded")

    # What rounding left over, by source, and which documents can make it up.
    sums = rounded.groupBy("src", "block", "target").agg(
        F.sum(F.col("copies") * F.col("size")).alias("taken"), F.sum(F.when(F.col("copies") < most, F.col("size")).otherwise(0)).alias("can_add"), F.sum(F.when(F.col("copies") > 0, F.col("size")).otherwise(0)).alias("can_drop")
    )
    own = Window.partitionBy("src")
    before = own.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    missing = F.floor(F.col("target") + F.lit(0.25)).cast("long") - F.sum("taken").over(own)
    ahead_of = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    sums = sums.select("src", "block", missing.alias("missing"), F.when(missing > 0, ahead_of("can_add")).otherwise(ahead_of("can_drop")).alias("offset"))
    able = F.when(F.when(F.col("missing") > 0, F.col("copies") < most).otherwise(F.col("copies") > 0), F.col("size")).otherwise(F.lit(0))
    ahead = Window.partitionBy("src", "block").orderBy("h", "size", "row_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = rounded.join(sums, ["src", "block"]).withColumn("able", able)
    passed = F.col("offset") + F.coalesce(F.sum("able").over(ahead), F.lit(0))
    change = F.signum(F.col("missing").cast("double")).cast("long") * F.greatest(F.lit(0), F.least(F.col("able"), F.abs("missing") - passed))
    taken = F.col("copies") * F.col("size") + change
    return placed.select("row_id", "h", "size", "source_size", "target", "rate", taken.cast("long").alias("taken"))


def take_copies(df: DataFrame, *, id_col: str = "doc_id", seed: int = 11, **options) -> DataFrame:
    """The mixed corpus with the columns of ``df``: each row as often as it is taken, to the nearest whole copy.

    Rows are matched with their counts by id, size and text hash.  Rows equal
    in all of them share the sum of what they are taken, dealt out by place.
    """
    text_col = options.get("text_col", "text")
    names = {n: f"__mix_{n}" for n in ("hash", "copies", "rows", "nth")}
    while set(names.values()) & set(df.columns):
        names = {n: v + "_" for n, v in names.items()}
    one = F.greatest(F.col("size"), F.lit(1))
    counts = mix(df, id_col=id_col, seed=seed, **options).groupBy(F.col("h").alias(names["hash"])).agg(
        F.round(F.sum(F.col("taken") / one)).cast("long").alias(names["copies"]), F.count(F.lit(1)).alias(names["rows"])
    )
    hashed = df.withColumn(names["hash"], row_hash(seed, df[id_col], df[text_col]))
    joined = hashed.join(counts.filter(F.col(names["copies"]) > 0), names["hash"])
    each, rows = F.col(names["copies"]), F.col(names["rows"])
    alone = joined.filter(rows == 1).withColumn(names["copies"], each)
    place = Window.partitionBy(names["hash"]).orderBy(names["hash"])
    several = joined.filter(rows > 1).withColumn(names["nth"], F.row_number().over(place) - 1)
    several = several.withColumn(names["copies"], F.floor(each / rows) + F.when(F.col(names["nth"]) < each % rows, 1).otherwise(0)).drop(names["nth"])
    both = alone.unionByName(several).filter(F.col(names["copies"]) > 0)
    return both.withColumn(names["nth"], F.explode(F.sequence(F.lit(1).cast("long"), F.col(names["copies"])))).select(*df.columns)

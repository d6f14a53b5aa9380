"""The vulnerability table: from history, ranges and text rules to statuses, and from statuses to answers.

``cve_status(blob, file_path, cve, status)`` is long: one row for each fact,
with status ``no``, ``cve``, ``fixed``, ``hint_cve`` or ``hint_fixed``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemma.functions import ident, text
from stemma.functions.ident import packed, unpacked
from stemma.plans.storage import compacted, materialise, union_all

#: Statuses and the names of their lists in exported files.
STATUS_LISTS = {"no": "NoCVElist", "cve": "CVElist", "fixed": "FixedCVElist", "hint_cve": "cvehint_CVElist", "hint_fixed": "cvehint_FixedCVElist"}


def rollup(closed: DataFrame, status: DataFrame) -> DataFrame:
    """(root, status, cves, n_cves): the distinct vulnerabilities of each status anywhere under each root."""
    facts = closed.select("root", "blob").distinct().join(status.select("blob", "cve", "status").distinct(), "blob").select("root", "status", "cve").distinct()
    return facts.groupBy("root", "status").agg(F.array_sort(F.collect_list("cve")).alias("cves"), F.count(F.lit(1)).alias("n_cves"))


def net_status(rolled: DataFrame) -> DataFrame:
    """(root, cve, net): vulnerable where it is present and nowhere fixed."""
    flat = rolled.select("root", "status", F.explode("cves").alias("cve"))
    return flat.groupBy("root", "cve").agg(F.max((F.col("status") == "cve").cast("int")).alias("c"), F.max((F.col("status") == "fixed").cast("int")).alias("f")).select(
        "root", "cve", F.when(F.col("f") == 1, F.lit("fixed")).when(F.col("c") == 1, F.lit("vulnerable")).otherwise(F.lit("unknown")).alias("net")
    )


def vulnerable_blobs(status: DataFrame, cves: DataFrame | None = None) -> DataFrame:
    """(cve, blobs, n_blobs): the artifacts that have each vulnerability."""
    own = status.filter("status = 'cve'").select("cve", "blob").distinct()
    if cves is not None:
        own = own.join(cves.select("cve"), "cve", "left_semi")
    return own.groupBy("cve").agg(F.array_sort(F.collect_list("blob")).alias("blobs"), F.count(F.lit(1)).alias("n_blobs"))


def wide(status: DataFrame) -> DataFrame:
    """One row for each artifact with a sorted list for each status."""
    lists = [F.array_sort(F.collect_set(F.when(F.col("status") == s, F.col("cve")))).alias(name) for s, name in STATUS_LISTS.items()]
    return status.groupBy("blob").agg(F.min("file_path").alias("file_path"), *lists)


def long(table: DataFrame) -> DataFrame:
    """The facts of a wide table."""
    entries = F.array(*[F.struct(F.lit(s).alias("status"), F.coalesce(F.col(name), F.array().cast("array<string>")).alias("cves")) for s, name in STATUS_LISTS.items() if name in table.columns])
    return table.select("blob", "file_path", F.explode(entries).alias("e")).select("blob", "file_path", F.explode("e.cves").alias("cve"), F.col("e.status").alias("status"))


def has_any(table: DataFrame):
    """Whether a wide row names any vulnerability."""
    return F.exists(F.array(*[F.size(F.coalesce(F.col(n), F.array().cast("array<string>"))) > 0 for n in STATUS_LISTS.values() if n in table.columns]), lambda x: x)


def attach_metadata(rows: DataFrame, first: DataFrame, second: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with each column from ``first``, or from ``second`` where that has none, by blob."""
    one = first.select("blob", *[F.col(c).alias(f"__1_{c}") for c in columns])
    two = second.select("blob", *[F.col(c).alias(f"__2_{c}") for c in columns])
    joined = rows.join(one, "blob", "left").join(two, "blob", "left")
    return joined.select(*rows.columns, *[F.coalesce(f"__1_{c}", f"__2_{c}").alias(c) for c in columns])


def commits_of_cves(commits: DataFrame) -> DataFrame:
    """(cve, commits) from (commit, message): all vulnerability numbers a message names, inverted."""
    named = commits.select("commit", F.explode(text.cve_ids(F.col("message"))).alias("cve"))
    return named.groupBy("cve").agg(F.array_sort(F.collect_set("commit")).alias("commits"))


def newest_of_each(changes: DataFrame, keys: list[str]) -> DataFrame:
    """The newest change of each key: the smallest ordinal, since history is listed newest first."""
    w = Window.partitionBy(*keys).orderBy("ord")
    return changes.withColumn("__nth", F.row_number().over(w)).filter("__nth = 1").drop("__nth")


def split_history(history: DataFrame, fixes: DataFrame) -> DataFrame:
    """(path, blob, cve, status) from history(path, ord, blob), newest first, and fixes(cve, path, pre_blob, post_blob).

    Up to the content before the fix everything older is vulnerable; from the
    content after it everything newer is fixed; what lies between is neither.
    A content that history does not have stands for itself.
    """
    at = lambda name: history.select("path", F.col("blob").alias(name), F.col("ord").alias(f"{name}_ord")).groupBy("path", name).agg(F.min(f"{name}_ord").alias(f"{name}_ord"))
    placed = fixes.join(at("pre_blob"), ["path", "pre_blob"], "left").join(at("post_blob"), ["path", "post_blob"], "left")
    told = placed.join(history, "path").select(
        "path", "blob", "cve",
        F.when(F.col("ord") >= F.col("pre_blob_ord"), "cve").when(F.col("ord") <= F.col("post_blob_ord"), "fixed").alias("status"),
    ).filter("status IS NOT NULL")
    alone = placed.filter("pre_blob_ord IS NULL AND pre_blob IS NOT NULL").select("path", F.col("pre_blob").alias("blob"), "cve", F.lit("cve").alias("status"))
    new = placed.filter("post_blob_ord IS NULL AND post_blob IS NOT NULL").select("path", F.col("post_blob").alias("blob"), "cve", F.lit("fixed").alias("status"))
    return told.unionByName(alone).unionByName(new).filter(~ident.is_zero(F.col("blob"))).distinct()


def in_ranges(history: DataFrame, ranges: DataFrame) -> DataFrame:
    """(cve, path, blob, status) from ranges(cve, lo_blob, hi_blob) over history(path, ord, blob), oldest first.

    All content from ``lo`` up to, but without, ``hi`` is vulnerable; a zero
    ``lo`` is the file's start and a zero ``hi`` never comes.  All other
    content of the file is not in range.  Ranges of one file add up.
    """
    lo = history.select("path", F.col("blob").alias("lo_blob"), F.col("ord").alias("lo_ord"))
    hi = history.select(F.col("path").alias("hi_path"), F.col("blob").alias("hi_blob"), F.col("ord").alias("hi_ord"))
    placed = ranges.join(lo, "lo_blob", "left").join(hi, "hi_blob", "left")
    sure = placed.filter(F.col("path").isNull() | F.col("hi_path").isNull() | (F.col("path") == F.col("hi_path")))
    bounds = sure.select(
        "cve", F.coalesce("path", "hi_path").alias("path"),
        F.coalesce("lo_ord", F.when(ident.is_zero(F.col("lo_blob")), F.lit(-1))).alias("lo"),
        F.coalesce("hi_ord", F.when(ident.is_zero(F.col("hi_blob")), F.lit(2**62))).alias("hi"),
    ).filter("path IS NOT NULL AND lo IS NOT NULL AND hi IS NOT NULL")
    marked = history.join(bounds, "path").select("cve", "path", "blob", ((F.col("ord") >= F.col("lo")) & (F.col("ord") < F.col("hi"))).alias("inside"))
    return marked.groupBy("cve", "path", "blob").agg(F.max("inside").alias("inside")).select(
        "cve", "path", "blob", F.when(F.col("inside"), "cve").otherwise("not_in_range").alias("status")
    )


def change_interval(changes: DataFrame, lo: int, hi: int, *, with_newest: bool = False) -> DataFrame:
    """(path, blob) that changes numbered in (lo, hi] replaced, and with ``with_newest`` each file's newest content as well."""
    own = changes.filter((F.col("ord") > lo) & (F.col("ord") <= hi))
    replaced = own.select("path", F.col("src_blob").alias("blob"))
    if with_newest:
        w = Window.partitionBy("path").orderBy(F.desc("ord"))
        newest = own.withColumn("__nth", F.row_number().over(w)).filter("__nth = 1").select("path", F.col("dst_blob").alias("blob"))
        replaced = replaced.union(newest)
    return replaced.filter(~ident.is_zero(F.col("blob"))).distinct()


def ancestry(commit_parent: DataFrame, starts: DataFrame) -> DataFrame:
    """(descendant, ancestor): every commit of ``starts(commit)`` with all commits it comes from, itself included."""
    links = commit_parent.select(F.col("commit").alias("ancestor"), "parent").distinct()
    frontier = materialise(starts.select(F.col("commit").alias("descendant"), F.col("commit").alias("ancestor")).distinct(), "ancestry")
    parts = [frontier]
    while not frontier.isEmpty():
        seen = union_all(parts)
        step = frontier.join(links, "ancestor").select("descendant", F.col("parent").alias("ancestor")).filter("ancestor IS NOT NULL").distinct()
        frontier = materialise(step.join(seen, ["descendant", "ancestor"], "left_anti"), "ancestry")
        parts = [*compacted(parts), frontier]
    return union_all(parts)


def fixing_pairs(cve_commit: DataFrame, ancestors: DataFrame) -> DataFrame:
    """(cve, added, fixed): every adding commit with the fixing commits of its vulnerability that come after it."""
    added = cve_commit.filter("kind = 'Added'").select("cve", F.col("commit").alias("ancestor"))
    fixed = cve_commit.filter("kind = 'Fixed'").select("cve", F.col("commit").alias("descendant"))
    return fixed.join(ancestors, "descendant").join(added, ["cve", "ancestor"]).select("cve", F.col("ancestor").alias("added"), F.col("descendant").alias("fixed"))


def branches_with(branch_head: DataFrame, ancestors: DataFrame, commits: DataFrame) -> DataFrame:
    """(commit, branches) whose heads come from each commit; alias lines of other branches are no branches."""
    heads = branch_head.filter(~F.contains(F.col("branch"), F.lit(" -> "))).select("branch", F.col("commit").alias("descendant"))
    reached = heads.join(ancestors, "descendant").select("branch", F.col("ancestor").alias("commit"))
    return reached.join(commits.select("commit"), "commit", "left_semi").groupBy("commit").agg(F.array_sort(F.collect_set("branch")).alias("branches"))


def statuses_of_blobs(cve_blobs: DataFrame) -> DataFrame:
    """(blob, file_path, cves) from (cve, blob, file_path, ord): inverted, with the name that stands first."""
    return cve_blobs.groupBy("blob").agg(F.min_by("file_path", "ord").alias("file_path"), F.array_sort(F.collect_set("cve")).alias("cves"))


def suffix_matches(paths: DataFrame, suffixes: DataFrame) -> DataFrame:
    """(path, src_file): the first of suffixes(src_file, rule_ord) that each path ends with, by rule order.

    Every ending of a path whose length some rule has is looked up by equality,
    so the join deals by hash instead of trying each rule on each path.
    """
    # Distinct lengths of rules: as many as a path is long at most.
    lengths = sorted(r[0] for r in suffixes.select(F.length("src_file")).distinct().collect() if r[0])
    if not lengths:
        return paths.select("path", F.lit(None).cast("string").alias("src_file")).limit(0)
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path"))
    tails = paths.select("path").distinct().select("path", F.explode(F.transform(fitting, lambda n: F.right(F.col("path"), n))).alias("src_file"))
    return tails.join(suffixes.select("src_file", "rule_ord"), "src_file").groupBy("path").agg(F.min_by("src_file", "rule_ord").alias("src_file"))


def rule_results(content: DataFrame, rules: DataFrame) -> DataFrame:
    """(blob, cve, verdict) from content(blob, src_file, content) and rules(cve, src_file, rule_type, include, exclude)."""
    held = content.join(rules, "src_file").filter(text.rule_holds(F.col("content"), F.col("include"), F.col("exclude")))
    kinds = held.groupBy("blob", "cve").agg(F.max((F.col("rule_type") == "cveadd").cast("int")).alias("a"), F.max((F.col("rule_type") == "cvefix").cast("int")).alias("f"))
    return kinds.select("blob", "cve", text.rule_verdict(F.col("a") == 1, F.col("f") == 1).alias("verdict"))


def missing_sources(node: DataFrame, status: DataFrame) -> DataFrame:
    """(blob, file_path): source files of the graph that the vulnerability table does not know."""
    return node.filter(text.is_source_file(F.col("file_path"))).select("blob", "file_path").join(status.select("blob").distinct(), "blob", "left_anti")


def overlay(tables: list[DataFrame]) -> DataFrame:
    """Facts of several tables; for an artifact that a later table knows, only that one's count."""
    out = None
    for n, table in enumerate(tables):
        part = table.select("blob", "file_path", "cve", "status", F.lit(n).alias("rank"))
        out = part if out is None else out.unionByName(part)
    best = out.groupBy("blob").agg(F.max("rank").alias("rank"))
    return out.join(best, ["blob", "rank"]).drop("rank").distinct()


def mismatches(left: DataFrame, right: DataFrame, key: str = "blob", value: str = "cve") -> DataFrame:
    """(key, left_only, right_only): where two tables' sets of values differ."""
    one, two = (t.select(key, value).distinct() for t in (left, right))
    both = one.withColumn("l", F.lit(1)).join(two.withColumn("r", F.lit(1)), [key, value], "full")
    odd = both.filter("l IS NULL OR r IS NULL")
    return odd.groupBy(key).agg(F.array_sort(F.collect_set(F.when(F.col("r").isNull(), F.col(value)))).alias("left_only"), F.array_sort(F.collect_set(F.when(F.col("l").isNull(), F.col(value)))).alias("right_only"))


def attach_verdicts(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Status rows (blob, cve, status) completed by rule verdicts where there is none yet; what is there wins."""
    told = verdicts.select("blob", "cve", F.when(F.col("verdict") == "has", "cve").otherwise("fixed").alias("status"))
    return rows.select("blob", "cve", "status").unionByName(told.join(rows.select("blob", "cve"), ["blob", "cve"], "left_anti"))


def hint_rows(infiles: DataFrame) -> DataFrame:
    """Statuses that a build log hints at, from inputs (blob, path, has_cve, fixed_cve)."""
    of = lambda c, s: F.coalesce(F.transform(c, lambda x: F.struct(x.alias("cve"), F.lit(s).alias("status"))), F.array().cast("array<struct<cve:string,status:string>>"))
    rows = infiles.select(packed(F.col("blob")).alias("blob"), F.col("path").alias("file_path"), F.explode(F.concat(of("has_cve", "hint_cve"), of("fixed_cve", "hint_fixed"))).alias("h"))
    return rows.select("blob", "file_path", "h.cve", "h.status").distinct().withColumn("blob", unpacked(F.col("blob")))



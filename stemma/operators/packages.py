"""Package indexes and bills of materials."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemma.functions import text
from stemma.plans.storage import numbered

#: Fixed value: the package of artifacts that none is known for.
UNKNOWN = "UNKNOWN_COMPONENT_VERSION"


def index_by_blob(pkg_blob: DataFrame) -> DataFrame:
    """(blob, packages, n_packages): distinct packages that hold each content."""
    return pkg_blob.select("blob", "pkg_key").distinct().groupBy("blob").agg(F.array_sort(F.collect_list("pkg_key")).alias("packages"), F.count(F.lit(1)).alias("n_packages"))


def index_by_package(pkg_blob: DataFrame) -> DataFrame:
    """(pkg_key, n_blobs, n_paths, size): the contents of each package."""
    return pkg_blob.groupBy("pkg_key").agg(F.count_distinct("blob").alias("n_blobs"), F.count_distinct("path").alias("n_paths"), F.sum("size").alias("size"))


def index_totals(pkg_blob: DataFrame) -> DataFrame:
    """(pkg_key, n_blobs, size) for each package and, with a null key, for all: contents are counted once for each."""
    return pkg_blob.select("pkg_key", "blob", "size").rollup("pkg_key").agg(F.count("blob").alias("n_blobs"), F.sum("size").alias("size"))


def owner_of_blob(pkg_blob: DataFrame, pkg: DataFrame) -> DataFrame:
    """(blob, pkg_key, path): the last package in order owns a content, but a source package is not displaced by a binary one.

    The fold reduces to a comparison: a source package beats all binary ones
    that come after it, so the last source wins if there is one, else the last.
    """
    typed = pkg_blob.join(pkg.select("pkg_key", F.col("pkg_type").isin("src.rpm", "tarball", "dsc").cast("int").alias("is_source"), F.col("ord").alias("pkg_ord")), "pkg_key")
    order = F.struct("is_source", "pkg_ord", "ord")
    return typed.groupBy("blob").agg(F.max_by(F.struct("pkg_key", "path"), order).alias("own")).select("blob", "own.pkg_key", "own.path")


def merged(left: DataFrame, right: DataFrame) -> DataFrame:
    """The contents of two indexes, each once for a package."""
    return left.unionByName(right).dropDuplicates(["pkg_key", "blob", "path"])


def page(table: DataFrame, order: list, start: int, first_n: int) -> DataFrame:
    """Rows ``start`` to ``start + first_n`` in an order; the limit is what is asked for."""
    return table.orderBy(*order).offset(start).limit(first_n)


def release_summary(deb_source: DataFrame) -> DataFrame:
    """(num_pkgs, total_size) of source packages (package, version, directory, files)."""
    size = F.aggregate("files", F.lit(0).cast("long"), lambda a, f: a + f["size"])
    return deb_source.agg(F.count(F.lit(1)).alias("num_pkgs"), F.sum(size).alias("total_size"))


def best_package(candidates: DataFrame) -> DataFrame:
    """(blob, name, version) from candidates (blob, file_path, name, version, pkg_path, ord).

    A name must stand in the artifact's path.  The first such package all of
    whose path ends the artifact's wins, else the longest common ending, else
    the first package.
    """
    length = text.common_suffix_length(F.col("file_path"), F.col("pkg_path"))
    rated = candidates.withColumn("named", F.contains("file_path", "name")).withColumn("common", F.when(F.col("named"), length))
    rated = rated.withColumn("full", F.col("named") & (F.col("common") == F.length("pkg_path")))
    rank = Window.partitionBy("blob").orderBy(F.desc("full"), F.when(F.col("full"), F.col("ord")), F.desc(F.coalesce("common", F.lit(0))), "ord")
    return rated.withColumn("nth", F.row_number().over(rank)).filter("nth = 1").select("blob", "name", "version")


def provider(files: DataFrame, index: DataFrame, installed: DataFrame) -> DataFrame:
    """(path, provider): the package of a file from the source index, else from the installed catalog; both (path, pkg_key)."""
    one = index.groupBy("path").agg(F.max("pkg_key").alias("p1"))
    two = installed.groupBy("path").agg(F.max("pkg_key").alias("p2"))
    return files.select("path").distinct().join(one, "path", "left").join(two, "path", "left").select("path", F.coalesce("p1", "p2").alias("provider"))


def reusable_archives(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """The cached archives with the wanted name and content."""
    return cache.join(wanted.select("filename", "blob").distinct(), ["filename", "blob"], "left_semi")


def sbom_groups(blobs: DataFrame, node: DataFrame, best: DataFrame | None = None) -> DataFrame:
    """(root, pkg_key, blobs, n_blobs) from (root, blob): the owner of each artifact.

    By precedence: the providing package, the first of its packages, a name
    and version told by its path, the best package of an index, or unknown.
    """
    rows = blobs.select("root", "blob").distinct().join(node.select("blob", "file_path", "prov_pkg", "pkgs"), "blob", "left")
    told = text.component_of_path(F.col("file_path"))
    rows = rows.withColumn("told", told)
    if best is not None:
        rows = rows.join(best.select("blob", F.concat_ws(" ", F.lit("INDEX"), "name", "version").alias("indexed")), "blob", "left")
    else:
        rows = rows.withColumn("indexed", F.lit(None).cast("string"))
    derived = F.when(F.col("told.name").isNotNull() & (F.col("told.name") != ""), F.concat_ws(" ", F.lit("DERIVED_PKG"), "told.name", "told.version"))
    key = F.coalesce("prov_pkg", F.get("pkgs", F.lit(0)), derived, "indexed", F.lit(UNKNOWN))
    return rows.groupBy("root", key.alias("pkg_key")).agg(F.array_sort(F.collect_set("blob")).alias("blobs"), F.count(F.lit(1)).alias("n_blobs"))


def sbom_summary(groups: DataFrame) -> DataFrame:
    """(root, n_packages, n_blobs, n_unknown, unknown_pct) for each root."""
    unknown = F.sum(F.when(F.col("pkg_key") == UNKNOWN, F.col("n_blobs")).otherwise(0))
    return groups.groupBy("root").agg(
        F.count(F.when(F.col("pkg_key") != UNKNOWN, 1)).alias("n_packages"), F.sum("n_blobs").alias("n_blobs"), unknown.alias("n_unknown"),
        (unknown * F.lit(100.0) / F.sum("n_blobs")).alias("unknown_pct"),
    )


def image_packages(lines: DataFrame, eggs: DataFrame) -> DataFrame:
    """(line, blob, pkg_key, owner_kind): an image's files with the package that provides them, else the one an egg-info tells.

    ``lines(line, blob, file_path, prov_pkg)``, ``eggs(folder, name, version)``:
    an egg owns what lies in its folder, the longest folder first.
    """
    parts = F.split("file_path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    free = lines.filter("prov_pkg IS NULL").select("line", F.explode(folders).alias("folder"))
    egg = free.join(eggs, "folder").groupBy("line").agg(F.max_by(F.concat_ws(" ", "name", "version"), F.length("folder")).alias("egg_pkg"))
    joined = lines.join(egg, "line", "left")
    kind = F.when(F.col("prov_pkg").isNotNull(), "provided").when(F.col("egg_pkg").isNotNull(), "egg").otherwise("none")
    return joined.select("line", "blob", F.coalesce("prov_pkg", "egg_pkg").alias("pkg_key"), kind.alias("owner_kind"))


def packages_of_inputs(edge: DataFrame, node: DataFrame) -> DataFrame:
    """(blob, pkgs): the package infos of what each artifact is an input of."""
    owners = node.filter("size(pkg_infos) > 0").select(F.col("blob").alias("out_blob"), F.explode("pkg_infos").alias("pkg"))
    return edge.select("out_blob", F.col("in_blob").alias("blob")).distinct().join(owners, "out_blob").groupBy("blob").agg(F.array_sort(F.collect_set("pkg")).alias("pkgs"))


#: Fixed value: the package of image files that none provides.
NO_PROVIDER = "UNKNOWN_PATH UNKNOWN_PKG UNKNOWN_VERSION"


def owned_image_files(entries: DataFrame, present: DataFrame) -> DataFrame:
    """(line, blob, pkg_key): lines ``blob ...`` of an image that a package provides and whose file is present.

    ``entries(line, prov_pkg, imag_pkg)``, ``present(blob)``; a providing
    package goes before one told by the image.
    """
    from stemma.functions import ident

    rows = entries.filter(F.startswith("line", F.lit("blob "))).select("line", ident.parse_line(F.col("line"))["blob"].alias("blob"), F.coalesce("prov_pkg", "imag_pkg").alias("pkg_key"))
    known = rows.filter(F.col("pkg_key").isNotNull() & (F.col("pkg_key") != NO_PROVIDER))
    return known.join(present.select("blob").distinct(), "blob", "left_semi").select("line", "blob", "pkg_key")


def package_record(packages: DataFrame, members: DataFrame, seq_from: int = 1) -> DataFrame:
    """Build records of packages: a package file is made of all its member files, and carries its info.

    ``packages(archive, blob, pkg_info)``, ``members(archive, path, blob)``.
    """
    none = F.array().cast("array<string>")
    entry = F.struct(F.lit(0).alias("pos"), "blob", "path", none.alias("has_cve"), none.alias("fixed_cve"), F.lit(None).cast("string").alias("prov_pkg"))
    lists = members.groupBy("archive").agg(F.array_sort(F.collect_list(entry)).alias("infiles"))
    blank = lambda c: F.lit(None).cast("string").alias(c)
    joined = numbered(packages.join(lists, "archive"), ["archive"])
    return joined.select(
        (F.col("nth") + seq_from).cast("long").alias("seq"), blank("pid"), blank("exec_mode"), F.col("blob").alias("out_blob"), F.col("archive").alias("out_path"),
        F.concat(F.lit("package "), "archive").alias("build_cmd"), blank("build_tool"), "pkg_info", blank("prune"), F.lit(False).alias("ignore"), "infiles",
        F.array().cast("array<struct<pos:int,blob:string,path:string>>").alias("dynlibs"),
    )

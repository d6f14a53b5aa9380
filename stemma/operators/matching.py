"""Matching build outputs with their sources where no trace tells: class files, libraries, imports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemma.functions import text
from stemma.operators.closure import closure


def _name(c: str):
    return F.element_at(F.split(c, "/"), -1)


def same_content(files: DataFrame, workspace: DataFrame) -> DataFrame:
    """(path, match): the first workspace file with a file's name and content; both (path, blob)."""
    w = workspace.select(_name("path").alias("name"), "blob", F.col("path").alias("match"))
    return files.withColumn("name", _name("path")).join(w, ["name", "blob"]).groupBy("path").agg(F.min("match").alias("match"))


def most_similar(files: DataFrame, sources: DataFrame, *, least: int = 3) -> DataFrame:
    """(path, match, score): the source of a file's base name whose path is most alike; ties keep the first in order.

    ``files(path, base)``, ``sources(path, base, ord)``; fewer than ``least`` shared parts are no match.
    """
    pairs = files.join(sources.select("base", F.col("path").alias("match"), "ord"), "base")
    scored = pairs.withColumn("score", text.path_similarity(F.col("path"), F.col("match"))).filter(F.col("score") >= least)
    best = Window.partitionBy("path").orderBy(F.desc("score"), "ord")
    return scored.withColumn("nth", F.row_number().over(best)).filter("nth = 1").select("path", "match", "score")


def class_sources(classes: DataFrame, sources: DataFrame) -> DataFrame:
    """(class_path, source_path): inner classes go by their outer one's name, the base before ``$``."""
    files = classes.select("path", F.regexp_replace(_name("path"), r"(\$.*)?\.class$", "").alias("base"))
    java = sources.select("path", F.regexp_replace(_name("path"), r"\.java$", "").alias("base"), F.row_number().over(Window.partitionBy(_name("path")).orderBy("path")).alias("ord"))
    return most_similar(files, java).select(F.col("path").alias("class_path"), F.col("match").alias("source_path"))


def needed_libraries(elf: DataFrame, lib: DataFrame) -> DataFrame:
    """(path, soname, lib_path) of what each file needs: the base map first, then the extra one, then its own run paths.

    ``elf(path, bits, needed, rpath)``, ``lib(bits, soname, path, prio)`` with
    the base map at priority 0; a run path is searched in its order.
    """
    need = elf.select("path", "bits", F.explode("needed").alias("soname")).distinct()
    mapped = lib.groupBy("bits", "soname").agg(F.min_by("path", "prio").alias("mapped"))
    own = searched_libraries(elf, lib).withColumnRenamed("lib_path", "own")
    joined = need.join(mapped, ["bits", "soname"], "left").join(own, ["path", "soname"], "left")
    return joined.select("path", "soname", F.coalesce("mapped", "own").alias("lib_path")).filter("lib_path IS NOT NULL").distinct()


def searched_libraries(elf: DataFrame, lib: DataFrame) -> DataFrame:
    """(path, soname, lib_path) of what lies on each file's own run paths, the first of them."""
    need = elf.select("path", "bits", "rpath", F.explode("needed").alias("soname")).distinct()
    where = lib.select("bits", "soname", F.col("path").alias("lib_path"), F.regexp_replace("path", "/[^/]*$", "").alias("folder")).distinct()
    tried = need.select("path", "bits", "soname", F.posexplode("rpath").alias("pos", "folder")).join(where, ["bits", "soname", "folder"])
    return tried.groupBy("path", "soname").agg(F.min_by("lib_path", "pos").alias("lib_path"))


def library_closure(elf: DataFrame, lib: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, blob, depth): all libraries that files need, their libraries included; ``blob`` is a path."""
    links = needed_libraries(elf, lib).select(F.col("path").alias("out_blob"), F.col("lib_path").alias("in_blob"))
    return closure(links, roots)


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(path, lib_path): each imported module's file, by name and never by importing it.

    ``imports(path, module, level)``, ``files(path)``; a module is a file or a
    package folder; relative imports start at the importing file's folder.
    Imports inside a handled failure are kept if they resolve.
    """
    folder = F.regexp_replace("path", "/[^/]*$", "")
    up = F.regexp_replace(folder, F.concat(F.lit("(/[^/]*){"), F.greatest(F.col("level") - 1, F.lit(0)).cast("string"), F.lit("}$")), F.lit(""))
    tail = F.replace("module", F.lit("."), F.lit("/"))
    wanted = imports.select("path", F.when(F.col("level") > 0, F.concat_ws("/", up, F.nullif(tail, F.lit("")))).alias("exact"), tail.alias("tail"), "level")
    known = files.select(F.col("path").alias("lib_path"), F.regexp_replace(F.regexp_replace("path", r"/__init__\.py$", ".py"), r"\.py$", "").alias("stem")).distinct()
    relative = wanted.filter("level > 0").join(known, F.col("exact") == F.col("stem")).select("path", "lib_path")
    parts = F.split("stem", "/")
    tails = known.select("lib_path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))).alias("tail"))
    absolute = wanted.filter("level = 0").join(tails, "tail").groupBy("path", "tail").agg(F.min_by("lib_path", F.struct(F.length("lib_path"), "lib_path")).alias("lib_path")).select("path", "lib_path")
    return relative.unionByName(absolute).distinct()


def import_closure(imports: DataFrame, files: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, blob, depth) over resolved imports, which may go in circles."""
    links = resolve_imports(imports, files).select(F.col("path").alias("out_blob"), F.col("lib_path").alias("in_blob"))
    return closure(links, roots)

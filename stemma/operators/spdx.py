"""SPDX documents as tables: packages, files and relationships, and their JSON and tag-value text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemma.functions import ident, text
from stemma.operators.packages import UNKNOWN

#: Fixed value: the version that documents declare.
VERSION = "SPDX-2.3"


def stable_id(*parts: Column) -> Column:
    """Sixteen hex digits that depend on content alone, so that documents are the same each time."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(p, F.lit("")) for p in parts]).cast("binary"), 256), 1, 16)


def verification_code(files: DataFrame) -> DataFrame:
    """(doc, code): the SHA-1 of all files' SHA-1 digests, sorted and joined, as the format defines it."""
    return files.groupBy("doc").agg(F.sha1(F.array_join(F.array_sort(F.collect_list("sha1")), "").cast("binary")).alias("code"))


def external_refs(bom_id: Column, purl: Column, cpe: Column, alg: str = "sha1") -> Column:
    """The references of a main package: its document, package URL and platform name, as far as it has them."""
    ref = lambda category, kind, locator: F.when(locator.isNotNull(), F.struct(F.lit(category).alias("category"), F.lit(kind).alias("type"), locator.alias("locator")))
    all_refs = F.array(ref("PERSISTENT-ID", "gitoid", ident.uri(bom_id, alg)), ref("PACKAGE-MANAGER", "purl", purl), ref("SECURITY", "cpe23Type", cpe))
    return F.filter(all_refs, lambda r: r.isNotNull())


def file_rows(files: DataFrame) -> DataFrame:
    """(doc, spdx_id, name, file_type, sha1, sha256) from files (doc, name, content)."""
    return files.select(
        "doc", F.concat(F.lit("SPDXRef-File-"), stable_id(F.col("doc"), F.col("name"))).alias("spdx_id"), "name",
        text.spdx_file_type(F.col("name"), F.col("content")).alias("file_type"), F.sha1("content").alias("sha1"), F.sha2("content", 256).alias("sha256"),
    )


def wanted_packages(packages: DataFrame) -> DataFrame:
    """Packages that go into a document: named, known, and not only told by a path."""
    key = F.col("pkg_key")
    return packages.filter(key.isNotNull() & (key != "") & (key != UNKNOWN) & ~key.startswith("DERIVED_PKG "))


def reuse_existing(packages: DataFrame, existing: DataFrame) -> DataFrame:
    """(pkg_key, spdx_id): a package's id in the document, that of an existing one with the same file name if there is one."""
    known = existing.groupBy("file_name").agg(F.min("spdx_id").alias("known"))
    own = F.concat(F.lit("SPDXRef-Package-"), stable_id(F.col("pkg_key")))
    return packages.join(known, packages["pkg_key"] == known["file_name"], "left").select("pkg_key", F.coalesce("known", own).alias("spdx_id")).distinct()


def relationships(main: DataFrame, files: DataFrame, build_deps: DataFrame, lib_deps: DataFrame) -> DataFrame:
    """(doc, src, type, dst), each once: what the document describes, contains, was built from and depends on.

    ``main(doc, spdx_id)``, ``files(doc, spdx_id)``, ``build_deps`` and ``lib_deps`` (doc, spdx_id).
    """
    top = main.select("doc", F.col("spdx_id").alias("main"))
    rows = main.select("doc", F.lit("SPDXRef-DOCUMENT").alias("src"), F.lit("DESCRIBES").alias("type"), F.col("spdx_id").alias("dst"))
    rows = rows.unionByName(files.join(top, "doc").select("doc", F.col("main").alias("src"), F.lit("CONTAINS").alias("type"), F.col("spdx_id").alias("dst")))
    rows = rows.unionByName(build_deps.join(top, "doc").select("doc", F.col("spdx_id").alias("src"), F.lit("BUILD_DEPENDENCY_OF").alias("type"), F.col("main").alias("dst")))
    rows = rows.unionByName(lib_deps.join(top, "doc").select("doc", F.col("main").alias("src"), F.lit("DEPENDS_ON").alias("type"), F.col("spdx_id").alias("dst")))
    return rows.dropDuplicates(["doc", "src", "type", "dst"])


def image_contents(packages: DataFrame, files: DataFrame) -> DataFrame:
    """(doc, src, type, dst): an image's sub-packages contain their files; files of no package hang on the image."""
    sub = packages.select("doc", "pkg_key", F.col("spdx_id").alias("src"))
    return files.join(sub, ["doc", "pkg_key"], "left").select("doc", F.coalesce("src", F.lit("SPDXRef-Image")).alias("src"), F.lit("CONTAINS").alias("type"), F.col("spdx_id").alias("dst")).distinct()


def to_json(doc: DataFrame, packages: DataFrame, files: DataFrame, relations: DataFrame) -> DataFrame:
    """(doc, json): one document's text, from doc(doc, name, created) and the three tables; lists are sorted by id."""
    checks = lambda *pairs: F.array(*[F.struct(F.lit(a).alias("algorithm"), F.col(c).alias("checksumValue")) for a, c in pairs])
    listed = lambda df, name, *cols: df.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    p = listed(packages, "packages", F.col("spdx_id").alias("SPDXID"), F.col("name"), F.coalesce("version", F.lit("NOASSERTION")).alias("versionInfo"), F.lit("NOASSERTION").alias("downloadLocation"))
    f = listed(files, "files", F.col("spdx_id").alias("SPDXID"), F.col("name").alias("fileName"), checks(("SHA1", "sha1"), ("SHA256", "sha256")).alias("checksums"))
    r = listed(relations, "relationships", F.col("src").alias("spdxElementId"), F.col("type").alias("relationshipType"), F.col("dst").alias("relatedSpdxElement"))
    joined = doc.join(p, "doc", "left").join(f, "doc", "left").join(r, "doc", "left")
    head = F.struct(F.concat(F.lit("Created: "), "created").alias("comment"), F.col("created"))
    body = F.struct(F.lit(VERSION).alias("spdxVersion"), F.lit("CC0-1.0").alias("dataLicense"), F.lit("SPDXRef-DOCUMENT").alias("SPDXID"), F.col("name"), F.concat(F.lit("urn:stemma:"), stable_id(F.col("doc"), F.col("name"))).alias("documentNamespace"), head.alias("creationInfo"), "packages", "files", "relationships")
    return joined.select("doc", F.to_json(body).alias("json"))


def to_tag_value(packages: DataFrame) -> DataFrame:
    """(doc, text): the packages of a document in tag-value form."""
    block = F.concat_ws(
        "\n", F.concat(F.lit("PackageName: "), "name"), F.concat(F.lit("SPDXID: "), "spdx_id"), F.concat(F.lit("PackageVersion: "), "version"),
        F.lit("PackageDownloadLocation: NOASSERTION"),
        F.array_join(F.transform("refs", lambda r: F.concat_ws(" ", F.lit("ExternalRef:"), r["category"], r["type"], r["locator"])), "\n"),
    )
    return packages.groupBy("doc").agg(F.array_join(F.array_sort(F.collect_list(F.struct("spdx_id", block.alias("b")))).getField("b"), "\n\n").alias("text"))


def insert_ref_tag_value(docs: DataFrame, alg: str = "sha1", *, force: bool = False) -> DataFrame:
    """(doc, text) with the reference to ``bom_id`` put in, from docs(doc, text, bom_id).

    It goes behind the first ``ExternalRef:`` line; a text without one gets it,
    with ``force``, ahead of its first ``PackageChecksum:`` line.  Others stay.
    """
    lines = F.split("text", "\n")
    at = lambda start: F.array_position(F.transform(lines, lambda x: x.startswith(start)), True).cast("int")
    own = F.array(F.concat(F.lit(f"ExternalRef: PERSISTENT-ID gitoid gitoid:blob:{alg}:"), "bom_id"))
    put = lambda k: F.array_join(F.concat(F.slice(lines, 1, k), own, F.slice(lines, k + 1, F.size(lines))), "\n")
    ref, check = at("ExternalRef:"), at("PackageChecksum:")
    out = F.when(ref > 0, put(ref))
    if force:
        out = out.when(check > 0, put(check - 1))
    return docs.select("doc", F.coalesce(F.when(F.col("bom_id").isNotNull(), out), F.col("text")).alias("text"))


def insert_ref_packages(packages: DataFrame, bom: DataFrame, alg: str = "sha1", *, force: bool = False) -> DataFrame:
    """The package table with a document reference in the first package of each doc that has references.

    ``packages(doc, ord, spdx_id, refs)``, ``bom(doc, bom_id)``.  With
    ``force`` a doc without any gets it as the first package's only reference.
    """
    has = F.size(F.coalesce("refs", F.array().cast(dict(packages.dtypes)["refs"]))) > 0
    w = Window.partitionBy("doc").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marked = packages.withColumn("__first_ref", F.min(F.when(has, F.col("ord"))).over(w)).withColumn("__first", F.min("ord").over(w)).join(bom, "doc", "left")
    new = F.array(F.struct(F.lit("PERSISTENT-ID").alias("category"), F.lit("gitoid").alias("type"), ident.uri(F.col("bom_id"), alg).alias("locator")))
    refs = F.when(F.col("bom_id").isNotNull() & (F.col("ord") == F.col("__first_ref")), F.concat(F.col("refs"), new))
    if force:
        refs = refs.when(F.col("bom_id").isNotNull() & F.col("__first_ref").isNull() & (F.col("ord") == F.col("__first")), new)
    return marked.withColumn("refs", refs.otherwise(F.col("refs"))).select(*packages.columns)

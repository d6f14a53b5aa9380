"""Paths, versions, names, URLs and rule predicates, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes of files whose history can carry a vulnerability, files that never do, and C sources.
SOURCE_SUFFIXES = ("c", "cpp", "pl", "tmpl", "py", "s", "S")
NEVER_SOURCES = ("CHANGES", "README")
C_SUFFIXES = ("c", "C", "cc", "cp", "cpp", "CPP", "cxx", "c++")
#: Fixed value: components that use a single number as their version.
SINGLE_NUMBER_COMPONENTS = ("systemd", "uci", "ubus", "ubox", "libubox", "librpc", "odhcp6c", "jsonfilter")


def suffix_of(path: Column) -> Column:
    """What follows the last dot of a file's name; null without one."""
    return F.nullif(F.regexp_extract(path, r"\.([^./]*)$", 1), F.lit(""))


def is_source_file(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return ~name.isin(*NEVER_SOURCES) & F.coalesce(suffix_of(path).isin(*SOURCE_SUFFIXES), F.lit(False))


def is_c_source(path: Column) -> Column:
    return F.coalesce(suffix_of(path).isin(*C_SUFFIXES), F.lit(False))


def normal_path(path: Column, pwd: Column | None = None, root: Column | None = None) -> Column:
    """An absolute path without ``.``, ``..`` and empty parts: relative ones start at ``pwd``, and ``root`` goes in front."""
    joined = path if pwd is None else F.when(path.startswith("/"), path).otherwise(F.concat(pwd, F.lit("/"), path))
    steps = F.filter(F.split(joined, "/"), lambda s: ~s.isin("", "."))
    kept = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda done, s: F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s))),
    )
    plain = F.concat(F.lit("/"), F.array_join(kept, "/"))
    return plain if root is None else F.when(root.isNotNull() & (root != "") & (root != "/"), F.concat(F.rtrim(root, F.lit("/")), plain)).otherwise(plain)


def outside_root(path: Column, root: Column) -> Column:
    """A path as seen from inside ``root``."""
    inside = root.isNotNull() & (root != "") & path.startswith(root)
    return F.when(inside, F.substring(path, F.length(root) + 1, F.length(path))).otherwise(path)


def merged_usr(path: Column) -> Column:
    """The path under /usr for the top folders that a merged layout links there."""
    return F.when(path.rlike("^/(bin|sbin|lib|lib32|lib64|libx32)/"), F.concat(F.lit("/usr"), path)).otherwise(path)


def common_prefix_length(a: Column, b: Column) -> Column:
    """Characters that two strings share at their start, found by halving."""
    longest = F.least(F.length(a), F.length(b))
    span = F.aggregate(
        F.sequence(F.lit(1), F.lit(24)),
        F.struct(F.lit(0).alias("lo"), longest.alias("hi")),
        lambda acc, _: F.when(
            F.substring(a, F.lit(1), F.ceil((acc["lo"] + acc["hi"]) / 2).cast("int")) == F.substring(b, F.lit(1), F.ceil((acc["lo"] + acc["hi"]) / 2).cast("int")),
            F.struct(F.ceil((acc["lo"] + acc["hi"]) / 2).cast("int").alias("lo"), acc["hi"].alias("hi")),
        ).otherwise(F.struct(acc["lo"].alias("lo"), F.greatest(acc["lo"], F.ceil((acc["lo"] + acc["hi"]) / 2).cast("int") - 1).alias("hi"))),
    )
    return span["lo"]


def common_suffix_length(a: Column, b: Column) -> Column:
    return common_prefix_length(F.reverse(a), F.reverse(b))


def path_similarity(a: Column, b: Column) -> Column:
    """Parts that two paths share at their start, and folders that they share counted back from their names."""

    def shared(x: Column, y: Column) -> Column:
        pairs = F.zip_with(x, y, lambda p, q: p.eqNullSafe(q) & p.isNotNull())
        first_miss = F.array_position(pairs, False)
        return F.when(first_miss == 0, F.size(pairs)).otherwise(first_miss - 1).cast("int")

    whole = lambda p: F.split(p, "/")
    folders = lambda p: F.reverse(F.slice(F.split(p, "/"), 1, F.greatest(F.size(F.split(p, "/")) - 1, F.lit(0))))
    return shared(whole(a), whole(b)) + shared(folders(a), folders(b))


def cve_ids(text: Column) -> Column:
    """All distinct vulnerability numbers in a text, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"CVE-\d{4}-\d+"), F.lit(0)))


def is_git_version(text: Column) -> Column:
    """``2.31+gitAUTOINC+d4b75`` and the like: digits, hex letters, dots and underscores around the mark."""
    return text.rlike(r"^[0-9a-f._]*\+gitAUTOINC\+[0-9a-f._]*$")


def is_dotted_version(text: Column, component: Column | None = None) -> Column:
    """At most seven dotted parts, the first two of digits; a single part only for components known for that."""
    parts = F.split(text, r"\.")
    alone = F.lit(False) if component is None else F.coalesce(component.isin(*SINGLE_NUMBER_COMPONENTS), F.lit(False))
    head = F.array_join(F.slice(parts, 1, 2), "")
    return (F.size(parts) <= 7) & ((F.size(parts) > 1) | alone) & head.rlike(r"^v?[0-9._-]*$") & (head != "")


def is_version(text: Column) -> Column:
    """A version, with or without a release mark such as ``-r3`` behind it."""
    plain = F.regexp_replace(text, r"-r\d+$", "")
    return plain.rlike(r"^v?\d") & (is_git_version(plain) | is_dotted_version(plain))


def component_of_path(path: Column) -> Column:
    """struct(name, version) that a path's folders tell, nearest first: ``name/version/`` or ``name-version``.

    Looks at ten folders from the file upwards, then at the last two parts.
    """
    parts = F.split(path, "/")
    n = F.size(parts)
    upward = F.reverse(F.slice(parts, F.greatest(F.lit(1), n - 10), F.greatest(F.lit(0), F.least(n - 1, F.lit(10)))))
    tokens = F.concat(upward, F.slice(parts, F.greatest(F.lit(1), n - 1), F.least(n, F.lit(2))))

    def dashed(token: Column) -> Column:
        """The first cut of a token into a name and a version, hex or named stages behind it."""
        pieces = F.split(token, "-")
        cuts = F.filter(
            F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(pieces) - 1)),
            lambda i: (i < F.size(pieces)) & is_dotted_version(F.element_at(pieces, i + 1), F.array_join(F.slice(pieces, 1, i), "-")),
        )
        at = F.get(cuts, F.lit(0))
        rest = F.slice(pieces, F.least(at + 2, F.size(pieces) + 1), F.size(pieces))
        stop = F.array_position(F.transform(rest, lambda p: p.rlike("^(?:[0-9a-fA-F]*|alpha|beta)$")), False)
        more = F.when(stop > 0, F.slice(rest, 1, (stop - 1).cast("int"))).otherwise(rest)
        return F.when(
            at.isNotNull(),
            F.struct(F.array_join(F.slice(pieces, 1, at), "-").alias("name"), F.array_join(F.concat(F.array(F.element_at(pieces, at + 1)), more), "-").alias("version")),
        )

    nothing = F.struct(F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("version"))

    def step(state: Column, token: Column) -> Column:
        found = dashed(token)
        return (
            F.when(state["name"].isNotNull(), state)
            .when(is_version(token), F.struct(F.lit(None).cast("string").alias("name"), token.alias("version")))
            .when(state["version"].isNotNull(), F.struct(token.alias("name"), state["version"].alias("version")))
            .otherwise(F.coalesce(found, nothing))
        )

    told = F.aggregate(tokens, nothing, step)
    return F.when(told["name"].isNotNull(), told).otherwise(nothing)


#: Fixed value: endings of source archives.
ARCHIVE_ENDINGS = r"\.(?:tar\.(?:gz|xz|bz2|lzma|zst)|tgz|tbz2|txz|zip|tar)$"


def archive_name_version(filename: Column) -> Column:
    """struct(name, version) of a source archive's file name.

    Shapes: ``name_1.2.orig.tar.xz``, ``name_1.2-3.debian.tar.xz``,
    ``name-1.2.tar.gz``, ``name-v1.2.tar.gz``, ``v1.2.tar.gz`` (no name) and a
    name alone (no version).
    """
    stem = F.regexp_replace(filename, ARCHIVE_ENDINGS, "")
    stem = F.regexp_replace(stem, r"\.(?:orig(?:-[^.]+)?|debian)$", "")
    under, dash, bare = r"^([^_]+)_(\d.*)$", r"^(.+?)-(v?\d[^/]*)$", r"^(v?\d[^/]*)$"
    name = F.when(stem.rlike(under), F.regexp_extract(stem, under, 1)).when(stem.rlike(dash), F.regexp_extract(stem, dash, 1)).when(stem.rlike(bare), F.lit("")).otherwise(stem)
    version = F.when(stem.rlike(under), F.regexp_extract(stem, under, 2)).when(stem.rlike(dash), F.regexp_extract(stem, dash, 2)).when(stem.rlike(bare), stem).otherwise(F.lit(""))
    return F.struct(name.alias("name"), version.alias("version"))


def image_name_version(filename: Column) -> Column:
    """struct(name, version) of an image file: what stands before the first dotted part that is all digits, and the rest."""
    parts = F.split(filename, "[-_]")
    is_number = F.transform(parts, lambda p: F.split(p, r"\.")[0].rlike(r"^\d+$"))
    at = F.array_position(is_number, True).cast("int")
    return F.struct(
        F.when(at > 1, F.array_join(F.slice(parts, 1, at - 1), "-")).otherwise(filename).alias("name"),
        F.when(at > 0, F.element_at(parts, F.greatest(at, F.lit(1)))).otherwise(F.lit("")).alias("version"),
    )


def without_macro(text: Column, name: str, value: Column) -> Column:
    """``text`` with the first ``%{name}`` or ``%{?name}`` replaced by ``value``."""
    return F.regexp_replace(text, F.lit(rf"^(.*?)%\{{\??{name}\}}"), F.concat(F.lit("$1"), value))


def deb_pool_url(mirror: Column, package: Column, filename: Column) -> Column:
    """The pool URL of a package's file: four letters stand for libraries, one for others."""
    short = F.when(package.startswith("lib") & (F.length(package) > 3), F.substring(package, 1, 4)).otherwise(F.substring(package, 1, 1))
    return F.concat_ws("/", F.rtrim(mirror, F.lit("/")), F.lit("pool/main"), short, package, filename)


def plain_git_url(url: Column) -> Column:
    """A fetchable URL of ``git://``, ``git+https://`` or ``gitsm://`` forms, without parameters; user names keep their ``@``."""
    bare = F.regexp_replace(url, ";.*$", "")
    ssh = bare.contains("protocol=ssh")
    return F.when(ssh, bare).otherwise(F.regexp_replace(bare, r"^(?:git\+)?(?:https?|git|gitsm)://", "https://"))


def clone_folder(url: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(F.rtrim(url, F.lit("/")), "/"), -1), r"\.git$", "")


def openssl_url_version(version: Column) -> Column:
    """1.1.1k goes by ``1_1_1k`` in tags; 3.x versions keep their dots."""
    return F.when(version.rlike("^[01]\\."), F.concat(F.lit("OpenSSL_"), F.replace(version, F.lit("."), F.lit("_")))).otherwise(F.concat(F.lit("openssl-"), version))


def purl(kind: str, namespace: Column, name: Column, version: Column, arch: Column | None = None, distro: Column | None = None, epoch: Column | None = None) -> Column:
    """``pkg:kind/namespace/name@version`` with its qualifiers in alphabetical order."""
    pairs = [(k, v) for k, v in (("arch", arch), ("distro", distro), ("epoch", epoch)) if v is not None]
    quoted = lambda c: F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    known = [F.when(v.isNotNull() & (v != ""), F.concat(F.lit(f"{k}="), quoted(v))) for k, v in pairs]
    tail = F.concat_ws("&", *known) if known else F.lit("")
    base = F.concat(F.lit(f"pkg:{kind}/"), quoted(namespace), F.lit("/"), quoted(name), F.lit("@"), quoted(version))
    return F.when(tail != "", F.concat(base, F.lit("?"), tail)).otherwise(base)


def cpe23(vendor: Column, product: Column, version: Column) -> Column:
    escaped = lambda c: F.regexp_replace(F.lower(c), r"([^a-z0-9_.\-])", r"\\$1")
    return F.concat(F.lit("cpe:2.3:a:"), escaped(vendor), F.lit(":"), escaped(product), F.lit(":"), escaped(version), F.lit(":*:*:*:*:*:*:*"))


def spdx_id(name: Column) -> Column:
    """A name with what an SPDX id may not hold turned into dashes."""
    return F.concat(F.lit("SPDXRef-"), F.regexp_replace(name, r"[^A-Za-z0-9.\-]", "-"))


def info_field(lines: Column, tag: str) -> Column:
    """The value of ``Tag : value`` or ``Tag: value`` among the lines of a package's info, trimmed; null without it."""
    own = F.filter(lines, lambda x: x.rlike(rf"^{tag}\s*:"))
    return F.trim(F.regexp_replace(F.get(own, F.lit(0)), rf"^{tag}\s*:", ""))


def info_description(lines: Column) -> Column:
    """What follows the line ``Description :``, up to the end."""
    at = F.array_position(F.transform(lines, lambda x: x.rlike(r"^Description\s*:")), True).cast("int")
    own = F.trim(F.regexp_replace(F.element_at(lines, F.greatest(at, F.lit(1))), r"^Description\s*:", ""))
    rest = F.slice(lines, F.least(at + 1, F.size(lines) + 1), F.size(lines))
    return F.when(at > 0, F.array_join(F.filter(F.concat(F.array(own), rest), lambda x: x != ""), "\n"))


def rule_holds(text: Column, include: Column, exclude: Column) -> Column:
    """Whether a text has one string of every group of ``include`` and no string of any group of ``exclude``."""
    every = F.forall(include, lambda group: F.exists(group, lambda s: F.contains(text, s)))
    return every & ~F.exists(exclude, lambda group: F.exists(group, lambda s: F.contains(text, s)))


def rule_verdict(added: Column, fixed: Column) -> Column:
    """``fixed`` wins over ``has``; null where neither rule holds."""
    return F.when(fixed, F.lit("fixed")).when(added, F.lit("has"))


def file_kind(head: Column) -> Column:
    """A coarse class of binary content by its first bytes."""
    starts = lambda *marks: F.hex(F.substring(head, 1, 8)).rlike("^(?:" + "|".join(marks) + ")")
    return (
        F.when(starts("7F454C46"), "elf").when(starts("213C617263683E0A"), "archive").when(starts("504B0304"), "zip").when(starts("CAFEBABE"), "class")
        .when(starts("1F8B"), "gzip").when(starts("FD377A585A00"), "xz").when(starts("425A68"), "bzip2").when(starts("EDABEEDB"), "rpm")
        .when(starts("89504E47", "FFD8FF", "474946"), "image").when(starts("2321"), "script").otherwise("other")
    )


def spdx_file_type(path: Column, head: Column) -> Column:
    """SOURCE, BINARY, IMAGE, ARCHIVE or TEXT."""
    kind = file_kind(head)
    return (
        F.when(kind.isin("elf", "class"), "BINARY").when(kind == "image", "IMAGE").when(kind.isin("archive", "zip", "gzip", "xz", "bzip2", "rpm"), "ARCHIVE")
        .when((kind == "script") | is_c_source(path) | is_source_file(path), "SOURCE").otherwise("TEXT")
    )


#: Mirrors by distribution, and the distributions' releases.
MIRRORS = {"ubuntu": "http://archive.ubuntu.com/ubuntu", "debian": "http://ftp.debian.org/debian", "debian-archive": "http://archive.debian.org/debian"}
RELEASES = {
    "ubuntu": ("trusty", "xenial", "bionic", "focal", "jammy", "kinetic", "lunar", "mantic"),
    "debian": ("buster", "bullseye", "bookworm"),
    "debian-archive": ("buzz", "rex", "bo", "hamm", "slink", "potato", "woody", "sarge", "etch", "lenny", "squeeze", "wheezy", "jessie", "stretch"),
}


def release_mirror(release: Column) -> Column:
    """The mirror of a well-known release; empty for others."""
    out = F.lit("")
    for kind, names in RELEASES.items():
        out = F.when(release.isin(*names), F.lit(MIRRORS[kind])).otherwise(out)
    return out


def is_regular_mode(mode: Column) -> Column:
    """Whether a file mode's type bits say regular file."""
    return mode.bitwiseAND(F.lit(0o170000)) == F.lit(0o100000)

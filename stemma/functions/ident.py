"""Content identifiers and the text of input-list documents, as column expressions.

An artifact's identifier is the hash of ``blob <length>``, a zero byte and its
content.  A document lists the inputs of an artifact, one line each, and its
own identifier is the hash of its text taken as content.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The hash algorithms and the length of their hex digests.
ALGORITHMS = {"sha1": 40, "sha256": 64}


def _digest(content: Column, alg: str) -> Column:
    if alg not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {alg}")
    return F.sha1(content) if alg == "sha1" else F.sha2(content, 256)


def gitoid(content: Column, alg: str = "sha1") -> Column:
    """The identifier of binary content; null content has none."""
    head = F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string")), "UTF-8")
    return _digest(F.concat(head, F.unhex(F.lit("00")), content), alg)


def gitoid_of_text(text: Column, alg: str = "sha1") -> Column:
    return gitoid(F.encode(text, "UTF-8"), alg)


def doc_line(blob: Column, bom: Column) -> Column:
    """``blob B`` or ``blob B bom D``."""
    return F.concat(F.lit("blob "), blob, F.when(bom.isNotNull() & (bom != ""), F.concat(F.lit(" bom "), bom)).otherwise(F.lit("")))


def header(alg: str = "sha1") -> str:
    return f"gitoid:blob:{alg}\n"


def doc_text(lines: Column, alg: str = "sha1", *, with_header: bool = True, dedupe: bool = True) -> Column:
    """The document of an array of lines: sorted, without repeats, each line ended, under its header."""
    ordered = F.array_sort(F.array_distinct(lines) if dedupe else lines)
    return F.concat(F.lit(header(alg) if with_header else ""), F.array_join(ordered, "\n"), F.lit("\n"))


def bom_id(lines: Column, alg: str = "sha1", **options) -> Column:
    """The identifier of the document of an array of lines."""
    return gitoid_of_text(doc_text(lines, alg, **options), alg)


def parse_line(line: Column) -> Column:
    """struct(blob, bom) of ``blob B``, ``blob B bom D`` or a bare identifier; nulls where it is none of them."""
    hexes = r"([0-9a-f]{64}|[0-9a-f]{40})"
    part = lambda k: F.nullif(F.regexp_extract(line, rf"^(?:blob )?{hexes}(?: bom {hexes})?\s*$", k), F.lit(""))
    return F.struct(part(1).alias("blob"), part(2).alias("bom"))


def uri(identifier: Column, alg: str = "sha1") -> Column:
    return F.concat(F.lit(f"gitoid:blob:{alg}:"), identifier)


def is_zero(identifier: Column) -> Column:
    """Whether an identifier is all zeros."""
    return identifier.rlike("^0+$")


def is_hex(text: Column) -> Column:
    return text.rlike("^[0-9a-fA-F]*$")


def _note_head(owner: str, size: int, tag: int) -> str:
    """Hex digits of what stands ahead of an id: the lengths of name and id and a tag as little-endian words, and the name.

    The name ends with a zero byte and is padded to whole words.
    """
    name = owner.encode() + b"\0"
    head = len(name).to_bytes(4, "little") + size.to_bytes(4, "little") + tag.to_bytes(4, "little")
    return (head + name + bytes(-len(name) % 4)).hex()


def packed(text: Column) -> Column:
    """An identifier as bytes, for tables that are dealt or kept: half as long where it is lower-case hex, and itself otherwise.

    A leading byte tells which, so ``unpacked`` gives back any text.
    """
    raw = F.unhex(text)
    return F.when(F.lower(F.hex(raw)) == text, F.concat(F.unhex(F.lit("00")), raw)).otherwise(F.concat(F.unhex(F.lit("01")), text.cast("binary")))


def unpacked(value: Column) -> Column:
    rest = F.substring(value, F.lit(2), F.octet_length(value))
    return F.when(F.substring(value, F.lit(1), F.lit(1)) == F.unhex(F.lit("00")), F.lower(F.hex(rest))).otherwise(rest.cast("string"))


def embedded_note(sha1_bom: Column, sha256_bom: Column, owner: str) -> Column:
    """The payload of an object file's note section of ``owner``: one entry for each algorithm that has an id."""

    def entry(bom: Column, size: int, tag: int) -> Column:
        return F.when(bom.isNotNull() & (bom != ""), F.concat(F.unhex(F.lit(_note_head(owner, size, tag))), F.unhex(bom))).otherwise(F.unhex(F.lit("")))

    return F.concat(entry(sha1_bom, 20, 1), entry(sha256_bom, 32, 2))


def read_embedded_note(content: Column, owner: str, alg: str = "sha1") -> Column:
    """The id that ``embedded_note`` put into binary content, or null."""
    size, tag = (20, 1) if alg == "sha1" else (32, 2)
    mark = _note_head(owner, size, tag)
    digits = F.lower(F.hex(content))
    at = F.instr(digits, mark)
    return F.when((at > 0) & (at % 2 == 1), F.substring(digits, at + len(mark), F.lit(2 * size)))

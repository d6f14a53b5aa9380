"""Document fingerprints: SimHash, and radius search by blocks.

The terms of a text are its word pairs, with a mark before the first and after
the last word; a term that stands ``c`` times weighs ``1 + ln c``.  Each term
is hashed to ``BITS`` bits, adds its weight to the bits that are set and takes
it from the others, and a fingerprint bit is set where the sum is positive.

``radius_search`` cuts fingerprints into blocks, seven for ``RADIUS``.  Of two
that differ in ``radius`` bits at most, one block differs in ``radius`` over
the number of blocks at most, two bits.  The table is keyed by each block as it
is, the queries, which are fewer, by each block with up to two bits turned, so
the keys together find every fingerprint within the radius.  Only distinct
fingerprints are keyed.

Texts of which 3 of 4 five-word shingles are common are 12 bits apart in the
middle and 15 in nine of ten cases; texts that have nothing to do with each
other are 64 apart.  ``RADIUS`` lies between.

``fingerprint_edits`` also fingerprints each text with its end overwritten by
the start of the next document.  Rows are dealt by ranges of the id and
streamed in order; the first and last row of each range go through one small
second pass that joins the ranges.

Defined results: a null text is empty; the empty text's fingerprint is zero;
rows with equal ids are ordered by text, null ids come first; the next document
after the last is the first; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.llm.words import mix64, word_hashes, words
from stemma.plans.storage import materialise

BITS, RADIUS = 128, 20
_MARK = np.array([0x243F6A8885A308D3], np.uint64)


def fingerprint(text: str | None) -> bytes:
    """The SimHash of a text, ``BITS`` bits as bytes."""
    hashes = word_hashes(words(text))
    if not len(hashes):
        return bytes(BITS // 8)
    left, right = np.concatenate([_MARK, hashes]), np.concatenate([hashes, _MARK])
    terms, counts = np.unique(mix64(left * np.uint64(0xC2B2AE3D27D4EB4F) + right), return_counts=True)
    wide = np.empty((len(terms), 2), np.uint64)
    wide[:, 0], wide[:, 1] = terms, mix64(terms + np.uint64(0x452821E638D01377))
    bits = np.unpackbits(wide.view(np.uint8), axis=1)
    once = counts == 1
    total, single = float(once.sum()), bits if once.all() else bits[once]
    # Sums of up to 255 rows fit a byte.
    whole = len(single) // 255 * 255
    votes = single[whole:].sum(axis=0, dtype=np.uint8).astype(np.float64)
    if whole:
        votes += single[:whole].reshape(-1, 255, BITS).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    if len(single) < len(terms):
        weights = 1 + np.log(counts[~once])
        votes += weights @ bits[~once]
        total += weights.sum()
    return np.packbits(2 * votes > total).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """The share of equal bits."""
    return 1 - (int.from_bytes(a) ^ int.from_bytes(b)).bit_count() / (8 * len(a))


def fingerprints(df: DataFrame, *, text_col: str = "text", into: str = "fingerprint") -> DataFrame:
    """``df`` with the fingerprint of ``text_col`` as a hex string."""
    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: fingerprint(t).hex())

    return df.withColumn(into, of(F.coalesce(F.col(text_col), F.lit(""))))


_FIELDS = [
    ("part", pa.int32()), ("edge", pa.int32()), ("row_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("text", pa.string()),
]
_ROWS = pa.schema(_FIELDS)
SCHEMA = "part int, edge int, row_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, text string"


def _pair(part: int, row_id, text: str, own: bytes, following: str, its: bytes) -> tuple:
    tail = len(text) // 4
    edited = text[: len(text) - tail] + following[:tail]
    mark = fingerprint(edited) if tail else own
    return (part, 0, row_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own.hex(), mark.hex(), likeness(own, mark), likeness(own, its), None)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _FIELDS, strict=True)], schema=_ROWS)


def _range_rows(batches):
    """Each row with the next one of its range; the range's first (edge 1) and last (edge 2) row with their texts."""
    from pyspark import TaskContext

    part, out, before = TaskContext.get().partitionId(), [], None
    edge = lambda kind, row_id, text: (part, kind, row_id, *[None] * 6, text)
    for batch in batches:
        for row_id, text in zip(batch.column(0), batch.column(1), strict=True):
            now = (row_id.as_py(), (text := text.as_py() or ""), fingerprint(text))
            out.append(edge(1, *now[:2]) if before is None else _pair(part, *before, *now[1:]))
            before = now
            if len(out) >= 2000:
                yield _batch(out)
                out = []
    if before is not None:
        out.append(edge(2, *before[:2]))
    if out:
        yield _batch(out)


def _joined_edges(batches):
    """The last row of each range with the first of the next one, in the order of ranges."""
    first = last = None
    for batch in batches:
        for row in batch.to_pylist():
            if row["edge"] == 1:
                first = first or row
                if last:
                    yield _batch([_pair(last["part"], last["row_id"], last["text"], fingerprint(last["text"]), row["text"], fingerprint(row["text"]))])
            else:
                last = row
    if last:
        yield _batch([_pair(last["part"], last["row_id"], last["text"], fingerprint(last["text"]), first["text"], fingerprint(first["text"]))])


def fingerprint_edits(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = df.select(F.col(id_col).cast("long").alias("row_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ranged = texts.repartitionByRange(parts, "row_id").sortWithinPartitions("row_id", "text")
    rows = materialise(ranged.mapInArrow(_range_rows, SCHEMA), "simhash")
    # Two rows for each range at most.
    edges = rows.filter("edge > 0").repartition(1).sortWithinPartitions("part", "edge").mapInArrow(_joined_edges, SCHEMA)
    return rows.filter("edge = 0").unionByName(edges).drop("part", "edge", "text")


def blocks(bits: int, radius: int) -> tuple[list[tuple[int, int]], int]:
    """The first and last bit of each block, and the most errors in the best block of two fingerprints within ``radius``."""
    n = max(radius // 3 + 1, bits // 20)
    cuts = [round(k * bits / n) for k in range(n + 1)]
    return list(zip(cuts, cuts[1:], strict=False)), radius // n


def _cut(words: list, begin: int, end: int):
    """Bits ``begin`` to ``end`` of a fingerprint in 64-bit words, as a number."""
    first, last = begin // 64, (end - 1) // 64
    value = F.shiftrightunsigned(words[last], 64 * (last + 1) - end)
    if first < last:
        value = F.shiftleft(words[first], end - 64 * last).bitwiseOR(value)
    return value.bitwiseAND(F.lit((1 << (end - begin)) - 1))


def radius_search(queries: DataFrame, table: DataFrame, radius: int = RADIUS, *, bits: int = BITS, fp_col: str = "fingerprint") -> DataFrame:
    """(query_fp, found_fp, distance): for each distinct fingerprint of ``queries`` all distinct ones of ``table`` within ``radius``."""
    if bits % 64:
        raise ValueError("fingerprints are of whole words of 64 bits")
    n = bits // 64
    cuts, errors = blocks(bits, radius)

    def keyed(df: DataFrame, side: str, most: int) -> DataFrame:
        """A fingerprint's words with the keys of all its blocks, each with up to ``most`` bits turned."""
        own = df.filter(F.col(fp_col).isNotNull()).select(F.col(fp_col).alias("fp")).distinct()
        own = own.select(*[F.conv(F.substring("fp", 16 * k + 1, 16), 16, -10).cast("long").alias(f"{side}{k}") for k in range(n)])
        keys = []
        for b, (begin, end) in enumerate(cuts):
            value = _cut([F.col(f"{side}{k}") for k in range(n)], begin, end)
            turned = [sum(1 << k for k in ks) | b << 32 for e in range(most + 1) for ks in combinations(range(end - begin), e)]
            keys.append(F.transform(F.lit(turned).cast("array<long>"), value.bitwiseXOR))
        return own.select("*", F.explode(F.concat(*keys)).alias("key"))

    # Sorted on both sides: the planner takes the many keys of few fingerprints for a small table to broadcast.
    met = keyed(queries, "q", errors).hint("merge").join(keyed(table, "t", 0), "key")
    differing = [F.col(f"q{k}").bitwiseXOR(F.col(f"t{k}")) for k in range(n)]
    apart = sum((F.bit_count(d) for d in differing[1:]), F.bit_count(differing[0]))
    # A pair that meets in several blocks is taken from the first of them.
    first = F.coalesce(*[F.when(F.bit_count(_cut(differing, *cut)) <= errors, F.lit(b)) for b, cut in enumerate(cuts)])
    found = met.withColumn("distance", apart).filter(F.col("distance") <= radius).filter(first == F.shiftright("key", 32))
    whole = lambda side: F.lower(F.concat(*[F.lpad(F.hex(f"{side}{k}"), 16, "0") for k in range(n)]))
    return found.select(whole("q").alias("query_fp"), whole("t").alias("found_fp"), "distance")

"""MinHash near-dedup: a multi-index Hamming join over b-bit signatures.

A document's set is its distinct 5-word shingles; equal sets form a class,
stood for by its smallest id.  A class has ``PARTS`` minhashes of 16 bits.  Two
sets of similarity J differ in about ``(1 - J) * PARTS`` of them; the threshold
``MOST`` leaves out a pair at J = 0.75 about once in a million.  Signatures are
split into ``CHUNKS`` chunks of four.  By pigeonhole two signatures that differ
in ``MOST < 2 * CHUNKS`` places at most have a chunk with one error at most, so
enumerating for each chunk which of its four places may be wrong gives
``4 * CHUNKS`` keys, and every pair under the threshold shares one of them.

Buckets of equal keys are worked off without writing out all their pairs:

1. Each class meets the smallest class of the bucket it shares most keys with.
   Links that hold on the full sets make first components.
2. A bucket inside one component is done.  In others, up to ``BUCKET`` classes,
   pairs from different components are compared where they lie.  A pair under
   the threshold leaves the task from the first of its keys only, and only if
   its odd sketches, parities of the sets' members in ``ODD`` cells, allow the
   similarity: their difference counts the sets' symmetric difference closely,
   and the bound leaves out a linked pair less than once in a billion.
3. Larger mixed buckets come from passages that many documents share.  Their
   classes are joined again, exactly, by the prefix filter: sorted by how rare
   they are, the first quarter and one of their shingles must meet.  Any order
   is exact; rarity comes from a table of ``COUNTERS`` counters summed over all
   these classes, and a shingle whose counter is 1 is nobody else's.  Lists of
   any length are dealt in blocks, and a pair counts under the smallest of the
   first shingles that both have.
4. All pairs found are confirmed on the full sets, and components are joined.

Defined results: a null or blank text has no shingles and no links; fewer than
five words are one shingle; rows that repeat an id are one document, linked by
any of their texts; rows without an id have no component and are kept; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.llm.components import components
from stemma.llm.words import gram_hashes, mix64, word_hashes, words
from stemma.plans.storage import broadcast_if_small, materialise, small_batches

SHINGLE, PARTS, CHUNKS, MOST = 5, 96, 24, 47
#: Cells of an odd sketch, and deviations by which it may exceed what a linked pair has on average.
ODD, ODD_SLACK = 2048, 6.5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Largest bucket compared by signature key, rows of a block of a longer list, ids that may be broadcast.
BUCKET, BLOCK, SMALL = 200, 20_000, 500_000
#: First shingles that go with a class to tell under which of them its pairs count; pairs of longer ones may repeat.
LISTED = 256
#: Counters of the rarity table, one byte each; its size does not depend on the data.
COUNTERS = 2**22

_RNG = np.random.default_rng(20_240_501)
_A = _RNG.integers(0, 2**63, PARTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, PARTS, dtype=np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles."""
    hashes = word_hashes(words(text))
    return np.unique(gram_hashes(hashes, min(SHINGLE, max(1, len(hashes)))))


def signature(found: np.ndarray) -> np.ndarray:
    """``PARTS`` minhashes of a set that is not empty, 16 bits of each."""
    low = np.full(PARTS, np.iinfo(np.uint64).max)
    for at in range(0, len(found), 2048):
        low = np.minimum(low, (found[at : at + 2048, None] * _A + _B).min(axis=0))
    return (mix64(low) >> np.uint64(48)).astype("<u2")


def keys(signatures: np.ndarray) -> np.ndarray:
    """(n, 4 * CHUNKS) keys: each chunk of four places without one of them."""
    wide = signatures.astype(np.uint64).reshape(-1, CHUNKS, 4)
    out = np.empty((len(wide), CHUNKS, 4), np.uint64)
    number = np.arange(CHUNKS, dtype=np.uint64) * np.uint64(4)
    for wrong in range(4):
        a, b, c = (wide[:, :, k] for k in range(4) if k != wrong)
        packed = (a << np.uint64(32)) | (b << np.uint64(16)) | c
        out[:, :, wrong] = mix64(packed + mix64(number + np.uint64(wrong + 1)))
    return out.reshape(len(wide), -1)


def odd_sketch(found: np.ndarray) -> np.ndarray:
    """Parities of how many members fall in each of ``ODD`` cells."""
    cells = np.bincount((found >> np.uint64(40)).astype(np.int64) % ODD, minlength=ODD)
    return np.packbits((cells & 1).astype(np.uint8))


def odd_limit(sizes: np.ndarray) -> np.ndarray:
    """Most cells in which the odd sketches of a linked pair differ, from the sum of its sets' sizes."""
    apart = np.floor(sizes * (100 - PERCENT) / (100 + PERCENT))
    a, b = (1 - 2 / ODD) ** apart, (1 - 4 / ODD) ** apart
    variance = (ODD * (1 - a * a) + ODD * (ODD - 1) * (b - a * a)) / 4
    return ODD * (1 - a) / 2 + ODD_SLACK * np.sqrt(np.maximum(variance, 0)) + 2


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted sets meet the similarity."""
    if not len(a) or not len(b):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _signed(batches):
    for batch in batches:
        ids, counts, classes, signatures = batch.column(0), [], [], []
        for text in batch.column(1):
            found = shingles(text.as_py())
            counts.append(len(found))
            classes.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
            signatures.append(signature(found).tobytes() + odd_sketch(found).tobytes() if len(found) else None)
        yield pa.RecordBatch.from_arrays([ids, pa.array(counts, pa.int64()), pa.array(classes, pa.binary()), pa.array(signatures, pa.binary())], ["row_id", "n_shingles", "cls", "sig"])


def _stacked(column) -> tuple[np.ndarray, np.ndarray]:
    """Signatures and odd sketches as matrices."""
    both = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 2 * PARTS + ODD // 8)
    return np.ascontiguousarray(both[:, : 2 * PARTS]).view("<u2"), np.ascontiguousarray(both[:, 2 * PARTS :]).view(np.uint64)


def _keyed(batches):
    for batch in batches:
        if batch.num_rows:
            own = keys(_stacked(batch.column(1))[0]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(own.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), own.shape[1]))], ["key", "rep"])


def _sets(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())], ["rep", "grams"])


def _confirmed(batches):
    """Pairs whose full sets are similar enough."""
    for batch in batches:
        a, b, left, right = (batch.column(k) for k in range(4))
        of = lambda x: np.frombuffer(x.as_py(), np.uint64)
        good = pa.array([linked(of(x), of(y)) for x, y in zip(left, right, strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([a.filter(good), b.filter(good)], ["a", "b"])


def _first_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each pair of signatures the first key that both have."""
    wrong = (a != b).reshape(-1, CHUNKS, 4)
    chunk = (wrong.sum(axis=2) <= 1).argmax(axis=1)
    rows = np.arange(len(a))
    return keys(a)[rows, chunk * 4 + wrong[rows, chunk].argmax(axis=1)].view(np.int64)


def _compared(by_signature: bool):
    """Pairs in a run of equal keys, from different components, whose sizes and sketches may be similar enough.

    Rows come sorted by key and size, so a row's partners end where the sizes
    are too far apart.  In a bucket of which this task has the blocks ``side``
    and another, only pairs across them count.  With ``by_signature``
    the keys are those of ``keys``, and a pair counts under its first one;
    otherwise they are shingles, of which ``own`` lists those of a class.
    """
    names = ("key", "rep", "root", "n_shingles", "cross", "side")

    def least_shared(x, i, j):
        sets = {}

        def of(k):
            if k not in sets:
                own = x["own"][k]
                sets[k] = None if own is None else frozenset(own.tolist())
            return sets[k]

        return np.array([of(a) is None or of(b) is None or min(of(a) & of(b)) == key for a, b, key in zip(i.tolist(), j.tolist(), x["shingle"][i].tolist(), strict=True)], bool)

    def pairs(x):
        found = [np.zeros((0, 2), np.int64)]
        for d in range(1, len(x["key"])):
            i = np.flatnonzero(x["key"][d:] == x["key"][:-d])
            if not len(i):
                break
            j = i + d
            close = 100 * x["n_shingles"][i] >= PERCENT * x["n_shingles"][j]
            i, j = i[close], j[close]
            if not len(i):
                break
            may = (x["root"][i] != x["root"][j]) & (~x["cross"][i] | (x["side"][i] != x["side"][j]))
            i, j = i[may], j[may]
            odd = np.bitwise_count(x["odd"][i] ^ x["odd"][j]).sum(axis=1, dtype=np.int64) <= odd_limit(x["n_shingles"][i] + x["n_shingles"][j])
            i, j = i[odd], j[odd]
            near = (x["sig"][i] != x["sig"][j]).sum(axis=1) <= MOST
            i, j = i[near], j[near]
            if by_signature and len(i):
                first = _first_key(x["sig"][i], x["sig"][j]) == x["key"][i]
                i, j = i[first], j[first]
            if not by_signature and len(i):
                first = least_shared(x, i, j)
                i, j = i[first], j[first]
            found.append(np.stack([np.minimum(x["rep"][i], x["rep"][j]), np.maximum(x["rep"][i], x["rep"][j])], axis=1))
        once = np.unique(np.concatenate(found), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(once[:, 0]), pa.array(once[:, 1])], ["a", "b"])

    def run(batches):
        held: dict[str, np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = {n: batch.column(k).to_numpy(zero_copy_only=False) for k, n in enumerate(names)}
            rows["sig"], rows["odd"] = _stacked(batch.column(len(names)))
            if not by_signature:
                rows["shingle"] = batch.column(len(names) + 1).to_numpy()
                rows["own"] = np.empty(batch.num_rows, object)
                rows["own"][:] = [v.values.to_numpy() if v.is_valid else None for v in batch.column(len(names) + 2)]
            held = rows if held is None else {n: np.concatenate([held[n], v]) for n, v in rows.items()}
            last = int(np.searchsorted(held["key"], held["key"][-1]))  # where the run that may go on begins
            if last:
                yield pairs({n: v[:last] for n, v in held.items()})
                held = {n: v[last:] for n, v in held.items()}
        if held is not None:
            yield pairs(held)

    return run


def _candidates(buckets: DataFrame, classes: DataFrame, by_signature: bool) -> DataFrame:
    """Distinct (a, b) from buckets (key, rep, root, n) by comparing signatures inside each; classes of shingle lists also have ``own``."""
    more = [] if by_signature else ["shingle", "own"]
    buckets = buckets if by_signature else buckets.withColumn("shingle", F.col("key"))
    dealt = buckets.withColumn("parts", F.ceil(F.col("n") / BLOCK)).withColumn("side", F.pmod(F.xxhash64("rep"), F.col("parts")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = dealt.withColumn("cross", F.col("side") != F.col("other")).withColumn(
        "key", F.when(F.col("parts") > 1, F.xxhash64("key", F.least("side", "other"), F.greatest("side", "other"))).otherwise(F.col("key"))
    )
    full = dealt.join(classes, "rep").select("key", "rep", "root", "n_shingles", "cross", "side", "sig", *more)
    return full.repartition("key").sortWithinPartitions("key", "n_shingles").mapInArrow(_compared(by_signature), "a long, b long").distinct()


def _confirm(pairs: DataFrame, texts: DataFrame, members: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked, by the full sets of all texts of either class's id."""
    pairs = materialise(pairs, "pairs")
    wanted = materialise(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "wanted")
    sets = materialise(texts.join(broadcast_if_small(wanted, SMALL), F.col("row_id") == F.col("rep"), "left_semi").mapInArrow(_sets, "rep long, grams binary"), "sets")
    left = sets.select(F.col("rep").alias("a"), F.col("grams").alias("left_grams"))
    right = sets.select(F.col("rep").alias("b"), F.col("grams").alias("right_grams"))
    full = pairs.join(left, "a").join(right, "b").select("a", "b", "left_grams", "right_grams")
    return materialise(full.mapInArrow(_confirmed, "a long, b long"), "links")


def _mixed(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """Buckets (key, rep, n) with each class's component, where they hold more than one."""
    rooted = buckets.join(roots.withColumnRenamed("v", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("least_root"), F.max("root").alias("greatest_root")).filter("least_root <> greatest_root").select("key")
    return rooted.join(mixed, "key", "left_semi")


def _cells(grams: np.ndarray) -> np.ndarray:
    return ((grams >> np.uint64(20)) % np.uint64(COUNTERS)).astype(np.int64)


def _sparse(table: np.ndarray) -> pa.RecordBatch:
    """A table of counters as one row: the places that count something, and their counts up to 255."""
    at = np.flatnonzero(table)
    return pa.RecordBatch.from_arrays([pa.array([at.astype("<u4").tobytes()], pa.binary()), pa.array([np.minimum(table[at], 255).astype(np.uint8).tobytes()], pa.binary())], ["cells", "counts"])


def _tallied(batches):
    table = np.zeros(COUNTERS, np.uint32)
    for batch in batches:
        for own in batch.column(0):
            table[_cells(np.frombuffer(own.as_py(), np.uint64))] += 1
    yield _sparse(table)


def _summed(batches):
    table = np.zeros(COUNTERS, np.uint32)
    for batch in batches:
        for cells, counts in zip(batch.column(0), batch.column(1), strict=True):
            table[np.frombuffer(cells.as_py(), "<u4")] += np.frombuffer(counts.as_py(), np.uint8)
    yield _sparse(table)


def _prefixes(hot: DataFrame, texts: DataFrame) -> DataFrame:
    """(rep, front): the first quarter and one of each class's shingles in the order of rarity, as one sorted list.

    Shingles that no other class has are left out: they are nobody's partner.
    """
    sets = materialise(texts.join(broadcast_if_small(hot, SMALL), F.col("row_id") == F.col("rep"), "left_semi").mapInArrow(_sets, "rep long, grams binary"), "hot_sets")
    schema = "cells binary, counts binary"
    tallies = sets.select("grams").mapInArrow(_tallied, schema)
    some = int(tallies.sparkSession.conf.get("spark.sql.shuffle.partitions")) ** 0.5
    # One row of bounded size is left, whatever the input.
    total = tallies.repartition(max(1, round(some))).mapInArrow(_summed, schema).repartition(1).mapInArrow(_summed, schema).first()
    table = np.zeros(COUNTERS, np.uint8)
    table[np.frombuffer(total["cells"], "<u4")] = np.frombuffer(total["counts"], np.uint8)

    def fronts(batches):
        for batch in batches:
            reps, found = [], []
            for rep, own in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                grams = np.frombuffer(own.as_py(), np.uint64)
                if not len(grams):
                    continue
                rarity = table[_cells(grams)]
                # Sets of similarity p share a shingle among the first n - ceil(p * n) + 1 of either in a common order.
                first = np.lexsort((grams, rarity))[: len(grams) - -(-len(grams) * PERCENT // 100) + 1]
                reps.append(rep)
                found.append(np.sort(grams[first[rarity[first] > 1]].view(np.int64)))
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *found])))
            yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), lists], ["rep", "front"])

    return sets.mapInArrow(fronts, "rep long, front array<long>")


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_id, n_shingles, component_id, kept) for every row."""
    with small_batches(df.sparkSession):
        return _near_duplicates(df, id_col, text_col)


def _near_duplicates(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    texts = df.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).alias("text"))
    rows = materialise(texts.mapInArrow(_signed, "row_id long, n_shingles long, cls binary, sig binary"), "signatures")
    members = rows.filter("row_id IS NOT NULL AND cls IS NOT NULL").groupBy("cls").agg(F.min(F.struct("row_id", "n_shingles", "sig")).alias("m"))
    members = materialise(members.select("cls", F.col("m.row_id").alias("rep"), F.col("m.n_shingles").alias("n_shingles"), F.col("m.sig").alias("sig")), "classes")
    classes = members.select("rep", "n_shingles", "sig")

    keyed = classes.select("rep", "sig").mapInArrow(_keyed, "key long, rep long")
    shared = keyed.groupBy("key").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    buckets = materialise(keyed.join(shared, "key"), "buckets")

    votes = buckets.filter("rep <> hub").groupBy("rep", "hub").agg(F.count(F.lit(1)).alias("votes"))
    stars = votes.groupBy("rep").agg(F.max(F.struct("votes", (-F.col("hub")).alias("hub"))).alias("best"))
    # Rows that repeat an id are one document: their classes' ids are linked before all others.
    repeats = rows.filter("cls IS NOT NULL").join(members.select("cls", "rep"), "cls").filter("rep <> row_id").select(F.col("rep").alias("a"), F.col("row_id").alias("b"))
    several = rows.filter("row_id IS NOT NULL AND cls IS NOT NULL").groupBy("row_id").agg(F.min("cls").alias("c1"), F.max("cls").alias("c2")).filter("c1 <> c2").select("row_id")
    ties = repeats.join(several, F.col("b") == F.col("row_id"), "left_semi")
    links = _confirm(stars.select((-F.col("best.hub")).alias("a"), F.col("rep").alias("b")), texts, members).unionByName(ties)
    roots = components(links)

    mixed = materialise(_mixed(buckets.select("key", "rep", "n"), roots), "mixed")
    near = _candidates(mixed.filter(F.col("n") <= BUCKET), classes, by_signature=True)
    hot = materialise(mixed.filter(F.col("n") > BUCKET).select("rep").distinct(), "hot")
    if not hot.isEmpty():
        fronts = materialise(_prefixes(hot, texts), "fronts")
        prefixes = fronts.select("rep", F.explode("front").alias("key"))
        lists = prefixes.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        listed = classes.join(fronts.select("rep", F.when(F.size("front") <= LISTED, F.col("front")).alias("own")), "rep")
        near = near.unionByName(_candidates(_mixed(prefixes.join(lists, "key"), roots), listed, by_signature=False)).distinct()
    more = _confirm(near, texts, members)
    if not more.isEmpty():
        roots = components(roots.select(F.col("v").alias("a"), F.col("root").alias("b")).unionByName(more))

    of_class = members.select("cls", "rep").join(roots.withColumnRenamed("v", "rep"), "rep", "left").select("cls", F.coalesce("root", "rep").alias("root"))
    own = rows.select("row_id", "n_shingles", "cls").join(of_class, "cls", "left")
    component = F.when(F.col("row_id").isNotNull(), F.coalesce("root", "row_id"))
    return own.select("row_id", "n_shingles", component.alias("component_id"), F.col("row_id").eqNullSafe(component).alias("kept"))

"""Maximum inner product search with score-aware anisotropic quantisation.

Vectors are split into subspaces of two dimensions with 16 codewords each, four
bits for a subspace.  Codes are chosen to keep inner products with likely
queries, not distances: of the residual, the part parallel to the vector moves
the scores of its own best queries, so its square weighs ``eta`` times that of
the orthogonal part.  Codewords are trained on a bounded sample by alternating
two steps: coordinate descent over each vector's codes under that loss, and
the loss's exact least-squares solution for each codeword.

Every row is indexed, with two codes in a byte.  A search walks over the codes in
blocks: for a query, two neighbouring subspaces' tables add up to one table of
256 entries, a byte's, and a vector's score is a sum of table entries.  The best ``keep`` distinct codes of a
block by these scores are chosen, all their vectors are scored again in double
precision, each distinct one once, and only the nearest ``k`` rows of each block
leave the task: however many copies a vector has, it takes one place.

Queries are searched in rounds of ``ROUND_BYTES`` of tables at most, so what a
round sends to the tasks has a fixed size, whatever the vectors' length.

Defined results: null, zero, or partly null or non-finite vectors and rows
without an id take no part, nor do vectors whose length is not the most common
one (the smaller on a tie); a row is no candidate for its own id; an id that
repeats is found once, with its best score, and asked once, with its smallest
vector; ties go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemma.plans.storage import gathered, materialise

#: Dimensions of a subspace, codewords, training rows, training rounds and the weight of parallel residuals.
SUB, WORDS, SAMPLE, ROUNDS, ETA = 2, 16, 8192, 6, 4.0
#: Distinct codes reranked in each block for each query, rows of a block, queries of a round and bytes of their vectors and tables.
KEEP, BLOCK, ROUND, ROUND_BYTES = 200, 32_768, 4096, 2**24


def _loss_codes(x: np.ndarray, books: np.ndarray, eta: float, passes: int = 2) -> np.ndarray:
    """Codes of rows ``x`` (n, d) by coordinate descent under the anisotropic loss."""
    n, parts = len(x), len(books)
    split = x.reshape(n, parts, SUB)
    norm = np.maximum((x * x).sum(axis=1), 1e-30)
    error = np.empty((parts, n, WORDS))  # squared residual of each choice
    along = np.empty((parts, n, WORDS))  # its component along the vector, times its norm
    for s in range(parts):
        rest = split[:, s, None, :] - books[s][None]
        error[s], along[s] = (rest * rest).sum(axis=2), (rest * split[:, s, None, :]).sum(axis=2)
    codes = error.argmin(axis=2).T.copy()
    rows = np.arange(n)
    total = along[np.arange(parts)[:, None], rows[None], codes.T].sum(axis=0)
    for _ in range(passes):
        for s in range(parts):
            others = total - along[s, rows, codes[:, s]]
            # |r|^2 + (eta - 1) * <r, x>^2 / |x|^2 for every choice here.
            cost = error[s] + (eta - 1) * (others[:, None] + along[s]) ** 2 / norm[:, None]
            codes[:, s] = cost.argmin(axis=1)
            total = others + along[s, rows, codes[:, s]]
    return codes.astype(np.uint8)


def train(x: np.ndarray, *, eta: float = ETA, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """Codebooks (subspaces, WORDS, SUB) from sample rows (n, d), d a multiple of SUB."""
    rng = np.random.default_rng(seed)
    n, parts = len(x), x.shape[1] // SUB
    split = x.reshape(n, parts, SUB)
    books = np.stack([split[rng.choice(n, WORDS, replace=n < WORDS), s] for s in range(parts)])
    norm = np.maximum((x * x).sum(axis=1), 1e-30)
    for _ in range(rounds):
        codes = _loss_codes(x, books, eta)
        decoded = np.concatenate([books[s][codes[:, s]] for s in range(parts)], axis=1)
        for s in range(parts):
            own = split[:, s]
            # What the other subspaces leave along the vector.
            rest = x - decoded
            elsewhere = (rest * x).sum(axis=1) - ((own - decoded[:, s * SUB : (s + 1) * SUB]) * own).sum(axis=1)
            weight = (eta - 1) / norm
            for c in range(WORDS):
                mine = codes[:, s] == c
                if mine.any():
                    v, w = own[mine], weight[mine]
                    # Minimise sum |v - b|^2 + w * (e + <v - b, v>)^2 over b.
                    left = mine.sum() * np.eye(SUB) + (w[:, None, None] * v[:, :, None] * v[:, None, :]).sum(axis=0)
                    right = v.sum(axis=0) + (w * (elsewhere[mine] + (v * v).sum(axis=1)))[:, None].T @ v
                    books[s, c] = np.linalg.solve(left, right.ravel())
            decoded[:, s * SUB : (s + 1) * SUB] = books[s][codes[:, s]]
    return books


class Index:
    """Codebooks and the table of coded rows (vec_id, embedding, codes)."""

    def __init__(self, rows: DataFrame, dim: int, books: np.ndarray | None):
        self.rows, self.dim, self.books = rows, dim, books


def valid_vectors(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, embedding) of rows that take part; floats stay floats, other numbers are doubles."""
    kind = "array<float>" if dict(df.dtypes)[vector_col] == "array<float>" else "array<double>"
    rows = df.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("embedding")
    )
    sound = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return rows.filter(F.coalesce(sound, F.lit(False)) & F.exists("embedding", lambda v: v != 0))


def _padded(column, dim: int) -> np.ndarray:
    """Vectors as rows, with a zero behind those of odd length."""
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
    return np.pad(flat, ((0, 0), (0, -dim % SUB)))


def packed(codes: np.ndarray) -> np.ndarray:
    """Codes of four bits (n, subspaces), two in a byte, the first one high."""
    if codes.shape[1] % 2:
        codes = np.pad(codes, ((0, 0), (0, 1)))
    return codes[:, 0::2] << 4 | codes[:, 1::2]


def build(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, eta: float = ETA) -> Index:
    """Train on at most ``sample`` rows, chosen by the hash of their id, and code every row."""
    sound = valid_vectors(df, id_col=id_col, vector_col=vector_col)
    commonest = sound.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if commonest is None:
        return Index(sound.withColumn("codes", F.lit(b"")), 0, None)
    dim = commonest["dim"]
    sound = sound.filter(F.size("embedding") == dim)
    picked = sound.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(sample).select("embedding").toArrow()
    books = train(_padded(picked.column(0).combine_chunks(), dim), eta=eta)

    def coded(batches):
        for batch in batches:
            x = _padded(batch.column(1), dim)
            codes = [packed(_loss_codes(x[at : at + 4096], books, eta)) for at in range(0, len(x), 4096)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for part in codes for c in part], pa.binary())], ["vec_id", "embedding", "codes"])

    return Index(materialise(sound.mapInArrow(coded, f"vec_id long, embedding {dict(sound.dtypes)['embedding']}, codes binary"), "codes"), dim, books)


def _groups(rows: np.ndarray) -> np.ndarray:
    """A number for each row, the same for equal rows; groups are numbered in the order of their first rows."""
    whole = np.ascontiguousarray(rows).view(np.dtype((np.void, rows.shape[1] * rows.itemsize))).ravel()
    _, first, group = np.unique(whole, return_index=True, return_inverse=True)
    place = np.empty(len(first), np.int64)
    place[np.argsort(first)] = np.arange(len(first))
    return place[group.ravel()]


def _starts(ordered: np.ndarray) -> np.ndarray:
    """Where each group begins in ordered group numbers, and their length."""
    return np.searchsorted(ordered, np.arange(ordered[-1] + 2))


def _members(starts: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The places of all members of the chosen groups, one group after another."""
    sizes = starts[chosen + 1] - starts[chosen]
    return np.repeat(starts[chosen] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def _nearest(index: Index, ids: np.ndarray, queries: np.ndarray, k: int, keep: int):
    """A scan over coded rows that yields each query's nearest ``k`` of every block."""
    dim, books = index.dim, index.books
    parts = len(books)

    def scan(batches):
        padded = np.pad(queries, ((0, 0), (0, -dim % SUB)))
        tables = np.einsum("qsd,swd->qsw", padded.reshape(len(queries), parts, SUB), books).astype(np.float32)
        if parts % 2:
            tables = np.concatenate([tables, np.zeros((len(queries), 1, WORDS), np.float32)], axis=1)

        def block(rows):
            found = pa.Table.from_batches(rows).combine_chunks().sort_by("vec_id")
            own = found.column("vec_id").to_numpy()
            # Zeros of either sign are one value.
            exact = np.asarray(found.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(len(own), dim) + np.float32(0)
            codes = np.frombuffer(b"".join(found.column("codes").to_pylist()), np.uint8).reshape(len(own), -(-parts // 2))
            # Equal vectors are one: its smallest ids are all that a search can take of it.
            vector = _groups(exact)
            order = np.lexsort((own, vector))
            new = np.ones(len(own), bool)
            new[1:] = (vector[order][1:] != vector[order][:-1]) | (own[order][1:] != own[order][:-1])
            order = order[new]
            starts = _starts(vector[order])
            order = order[np.arange(len(order)) - starts[vector[order]] <= k]
            ids_of, id_at = own[order], _starts(vector[order])
            exact, codes = exact[order[id_at[:-1]]], codes[order[id_at[:-1]]]
            # Vectors of equal codes have equal approximate scores: they are chosen together.
            code = _groups(codes)
            vectors_of, vector_at = np.argsort(code, kind="stable"), _starts(np.sort(code))
            codes = codes[vectors_of[vector_at[:-1]]]
            joint = codes.T.astype(np.intp)
            out = ([], [], [])
            for q in range(len(ids)):
                # One table for each two subspaces: high four bits from the first.
                pairs = (tables[q, 0::2, :, None] + tables[q, 1::2, None, :]).reshape(-1, WORDS * WORDS)
                scores = pairs[0].take(joint[0])
                for s in range(1, len(joint)):
                    scores += pairs[s].take(joint[s])
                # One more than ``keep``, as the query's own code may be among them.
                if len(scores) > keep + 1:
                    least = np.partition(scores, len(scores) - keep - 1)[len(scores) - keep - 1]
                    above = np.flatnonzero(scores > least)
                    chosen = np.concatenate([above, np.flatnonzero(scores == least)[: keep + 1 - len(above)]])
                else:
                    chosen = np.arange(len(scores))
                chosen = vectors_of[_members(vector_at, chosen)]
                # Summed once for each vector, so equal ones tie exactly.
                real = (exact[chosen].astype(np.float64) * queries[q]).sum(axis=1)
                found_ids, real = ids_of[_members(id_at, chosen)], np.repeat(real, np.diff(id_at)[chosen])
                others = found_ids != ids[q]
                found_ids, real = found_ids[others], real[others]
                order = np.lexsort((found_ids, -real))
                _, firsts = np.unique(found_ids[order], return_index=True)
                best = order[np.sort(firsts)][:k]
                out[0].append(np.full(len(best), ids[q]))
                out[1].append(found_ids[best])
                out[2].append(real[best])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], ["query_id", "vec_id", "score"])

        held, rows = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                if rows and rows + part.num_rows > BLOCK:
                    yield block(held)
                    held, rows = [], 0
                held.append(part)
                rows += part.num_rows
        if rows:
            yield block(held)

    return scan


def search(index: Index, queries: DataFrame, k: int = 20, *, id_col: str = "vec_id", vector_col: str = "embedding", keep: int = KEEP, per_round: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest other rows found for each query, nearest first."""
    spark = index.rows.sparkSession
    schema = "query_id long, vec_id long, score double"
    if index.books is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = valid_vectors(queries, id_col=id_col, vector_col=vector_col).filter(F.size("embedding") == index.dim)
    asked = materialise(asked.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "asked")
    if per_round is None:
        per_round = max(1, min(ROUND, ROUND_BYTES // (8 * index.dim + 4 * WORDS * len(index.books))))
    rounds = -(-asked.count() // per_round)

    def scans():
        for n in range(rounds):
            part = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(rounds)) == n).orderBy("vec_id").toArrow()
            if part.num_rows:
                vectors = np.asarray(part.column("embedding").combine_chunks().flatten().to_numpy(), np.float64).reshape(-1, index.dim)
                yield index.rows.mapInArrow(_nearest(index, part.column("vec_id").to_numpy(), vectors, k, keep), schema)

    found = gathered(scans(), "nearest")
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

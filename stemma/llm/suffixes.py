"""Repeated passages across documents, by sparse suffix arrays.

Of each document only the suffixes at content-selected positions are kept: in
every run of ``WINDOW`` positions the one whose 8-word gram hashes lowest, so
equal passages select equal positions wherever they stand.  A passage of
``LEAST`` words has such a position early enough that ``HEAD`` words of it
follow.  Suffixes are sorted by these words themselves, and neighbours are
compared: those that agree in ``HEAD`` words with a neighbour of another
document are hits.

Each hit is then extended to the left and right: a match of ``LEAST`` words
around it starts at one of the ``WINDOW`` places up to the hit.  The suffixes at
these places are sorted in the same way, by a 128-bit digest of their first
``LEAST`` words' bytes, and again neighbours are compared; places that follow
each other merge into spans.  So a span is exactly a maximal run of words each
of which lies in a stretch of ``LEAST`` words that another document also has.

Both sorts deal rows by ranges of (key, document, position), so that a passage
that stands everywhere is dealt over many tasks and nothing is joined by it.  A
run of equal keys that a range's end cuts is told by one small table: each range
has two such runs at most.

Texts that are equal, by SHA-256, form a class, and only the one with the
smallest id is extended: it and its copies are one span each, from end to end.

Words are split at ASCII white space and compared as they are, but for A-Z in
lower case.  Defined results: null and short texts have no spans; rows without
an id take no part; rows that repeat an id are one document and are no
repetition of each other, and their spans name the text by ``text_tag``, which
is 0 where an id has one text only; further columns are ignored, or kept by
``cut_repeats``; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemma.llm.words import gram_hashes, word_hashes, words
from stemma.plans.storage import discard, join_counted, materialise, small_batches

#: Words of the shortest passage, of a suffix's head and of the grams that select positions.
LEAST, HEAD, GRAM = 50, 10, 8
#: Positions of which one is selected: any passage of LEAST words then holds a selected head.
WINDOW = LEAST - HEAD + 1
#: Documents, and hits in all of them (four bytes each), that may be broadcast.
SMALL, SMALL_HITS = 200_000, 4_000_000
_WORD = re.compile(rb"[^ \t-\r]+")


def positions(hashes: np.ndarray) -> np.ndarray:
    """Selected positions whose heads lie in the text; none in texts shorter than a passage."""
    if len(hashes) < LEAST:
        return np.zeros(0, np.int64)
    grams = gram_hashes(hashes, GRAM)
    lowest = np.lib.stride_tricks.sliding_window_view(grams, WINDOW).argmin(axis=1)
    found = np.unique(lowest + np.arange(len(lowest)))
    return found[found <= len(hashes) - HEAD]


def runs_of(found: list[bytes], at: np.ndarray, size: int) -> list[bytes]:
    """The words from each place on, ``size`` of them, joined by spaces."""
    text, ends = b" ".join(found), np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate([[0], ends])[at].tolist()
    return [text[a:b] for a, b in zip(starts, (ends[at + size - 1] - 1).tolist(), strict=True)]


def text_digest(text: str) -> bytes:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()


def _tag(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big", signed=True) or 1


def _suffixes(batches):
    """Heads of the selected suffixes; and for each text its digest, with the number of its words below zero."""
    for batch in batches:
        keys, ids, places = [], [], []
        for row_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py()
            found = words(text)
            if len(found) < LEAST:
                continue
            at = positions(word_hashes(found))
            keys += [*runs_of(found, at, HEAD), text_digest(text)]
            ids += [row_id] * (len(at) + 1)
            places += [*at.tolist(), -len(found)]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64()), pa.array(places, pa.int32())], ["key", "row_id", "pos"])


def _neighbours(batches):
    """The rows of keys that stand in more than one document, from rows sorted by (key, row_id), with ``first_id``.

    ``first_id`` is the key's smallest id and the key itself is dropped.  The
    first run of a task's range may have begun in an earlier one, and the last
    may go on in a later one: rows of the first, and those of the last if only
    one document has them so far, keep their key and have no ``first_id``.  A
    last run that is told stands for itself in two rows with place -1.
    """
    key = first = last = None
    opening, told, held, out = True, False, [], []

    def put(rows: pa.RecordBatch, firsts=None, names=None):
        keys = rows.column(0) if firsts is None else pa.nulls(rows.num_rows, pa.binary())
        ids = pa.nulls(rows.num_rows, pa.int64()) if firsts is None else pa.array(firsts, pa.int64())
        out.append(pa.RecordBatch.from_arrays([keys, *rows.columns[1:], ids], [*rows.schema.names, "first_id"]))

    def more(rows: pa.RecordBatch, ids: np.ndarray):
        """Further rows of the run at hand."""
        nonlocal first, last, told
        first, last = ids[0] if first is None else first, ids[-1]
        if opening:
            put(rows)
            return
        held.append(rows)
        if told := first != last:
            for part in held:
                put(part, np.full(part.num_rows, first))
            held.clear()

    end = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, ids = batch.column(0), batch.column(1).to_numpy()
        begins = np.ones(len(ids), bool)
        begins[1:] = pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
        begins[0] = key is None or keys[0].as_py() != key
        starts = np.flatnonzero(begins)
        goes_on = int(starts[0]) if len(starts) else len(ids)
        if goes_on:
            more(batch.slice(0, goes_on), ids[:goes_on])
        if len(starts):
            if key is not None:
                opening = False
            held.clear()
            # Whole runs, but for the first of the range.
            a = starts[0]
            if key is None and len(starts) > 1:
                put(batch.slice(a, starts[1] - a))
                opening, a = False, starts[1]
            z = starts[-1]
            if z > a:
                inner = starts[(starts >= a) & (starts < z)]
                sizes = np.diff(np.append(inner, z))
                shared = np.repeat(ids[inner] != ids[inner + sizes - 1], sizes)
                if shared.any():
                    put(batch.slice(a, z - a).filter(pa.array(shared)), np.repeat(ids[inner], sizes)[shared])
            key, first, told = keys[int(z)].as_py(), None, False
            more(batch.slice(z), ids[z:])
        end = batch
        if out:
            yield from out
            out.clear()
    if held:
        for part in held:
            put(part)
    elif told:
        mark = [pa.array([key, key], pa.binary()), pa.array([first, last], pa.int64()), pa.array([-1, -1], pa.int32()), *(pa.array([0, 0], c.type) for c in end.columns[3:])]
        put(pa.RecordBatch.from_arrays(mark, end.schema.names))
    yield from out


def _told(ends: dict[bytes, int]):
    """Rows that have their first document, and rows of the keys that ``ends`` has; the key goes."""

    def run(batches):
        for batch in batches:
            keys, places, firsts = batch.column(0), batch.column(2), batch.column(batch.num_columns - 1)
            if keys.null_count < len(keys):
                firsts = pa.array([f if k is None else ends.get(k) for k, f in zip(keys.to_pylist(), firsts.to_pylist(), strict=True)], pa.int64())
            kept = pc.and_(firsts.is_valid(), pc.greater_equal(places, 0))
            yield pa.RecordBatch.from_arrays([*(c.filter(kept) for c in batch.columns[1:-1]), firsts.filter(kept)], batch.schema.names[1:])

    return run


def in_several(rows: DataFrame, tag: str) -> DataFrame:
    """The rows (key, row_id, pos, ...) whose key stands in more than one document, with ``first_id`` in place of the key."""
    fields = [f"{name} {kind}" for name, kind in rows.dtypes]
    ranged = rows.repartitionByRange("key", "row_id", "pos").sortWithinPartitions("key", "row_id", "pos")
    found = materialise(ranged.mapInArrow(_neighbours, ", ".join([*fields, "first_id bigint"])), tag)
    # Keys at the ends of ranges: two for each task of the sort at most, whatever the input.
    cut = found.filter("key IS NOT NULL").groupBy("key").agg(F.min("row_id").alias("first"), F.max("row_id").alias("last"))
    ends = {bytes(r["key"]): r["first"] for r in cut.filter("first <> last").collect()}
    return found.mapInArrow(_told(ends), ", ".join([*fields[1:], "first_id bigint"]))


def _copies(marks: DataFrame, several: DataFrame) -> DataFrame:
    """(row_id, rep, n_words) of texts that a smaller id has too; ids of several rows are left to the general way."""
    classes = marks.groupBy("digest").agg(F.min("row_id").alias("rep"), F.max("row_id").alias("last"), F.count(F.lit(1)).alias("n")).filter("rep <> last")
    classes = materialise(classes.select("digest", "rep", "n").join(several.withColumnRenamed("row_id", "rep"), "rep", "left_anti"), "classes")
    members = join_counted(marks, classes, "digest", "n").filter("row_id <> rep")
    return materialise(members.join(several, "row_id", "left_anti").select("row_id", "rep", "n_words"), "copies")


def repeats(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_id, text_tag, start_word, n_words, first_id): the spans that other documents repeat.

    ``first_id`` is the smallest id of a document that shares any of the span's stretches.
    """
    with small_batches(df.sparkSession):
        return _repeats(df, id_col, text_col)


def _stretches(batches):
    """The digests of all places from which ``LEAST`` words reach over a hit."""
    for batch in batches:
        keys, ids, places, tags = [], [], [np.zeros(0, np.int64)], []
        for row_id, text, hit, tagged in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3).to_pylist(), strict=True):
            text = text.as_py()
            found = words(text)
            n = len(found) - LEAST + 1
            if n <= 0:
                continue
            at = np.asarray(hit.values.to_numpy(), np.int64)
            near = np.zeros(n + WINDOW, np.int64)
            np.add.at(near, np.clip(at - WINDOW + 1, 0, len(near) - 1), 1)
            np.add.at(near, np.clip(at + 1, 0, len(near) - 1), -1)
            here = np.flatnonzero(np.cumsum(near)[:n] > 0)
            keys += map(xxhash.xxh3_128_digest, runs_of(found, here, LEAST))
            ids += [row_id] * len(here)
            places.append(here)
            tags += [_tag(text_digest(text)) if tagged else 0] * len(here)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64()), pa.array(np.concatenate(places).astype(np.int32)), pa.array(tags, pa.int64())], ["key", "row_id", "pos", "tag"])


def _repeats(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    texts = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).alias("text"))
    several = materialise(texts.groupBy("row_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("row_id"), "several")
    suffixes = materialise(texts.mapInArrow(_suffixes, "key binary, row_id long, pos int"), "suffixes")
    marks = materialise(suffixes.filter("pos < 0").select("row_id", F.col("key").alias("digest"), (-F.col("pos")).alias("n_words")), "marks")
    copies = _copies(marks, several)
    hits = in_several(suffixes.filter("pos >= 0"), "heads")
    wanted = hits.groupBy("row_id").agg(F.collect_set("pos").alias("hits")).join(copies, "row_id", "left_anti")
    wanted = materialise(wanted.join(several.withColumn("tagged", F.lit(True)), "row_id", "left").select("row_id", "hits", F.col("tagged").isNotNull().alias("tagged")), "hits")
    discard(suffixes)
    total = wanted.agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size("hits")).alias("hits")).first()
    small = total["docs"] <= SMALL and (total["hits"] or 0) <= SMALL_HITS

    rows = texts.join(F.broadcast(wanted) if small else wanted, "row_id").mapInArrow(_stretches, "key binary, row_id long, pos int, tag long")
    rows = materialise(rows, "stretches")
    found = in_several(rows, "shared")
    # Stretches that overlap or touch make one span.
    order = Window.partitionBy("row_id", "tag").orderBy("pos")
    opens = F.coalesce(F.col("pos") - F.lag("pos").over(order) > LEAST, F.lit(True))
    spans = found.withColumn("opens", opens.cast("int")).withColumn("span", F.sum("opens").over(order))
    spans = spans.groupBy("row_id", F.col("tag").alias("text_tag"), "span").agg(
        F.min("pos").alias("start_word"), (F.max("pos") - F.min("pos") + LEAST).alias("n_words"), F.min("first_id").alias("first_id")
    ).drop("span")
    spans = materialise(spans, "spans")
    discard(rows)
    reps = copies.groupBy(F.col("rep").alias("row_id")).agg(F.max("n_words").alias("n_words"), F.count(F.lit(1)).alias("n"))
    firsts = spans.join(reps.select("row_id"), "row_id", "left_semi").groupBy("row_id").agg(F.min("first_id").alias("first_id"))
    reps = reps.join(firsts, "row_id", "left").select(F.col("row_id").alias("rep"), F.least("row_id", "first_id").alias("first_id"), "n_words", "n")
    reps = materialise(reps, "reps")
    span = [F.lit(0).cast("long").alias("text_tag"), F.lit(0).alias("start_word"), F.col("n_words").cast("int").alias("n_words"), "first_id"]
    whole = reps.select(F.col("rep").alias("row_id"), *span).unionByName(join_counted(copies.drop("n_words"), reps, "rep", "n").select("row_id", *span))
    return spans.join(reps.select(F.col("rep").alias("row_id")), "row_id", "left_anti").unionByName(whole)


def _bounds(raw: bytes) -> list[tuple[int, int]]:
    return [m.span() for m in _WORD.finditer(raw)]


def _with_spans(df: DataFrame, spans: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str, str]:
    """``df`` with its id's spans as an array of (text_tag, start_word, n_words, first_id), under a name that is free."""
    key, name = "__span_id", "__spans"
    while {key, name} & set(df.columns):
        key, name = key + "_", name + "_"
    own = spans.groupBy(F.col("row_id").alias(key)).agg(F.collect_list(F.struct("start_word", "n_words", "first_id", "text_tag")).alias(name))
    return df.join(own, F.col(id_col).cast("long") == F.col(key), "left"), key, name


def _of_text(text: str, spans: list) -> list:
    """The spans of an id that are this text's, in order."""
    tags = {s["text_tag"] for s in spans}
    own = _tag(text_digest(text)) if tags - {0} else 0
    return sorted((s for s in spans if s["text_tag"] in (0, own)), key=lambda s: s["start_word"])


def span_texts(df: DataFrame, spans: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``spans`` with the text of each, as it stands in its document; once for each row that has the text."""

    def cut(batches):
        for batch in batches:
            out = []
            for row_id, text, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if text is None:
                    continue
                raw, found = text.encode("utf-8", "surrogatepass"), None
                for s in _of_text(text, own):
                    found = found or _bounds(raw)
                    piece = raw[found[s["start_word"]][0] : found[s["start_word"] + s["n_words"] - 1][1]]
                    out.append((row_id, s["text_tag"], s["start_word"], s["n_words"], s["first_id"], piece.decode("utf-8", "surrogatepass")))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string()), strict=True)], ["row_id", "text_tag", "start_word", "n_words", "first_id", "span_text"])

    joined, _, name = _with_spans(df.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).alias("text")), spans, "row_id", "text")
    return joined.filter(F.col(name).isNotNull()).select("row_id", "text", name).mapInArrow(cut, "row_id long, text_tag long, start_word int, n_words int, first_id long, span_text string")


def cut_repeats(df: DataFrame, spans: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` without the spans that a document of smaller id has first; other rows stay as they are."""
    joined, _, name = _with_spans(df, spans.filter("first_id < row_id"), id_col, text_col)

    @F.udf("string", useArrow=True)
    def without(text, cuts):
        if text is None or not cuts:
            return text
        own, raw = _of_text(text, cuts), text.encode("utf-8", "surrogatepass")
        found, out, at = _bounds(raw) if own else [], [], 0
        for c in own:
            out.append(raw[at : found[c["start_word"]][0]])
            at = found[c["start_word"] + c["n_words"] - 1][1]
        return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")

    return joined.withColumn(text_col, without(F.col(text_col), F.col(name))).select(*df.columns)

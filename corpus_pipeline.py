"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``.  ``run`` writes each stage's result
to the shared folder and reads it back as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.llm import line_dedup, minhash, mixing, packing, quality
from stemma.llm.queries import tokenizer_path
from stemma.plans.storage import materialise, read_table


def _aside(docs: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns of an operator's own ``names`` renamed, and what they were called."""
    taken, moved = set(docs.columns), {}
    for name in names:
        if name in taken:
            other = f"own_{name}"
            while other in taken:
                other += "_"
            moved[other] = name
            taken.add(other)
    for other, name in moved.items():
        docs = docs.withColumnRenamed(name, other)
    return docs, moved


def _back(result: DataFrame, columns: list[str], moved: dict[str, str]) -> DataFrame:
    """The columns that the stage's input had, under their names."""
    own = {name: other for other, name in moved.items()}
    return result.select(*[F.col(own.get(c, c)).alias(c) for c in columns])


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the table ``labels``, accepts.

    Null and empty texts have no evidence and go by their site; copies are
    judged alike; without labels of both kinds all documents stay.  Columns
    named like the classifier's own keep their values.
    """
    plain, moved = _aside(docs, ("evidence", "site_rate", "posterior", "accepted"))
    return _back(quality.classify(plain, read_table(spark, sf_dir, "labels")).filter("accepted"), docs.columns, moved)


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that many sources repeat; documents of nothing but such lines go.

    Null and empty texts stay as they are; ``n_chars`` follows a text that
    changed; of rows without an id none is a line's first.  Columns named like
    the operator's own keep their values.
    """
    plain, moved = _aside(docs, ("n_lines", "removed_lines"))
    cleaned = line_dedup.dedup_lines(plain)
    left = cleaned.filter((F.col("removed_lines") == 0) | (F.btrim("text", F.lit(" \t\r\n")) != ""))
    sized = left.withColumn("n_chars", F.when(F.col("removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return _back(sized, docs.columns, moved)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id.

    Null and empty texts are near nothing and stay, as do rows without an id;
    rows that repeat an id are one document, and stay or go together.
    """
    kept = minhash.near_duplicates(docs).filter("kept").select(F.col("row_id").alias("__np_id"))
    return docs.join(kept, docs["doc_id"].eqNullSafe(F.col("__np_id")), "left_semi")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them, to the nearest whole copy.

    Null and blank texts have no words and are not taken; a null source is one
    of its own.
    """
    return mixing.take_copies(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in windows of 2048 ids; a null or empty text is its end id alone."""
    packed = packing.pack(docs, tokenizer_path())
    return packed.select(F.col("row_id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", clean_lines),
    ("minhash near-dedup", keep_one_of_each),
    ("mixing to target weights", mix_sources),
    ("packing", pack_windows),
]

#: A trained classifier, tokenization and differencing have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, on the table ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = materialise(docs, f"stage{n}")
    return docs

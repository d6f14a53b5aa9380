"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.llm import anisotropic, line_dedup, minhash, mixing, packing, quality, sharding, simhash, suffixes, token_counts
from stemma.plans.storage import materialise, read_table


def tokenizer_path() -> str:
    """The vocabulary file of the token queries."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Queries of searches are the rows whose id this divides.
QUERY_STEP = 50


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of texts and edited texts; ``near_docs`` counts a search's other documents within the radius."""
    marked = materialise(simhash.fingerprint_edits(read_table(spark, sf_dir, "documents")), "fingerprints")
    sought = marked.filter(F.col("row_id") % QUERY_STEP == 0)
    copies = marked.groupBy(F.col("fingerprint").alias("found_fp")).agg(F.count(F.lit(1)).alias("rows"))
    found = simhash.radius_search(sought, marked).join(copies, "found_fp").groupBy(F.col("query_fp").alias("fingerprint")).agg(F.sum("rows").alias("near_docs"))
    counted = marked.join(found, "fingerprint", "left")
    return counted.select(
        F.col("row_id").alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
        F.when(F.col("row_id") % QUERY_STEP == 0, F.col("near_docs") - 1).alias("near_docs"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "removed_lines", F.col("text").alias("clean_text"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path())
    return packed.select(
        F.col("row_id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return anisotropic.search(anisotropic.build(vectors), vectors.filter(F.col("vec_id") % 20 == 0), 20)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), keep=["doc_id"])


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, sf_dir, "documents"))
    return mixed.select(F.col("row_id").alias("doc_id"), "size", "source_size", "target", "taken")


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(read_table(spark, sf_dir, "documents"))
    return placed.select(
        F.col("row_id").alias("doc_id"),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts before and after an edit in each text's middle: 16 code points there give way to the text's last 24."""
    counted = token_counts.count_tokens(read_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())
    text = F.coalesce(F.col("text"), F.lit(""))
    edit = F.struct(
        F.floor(F.length(text) / 2).cast("int").alias("start"), F.lit(16).alias("delete"), F.right(text, F.lit(24)).alias("insert")
    )
    before = counted.select("*", F.col("n_tokens").alias("tokens_before"), F.length(text).cast("long").alias("n_chars"), F.array(edit).alias("edits"))
    after = token_counts.apply_edits(before, tokenizer_path())
    return after.select(
        "doc_id", "n_chars", F.col("tokens_before").alias("n_tokens"), F.length("text").cast("long").alias("edited_chars"),
        F.col("n_tokens").alias("edited_tokens"), "reencoded_chars", F.size("token_tree.leaf_chars").alias("leaves"),
    )


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select(F.col("row_id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.repeats(read_table(spark, sf_dir, "documents"))
    return found.select(F.col("row_id").alias("doc_id"), "start_word", "n_words", F.col("first_id").alias("first_doc_id"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_line_dedup": op2_line_dedup,
    "op3_packing": op3_packing,
    "op4_nearest": op4_nearest,
    "op5_quality": op5_quality,
    "op6_mix_sources": op6_mix_sources,
    "op7_shards": op7_shards,
    "op8_token_counts": op8_token_counts,
    "op9_near_dedup": op9_near_dedup,
    "op10_repeats": op10_repeats,
}

ORACLE_SQL: dict[str, str] = {
    "op2_line_dedup": r"""
WITH parts AS (
  SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents
), l AS (
  SELECT doc_id, coalesce('0' || source, '1') AS site, trim(unnest(lines), ' ' || chr(9) || chr(13)) AS line FROM parts
), boiler AS (
  SELECT line, min(doc_id) AS first_id FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= 10
), each_line AS (
  SELECT doc_id, unnest(range(len(lines))) AS pos, unnest(lines) AS line FROM parts
), marked AS (
  SELECT e.doc_id, e.pos, e.line, b.line IS NOT NULL AND e.doc_id IS DISTINCT FROM b.first_id AS gone
  FROM each_line e LEFT JOIN boiler b ON trim(e.line, ' ' || chr(9) || chr(13)) = b.line
), cleaned AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS removed_lines,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS clean_text
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(c.n_lines, 0) AS INTEGER) AS n_lines,
       CAST(coalesce(c.removed_lines, 0) AS INTEGER) AS removed_lines,
       CASE WHEN d.text IS NULL THEN NULL ELSE c.clean_text END AS clean_text
FROM documents d LEFT JOIN cleaned c USING (doc_id)
""",
    "op6_mix_sources": r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce('0' || source, '1') AS src,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5('11|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || md5(coalesce(text, ''))) AS h
  FROM documents
), sized AS (
  SELECT src, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY src
), weighed AS (
  SELECT src, source_size, CAST(2 * source_size AS DOUBLE) AS cap,
         CAST(CASE (row_number() OVER (ORDER BY src) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight
  FROM sized
), levels AS (
  SELECT *, sum(cap) OVER upto AS filled, coalesce(sum(weight) OVER after, 0) AS open_weight,
         sum(weight) OVER () AS weights, sum(source_size) OVER () * CAST(1.5 AS DOUBLE) AS budget,
         row_number() OVER (ORDER BY cap / weight, src) AS nth
  FROM weighed
  WINDOW upto AS (ORDER BY cap / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         after AS (ORDER BY cap / weight, src ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
), best AS (
  SELECT filled, open_weight FROM levels WHERE open_weight > 0 AND (budget - filled) / open_weight >= cap / weight
  ORDER BY nth DESC LIMIT 1
), plan AS (
  SELECT src, source_size,
         least(cap, (budget - coalesce((SELECT filled FROM best), 0)) / coalesce((SELECT open_weight FROM best), weights) * weight) AS target
  FROM levels
), centre AS (
  SELECT sum(size * ln(size + 1.0::DOUBLE)) / sum(size) AS mean, 0.02::DOUBLE * (SELECT sum(target) FROM plan) AS pull FROM docs
), balance AS (
  SELECT 0 AS step, src, size, words, ln(size + 1.0::DOUBLE) - mean AS z, target, pull, ln(target / source_size) AS lam, 0.0::DOUBLE AS mu,
         target >= 2 * source_size AS held, false AS done
  FROM (SELECT src, size, CAST(sum(size) AS DOUBLE) AS words FROM docs WHERE size > 0 GROUP BY src, size) JOIN plan USING (src), centre
  UNION ALL
  SELECT step + 1, src, size, words, z, target, pull,
         CASE WHEN rest THEN lam ELSE lam - greatest(-1, least(1, CASE WHEN d > 0 THEN (g - b * shift) / d ELSE 0 END)) END,
         CASE WHEN rest THEN mu ELSE mu - shift END, held OR (rest AND above), rest AND NOT any_above
  FROM (
    SELECT *, coalesce(off, 0) <= 1e-10 AND (off IS NULL OR abs(gradient) <= 1e-10 * greatest(pull / 0.02, 1)) AS rest,
           greatest(-0.5, least(0.5, (gradient - bg) / (c - bb + pull))) AS shift
    FROM (
      SELECT *, sum(mass * z) OVER () + pull * mu AS gradient, sum(free * z * z) OVER () AS c,
             sum(CASE WHEN d > 0 THEN free * z * b / d ELSE 0 END) OVER () AS bb, sum(CASE WHEN d > 0 THEN free * z * g / d ELSE 0 END) OVER () AS bg,
             max(CASE WHEN d > 0 THEN abs(g) / greatest(target, 1) END) OVER () AS off, bool_or(above) OVER () AS any_above
      FROM (
        SELECT *, sum(mass) OVER own - target AS g, sum(free) OVER own AS d, sum(free * z) OVER own AS b
        FROM (
          SELECT *, CASE WHEN held THEN 2 * words ELSE words * exp(lam + mu * z) END AS mass,
                 CASE WHEN held THEN 0 ELSE words * exp(lam + mu * z) END AS free, NOT held AND lam + mu * z > ln(2.0::DOUBLE) AS above
          FROM balance WHERE NOT done AND step < 300
        ) WINDOW own AS (PARTITION BY src)
      )
    )
  )
), rates AS (
  SELECT src, size, CASE WHEN held THEN 2.0 ELSE exp(lam + mu * z) END AS rate FROM balance WHERE step = (SELECT max(step) FROM balance)
), rounded AS (
  SELECT d.*, p.source_size, p.target,
         CAST(least(2, floor(coalesce(r.rate, 0) + CAST('0x' || substr(h, 9, 8) AS BIGINT) / 4294967296.0::DOUBLE)) AS BIGINT) AS copies
  FROM docs d JOIN plan p USING (src) LEFT JOIN rates r ON r.src = d.src AND r.size = d.size
), missed AS (
  SELECT *, CAST(floor(target + 0.25) AS BIGINT) - sum(copies * size) OVER (PARTITION BY src) AS missing FROM rounded
), able AS (
  SELECT *, CASE WHEN CASE WHEN missing > 0 THEN copies < 2 ELSE copies > 0 END THEN size ELSE 0 END AS room FROM missed
), placed AS (
  SELECT *, coalesce(sum(room) OVER (PARTITION BY src ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS passed FROM able
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(copies * size + sign(missing) * greatest(0, least(room, abs(missing) - passed)) AS BIGINT) AS taken
FROM placed
""",
    "op7_shards": r"""
WITH crc_table AS (
  SELECT list(v ORDER BY i) AS t
  FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v FROM range(256) r(i))
), docs AS (
  SELECT doc_id, coalesce('0' || source, '1') AS src, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size,
         md5('7|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || md5(coalesce(text, ''))) AS h,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes
  FROM documents
), summed AS (
  SELECT doc_id, src, size, h, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS crc
  FROM docs, crc_table
), ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY src ORDER BY h, crc, size, doc_id)
             - (CAST('0x' || substr(md5('7|' || src), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE) / count(*) OVER (PARTITION BY src) AS frac
  FROM summed
), placed AS (
  SELECT *, row_number() OVER (ORDER BY frac, src, h, crc, size, doc_id) - 1 AS place, count(*) OVER () AS n FROM ranked
)
SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, CAST(place * 8 // n AS INTEGER) AS shard,
       place - (place * 8 // n * n + 7) // 8 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM placed
""",
    "op9_near_dedup": r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents WHERE text IS NOT NULL
), grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) END) AS gram
  FROM split WHERE len(w) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)
), ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS v, doc_id AS r FROM documents
  UNION
  SELECT ways.b AS v, reach.r FROM reach JOIN ways ON ways.a = reach.v
), roots AS (
  SELECT v, min(r) AS component_id FROM reach GROUP BY v
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.component_id, d.doc_id = r.component_id AS kept
FROM documents d JOIN roots r ON r.v = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
""",
}

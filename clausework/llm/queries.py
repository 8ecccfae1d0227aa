"""The registered queries of the training-data operators: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_reuse, byte_bpe, fingerprints, fst_count, lm, merkle, mixing, quality_mil, simhash_dedup, suffix_dedup, topk, toxicity, vector_codes
from .common import table
from .labelled import sample

#: The vocabulary file of the queries.
VOCABULARY = "byte_bpe_50k.json"
#: The same vocabulary as ranks.
RANKS = "byte_bpe_50k.tiktoken"


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Words in the longest n-grams of the language model.
ORDER = 3


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = lm.fit(docs.filter(~lm.held_out("doc_id", 7, 2)), ORDER)
    out = lm.score(docs, model)
    return out.select("doc_id", lm.held_out("doc_id", 7, 2).alias("held_out"), *out.columns[1:])


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(table(spark, sf_dir, "documents"))


#: A score from which the classifiers predict label 1.
THRESHOLD = 0.3


def _predicted(scores: DataFrame, modulus: int, remainder: int) -> DataFrame:
    return scores.select("doc_id", lm.held_out("doc_id", modulus, remainder).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = sample(docs, table(spark, sf_dir, "labels"), "quality", ~lm.held_out("doc_id", 5, 0), {1: quality_mil.GOOD, 0: quality_mil.BAD}, quality_mil.LONGEST)
    return _predicted(quality_mil.score(docs, quality_mil.fit(rows)), 5, 0)


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    return toxicity.fit(sample(docs, labels, "toxic", ~lm.held_out("doc_id", 4, 2), {1: toxicity.POSITIVE, 0: toxicity.NEGATIVE}, toxicity.LONGEST, toxicity.FIRST))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _predicted(toxicity.score(docs, toxicity_model(docs, table(spark, sf_dir, "labels"))), 4, 2)


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.classes(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op6_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_reuse.digest(table(spark, sf_dir, "documents"), vocabulary())


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", topk.quantized(64.0, "embedding").alias("vector"))
    return topk.search(rows, F.col("vec_id") % 20 == 0, 20)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fst_count.token_counts(table(spark, sf_dir, "documents"), vocabulary())


#: The mixing query's targets: part of the largest entropy, epochs at most.
ENTROPY, REPEATS = 0.97, 4.0


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), ENTROPY, REPEATS)
    return out.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.col("mix_tokens").alias("n_tokens"), F.col("mix_epoch").alias("epoch"), "mix_order")


#: Of the manifest's rows those are tampered with whose id's crc32 this divides.
TAMPERED = 5


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    leaf = lambda text: merkle.leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = docs.select("doc_id", "source", leaf(F.col("text")).alias("leaf"), F.when(lm.held_out("doc_id", TAMPERED, 0), leaf(lower)).alias("altered"))
    out = merkle.manifest(rows).withColumn("folded_root", merkle.fold(F.coalesce("altered", "leaf"), F.col("proof")))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("proof")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digest(table(spark, sf_dir, "documents"), vocabulary(RANKS))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_lm_scoring, op2_document_fingerprints, op3_quality_classifier, op4_suffix_array_dedup, op5_simhash_near_dedup, op6_bpe_encoding, op7_exact_top_k, op8_token_counts, op9_toxicity, op10_source_mixing, op11_merkle_manifest, op12_byte_bpe, op13_vector_codes)}

#: One round of the vector codes in SQL: parts to the nearest entries of b{r}, and the entries that follow.
_ROUND = """a{r} AS MATERIALIZED (
  SELECT v.id, v.part, v.x, min({{'d': CAST(list_sum(list_transform(list_zip(v.x, b.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT), 'e': b.entry}}) AS near FROM v JOIN b{r} b USING (part) GROUP BY v.id, v.part, v.x
), m{r} AS (
  SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS x FROM (
    SELECT part, near.e AS entry, j, CAST(sum(x[j]) AS BIGINT) AS s, count(*) AS n FROM a{r}, (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM v))) AS j) GROUP BY ALL) GROUP BY ALL
), b{s} AS MATERIALIZED (SELECT part, entry, coalesce(m{r}.x, b{r}.x) AS x FROM b{r} LEFT JOIN m{r} USING (part, entry)), """

ORACLES: dict[str, str] = {
    "op11_merkle_manifest": """
WITH RECURSIVE c(i, v, s) AS (SELECT range, range, 0 FROM range(256) UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END, s + 1 FROM c WHERE s < 8),
k AS (SELECT list(v ORDER BY i) AS tab FROM c WHERE s = 8),
t AS (
  SELECT doc_id, source, lang, n_chars, text, row_number() OVER () AS id,
    coalesce(xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: xor(tab[CAST((xor(a, b) & 255) + 1 AS INTEGER)], a >> 8))) % 5 = 0, false) AS bad
  FROM documents, k
), f AS (
  SELECT *, concat(coalesce(concat(CAST(strlen(CAST(doc_id AS VARCHAR)) AS VARCHAR), ':', CAST(doc_id AS VARCHAR)), '-'), coalesce(CAST(strlen(source) AS VARCHAR) || ':' || source, '-'), coalesce(CAST(strlen(lang) AS VARCHAR) || ':' || lang, '-'), coalesce(CAST(strlen(CAST(n_chars AS VARCHAR)) AS VARCHAR) || ':' || CAST(n_chars AS VARCHAR), '-')) AS head,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM t
), d AS (
  SELECT id, doc_id, source, sha256(head || coalesce(CAST(strlen(text) AS VARCHAR) || ':' || text, '-')) AS leaf, sha256(head || coalesce(CAST(strlen(text) AS VARCHAR) || ':' || CASE WHEN bad THEN low ELSE text END, '-')) AS now FROM f
), p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS n FROM d),
tree(lvl, source, place, hash, n) AS (
  SELECT 0, source, place, leaf, n FROM p
  UNION ALL SELECT lvl + 1, source, place // 16, sha256(string_agg(hash, '' ORDER BY place)), (max(n) + 15) // 16 FROM tree WHERE n > 1 GROUP BY lvl, source, place // 16
), sub AS (SELECT source, hash AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM tree WHERE n = 1),
top(lvl, place, hash, n) AS (
  SELECT 0, place, subroot, n FROM sub
  UNION ALL SELECT lvl + 1, place // 16, sha256(string_agg(hash, '' ORDER BY place)), (max(n) + 15) // 16 FROM top WHERE n > 1 GROUP BY lvl, place // 16
), run AS (SELECT lvl, source, place // 16 AS up, list(hash ORDER BY place) AS run FROM tree WHERE n > 1 GROUP BY ALL),
trun AS (SELECT lvl, place // 16 AS up, list(hash ORDER BY place) AS run FROM top WHERE n > 1 GROUP BY ALL),
g(id, lvl, source, place, n, now, seen) AS (
  SELECT id, 0, source, place, n, now, '' FROM p
  UNION ALL SELECT g.id, g.lvl + 1, g.source, g.place // 16, (g.n + 15) // 16,
    sha256(concat(array_to_string(run[:g.place % 16], ''), g.now, array_to_string(run[g.place % 16 + 2:], ''))), concat(g.seen, array_to_string(run[:g.place % 16], ''), array_to_string(run[g.place % 16 + 2:], ''))
  FROM g JOIN run r ON r.lvl = g.lvl AND r.source IS NOT DISTINCT FROM g.source AND r.up = g.place // 16 WHERE g.n > 1
), h(id, lvl, place, n, now, seen, subroot) AS (
  SELECT g.id, 0, s.place, s.n, g.now, g.seen, s.subroot FROM g JOIN sub s ON s.source IS NOT DISTINCT FROM g.source WHERE g.n = 1
  UNION ALL SELECT h.id, h.lvl + 1, h.place // 16, (h.n + 15) // 16,
    sha256(concat(array_to_string(run[:h.place % 16], ''), h.now, array_to_string(run[h.place % 16 + 2:], ''))), concat(h.seen, array_to_string(run[:h.place % 16], ''), array_to_string(run[h.place % 16 + 2:], '')), h.subroot
  FROM h JOIN trun r ON r.lvl = h.lvl AND r.up = h.place // 16 WHERE h.n > 1
)
SELECT p.doc_id, p.leaf, h.subroot, top.hash AS root, sha256(h.seen) AS proof_sha256, h.now AS folded_root, h.now = top.hash AS verified
FROM p JOIN h USING (id) JOIN top ON top.n = 1 WHERE h.n = 1""",
    "op13_vector_codes": f"""
WITH w AS (
  SELECT vec_id, label, row_number() OVER () AS id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS vector FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), v AS MATERIALIZED (SELECT id, part, vector[part * (len(vector) // {vector_codes.PARTS}) + 1:(part + 1) * (len(vector) // {vector_codes.PARTS})] AS x FROM w, (SELECT unnest(range({vector_codes.PARTS})) AS part)),
b0 AS MATERIALIZED (SELECT part, entry, x FROM v JOIN (SELECT id, row_number() OVER (ORDER BY vec_id NULLS LAST, vector) - 1 AS entry FROM w) USING (id) WHERE entry < {vector_codes.ENTRIES}),
{"".join(_ROUND.format(r=r, s=r + 1) for r in range(vector_codes.ROUNDS))}
z AS (SELECT v.id, v.part, min({{'d': CAST(list_sum(list_transform(list_zip(v.x, b.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT), 'e': b.entry}}) AS near FROM v JOIN b{vector_codes.ROUNDS} b USING (part) GROUP BY v.id, v.part),
y AS (SELECT id, string_agg(lpad(lower(hex(near.e)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(near.d) AS BIGINT) AS error FROM z GROUP BY id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM b{vector_codes.ROUNDS}) AS codebooks_sha256 FROM w JOIN y USING (id)""",
    "op10_source_mixing": mixing.sql(ENTROPY, REPEATS),
    "op7_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS vector FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.vector, c.vector), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.vector) = len(c.vector) WHERE q.vec_id % 20 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20""",
}

"""The queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm import ann, codes, language_model, line_dedup, merkle, mixing, near_dedup, packing, quality, rules, secrets, sharding, tables, toxicity
from flowloom.llm.tables import documents


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    trained = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = toxicity.scored(docs.select("doc_id", "text", (toxicity.fold() == 0).alias("held_out")), trained, ["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_words", "log_ratio")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.linked(documents(spark, sf_dir), words_each=4, percent=80)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), language_model.held_out().alias("held_out"))
    model = language_model.train(docs.filter(~F.col("held_out")))
    scores = language_model.scored(docs, model, ["doc_id", "held_out"])
    return scores.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model["n"]).cast("long").alias("train_tokens"), "base_score", "score")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each distinct line of ``documents`` that is not blank."""
    docs = documents(spark, sf_dir)
    found = line_dedup.classes(docs, tables.kept(line_dedup.occurrences(docs, line_dedup.EVERY), "lines"), words=line_dedup.EVERY)
    kept = F.col("first") == F.col("class_first")
    return found.select("line", "copies", "class_id", F.col("first.d").alias("first_doc"), F.col("first.number").alias("first_number"), kept.alias("kept"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.sharded(documents(spark, sf_dir))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    streamed, mix = mixing.mixed(documents(spark, sf_dir))
    found = mixing.taken(streamed, mix)
    return found.select("doc_id", F.col("__size").alias("size"), "source_size", "target", "taken")


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scanned(documents(spark, sf_dir))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judged(documents(spark, sf_dir))
    counts = [F.col(f"__{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return found.select("doc_id", *counts, F.col("__base_failed").alias("base_failed"), F.col("__kept").alias("kept"), F.col("__distance").alias("outlier_distance"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return ann.nearest(vectors, F.col("vec_id") % 20 == 0, k=20)


def vector_codes(vectors: DataFrame) -> DataFrame:
    found, books = codes.compressed(vectors, F.col("vec_id"), F.col("embedding"), F.col("label"))
    return found.withColumn("codebooks_sha256", F.lit(codes.digest(books)))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    ensemble = rules.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out), F.col("quality") == 1)
    found = rules.scored(docs, ensemble, {"doc_id": F.col("doc_id"), "held_out": held_out})
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def manifest_rows(docs: DataFrame) -> DataFrame:
    """Leaf, roots and proof digest of each document, and whether the proof of its leaf, tampered with for a seventh of the ids, leads to the root."""
    touched = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, 1).otherwise(0)

    def leaf(n_chars):
        return merkle.leaf_digest([F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text")])

    keep = {"doc_id": F.col("doc_id"), "shown": F.when(touched == 1, leaf(F.col("n_chars") + 1))}
    found = merkle.manifest(docs, leaf(F.col("n_chars")), F.col("lang"), F.col("doc_id"), keep)
    found = found.withColumn("folded_root", merkle.folded(F.coalesce("shown", "leaf"), F.col("proof")))
    return found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest_rows(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_near_dedup, op3_language_model, op4_line_dedup, op5_sharding, op6_mixing, op7_secret_scans, op8_quality_rules, op9_packing, op10_nearest_neighbours, op11_vector_codes, op12_quality_classifier, op13_merkle_manifest)}

# All pairs that share a shingle, and all that their links reach.
CHECKS = {
    "op2_near_dedup": r"""
WITH RECURSIVE words AS (
 SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
 FROM documents),
shingles AS (
 SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g
 FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
 SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (
 SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
either AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reached AS (SELECT doc_id AS node, doc_id AS other FROM documents UNION SELECT node, b FROM reached JOIN either ON other = a),
classes AS (SELECT node, min(other) AS component_id FROM reached GROUP BY node)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN classes ON node = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id""",
    # every part against every entry of its codebook, three times
    "op11_vector_codes": r"""
WITH kept AS (
 SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
 FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT r, vec_id, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS v FROM kept, unnest(range(0, 16)) u(p)),
book0 AS (SELECT p, e, v FROM (SELECT p, v, row_number() OVER (PARTITION BY p ORDER BY r) - 1 AS e FROM parts WHERE vec_id IS NOT NULL) WHERE e < 64),
near0 AS (
 SELECT r, p, v, arg_min(e, struct_pack(d := d, e := e)) AS e, min(d) AS d
 FROM (SELECT r, x.p, x.v, b.e, list_sum(list_transform(range(1, len(x.v) + 1), lambda i: (x.v[i] - b.v[i]) * (x.v[i] - b.v[i])))::BIGINT AS d
  FROM parts x JOIN book0 b ON b.p = x.p) GROUP BY r, p, v),
means0 AS (
 SELECT p, e, list(m ORDER BY j) AS v
 FROM (SELECT p, e, j, CAST(floor(sum(v[j]) / count(*)) AS BIGINT) AS m FROM near0, unnest(range(1, len(v) + 1)) u(j) GROUP BY p, e, j) GROUP BY p, e),
book1 AS (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM book0 b LEFT JOIN means0 m ON m.p = b.p AND m.e = b.e),
near1 AS (
 SELECT r, p, v, arg_min(e, struct_pack(d := d, e := e)) AS e, min(d) AS d
 FROM (SELECT r, x.p, x.v, b.e, list_sum(list_transform(range(1, len(x.v) + 1), lambda i: (x.v[i] - b.v[i]) * (x.v[i] - b.v[i])))::BIGINT AS d
  FROM parts x JOIN book1 b ON b.p = x.p) GROUP BY r, p, v),
means1 AS (
 SELECT p, e, list(m ORDER BY j) AS v
 FROM (SELECT p, e, j, CAST(floor(sum(v[j]) / count(*)) AS BIGINT) AS m FROM near1, unnest(range(1, len(v) + 1)) u(j) GROUP BY p, e, j) GROUP BY p, e),
book2 AS (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM book1 b LEFT JOIN means1 m ON m.p = b.p AND m.e = b.e),
near2 AS (
 SELECT r, p, v, arg_min(e, struct_pack(d := d, e := e)) AS e, min(d) AS d
 FROM (SELECT r, x.p, x.v, b.e, list_sum(list_transform(range(1, len(x.v) + 1), lambda i: (x.v[i] - b.v[i]) * (x.v[i] - b.v[i])))::BIGINT AS d
  FROM parts x JOIN book2 b ON b.p = x.p) GROUP BY r, p, v),
coded AS (SELECT r, string_agg(format('{:02x}', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near2 GROUP BY r),
books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (r), books""",
    "op13_merkle_manifest": r"""
WITH RECURSIVE pieces AS (
 SELECT *, [CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR), text] AS p,
  [CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars + CASE WHEN crc % 7 = 0 THEN 1 ELSE 0 END AS VARCHAR), text] AS q
 FROM (SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda h, c: list_reduce([xor(h, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, b: xor(x >> 1, (x & 1) * 3988292384)))) AS crc FROM documents)),
hashed AS (
 SELECT doc_id, lang,
  sha256(array_to_string(list_transform(p, lambda v: coalesce(CAST(strlen(v) AS VARCHAR) || ':' || v, '-')), '')) AS leaf,
  sha256(array_to_string(list_transform(q, lambda v: coalesce(CAST(strlen(v) AS VARCHAR) || ':' || v, '-')), '')) AS shown
 FROM pieces),
leaves AS (
 SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM hashed),
levels AS (
 SELECT lang, 0 AS level, list(leaf ORDER BY i) AS nodes FROM leaves GROUP BY lang
 UNION ALL
 SELECT lang, level + 1, list_transform(range(1, len(nodes) + 1, 2), lambda k: sha256(nodes[k] || coalesce(nodes[k + 1], ''))) FROM levels WHERE len(nodes) > 1),
tops AS (
 SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS j, max(level) OVER () + 1 AS base FROM levels WHERE len(nodes) = 1),
over_levels AS (
 SELECT 0 AS level, list(subroot ORDER BY j) AS nodes FROM tops HAVING count(*) > 0
 UNION ALL
 SELECT level + 1, list_transform(range(1, len(nodes) + 1, 2), lambda k: sha256(nodes[k] || coalesce(nodes[k + 1], ''))) FROM over_levels WHERE len(nodes) > 1),
steps AS (
 SELECT doc_id, leaf, shown, level, (i >> level) & 1 AS side, coalesce(nodes[xor(i >> level, 1) + 1], '') AS near
 FROM leaves JOIN levels ON leaves.lang IS NOT DISTINCT FROM levels.lang WHERE len(nodes) > 1
 UNION ALL
 SELECT doc_id, leaf, shown, base + level, (j >> level) & 1, coalesce(nodes[xor(j >> level, 1) + 1], '')
 FROM leaves JOIN tops ON leaves.lang IS NOT DISTINCT FROM tops.lang, over_levels WHERE len(nodes) > 1),
proofs AS (
 SELECT doc_id, leaf, shown, list({'side': side, 'near': near} ORDER BY level) AS proof FROM steps GROUP BY ALL),
folds AS (
 SELECT doc_id, leaf, proof, 0 AS k, shown AS h FROM proofs
 UNION ALL
 SELECT doc_id, leaf, proof, k + 1, sha256(CASE WHEN proof[k + 1].side = 1 THEN proof[k + 1].near || h ELSE h || proof[k + 1].near END) FROM folds WHERE k < len(proof)),
ends AS (SELECT doc_id, leaf, h, sha256(array_to_string(list_transform(proof, lambda s: s.near), '')) AS proof_sha256 FROM folds WHERE k = len(proof))
SELECT l.doc_id, l.leaf, subroot, (SELECT nodes[1] FROM over_levels WHERE len(nodes) = 1) AS root, proof_sha256, h AS folded_root,
 h = (SELECT nodes[1] FROM over_levels WHERE len(nodes) = 1) AS verified
FROM leaves l JOIN tops ON l.lang IS NOT DISTINCT FROM tops.lang JOIN ends e ON e.doc_id IS NOT DISTINCT FROM l.doc_id AND e.leaf = l.leaf""",
}

"""The registered queries of the operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, aqann, bpe, dartminhash, filter_audit, packing, pipeline, ppm, quality, sharding, suffix_dedup, templates, token_counts, toxicity
from .common import fresh_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_docs(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.matches(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_sequences(table(spark, sf_dir, "documents"))
    return out.select("bin_id", "capacity", "used", "doc_ids", "pieces", "offsets", F.sha2("text", 256).alias("text_sha256"))


def op4_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.extract(table(spark, sf_dir, "pages"))


def op5_tiered_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append the documents in twelve arrivals by two writers, every third with a column of its own, compact on the way, and read all back."""
    docs, path = table(spark, sf_dir, "documents"), fresh_path(spark, "tiered")
    writers = [sharding.TieredDataset(spark, path) for _ in range(2)]
    for i, part in enumerate(sharding.arrivals(docs, 12)):
        writers[i % 2].append(part.withColumn("batch", F.lit(i)) if i % 3 == 1 else part)
        if i % 4 == 3:
            writers[i % 2].compact()
            writers[i % 2].vacuum()
    writers[0].compact()
    writers[0].vacuum()
    rows = writers[1].read(schema=docs.schema)
    batch = F.col("batch") if "batch" in rows.columns else F.lit(None).cast("int").alias("batch")
    return rows.select("doc_id", "lang", "source", "n_chars", F.md5(F.col("text").cast("binary")).alias("text_md5"), batch)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"))


def op7_additive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aqann.search(table(spark, sf_dir, "embeddings"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_docs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dartminhash.classes(table(spark, sf_dir, "documents"))


def op10_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digest_docs(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_rank_synchronous_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_docs(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_elementary_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.align_docs(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    "op1_ppm_scores": op1_ppm_scores,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_site_templates": op4_site_templates,
    "op5_tiered_sharding": op5_tiered_sharding,
    "op6_quality_rules": op6_quality_rules,
    "op7_additive_ann": op7_additive_ann,
    "op8_toxicity": op8_toxicity,
    "op9_dart_minhash": op9_dart_minhash,
    "op10_bpe_automaton": op10_bpe_automaton,
    "op11_rank_synchronous_counts": op11_rank_synchronous_counts,
    "op12_filter_audit": op12_filter_audit,
    "op13_elementary_alignment": op13_elementary_alignment,
    "pipeline": pipeline.run,
}
ORACLES = {
    "op5_tiered_sharding": """WITH e AS (SELECT min(doc_id) AS lo, greatest(1, (max(doc_id) - min(doc_id) + 12) // 12) AS step FROM documents)
SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5, CASE WHEN (doc_id - lo) // step % 3 = 1 THEN ((doc_id - lo) // step)::INT END AS batch FROM documents, e""",
    "op12_filter_audit": """WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part FROM documents),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY 1),
w AS (SELECT doc_id, text, part, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
(CASE WHEN len(words) < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END) + (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 4 ELSE 0 END)
+ (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN doc_id > first THEN 16 ELSE 0 END) AS mask FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE toxic) AS t FROM m GROUP BY 1, 2),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS removed,
sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN g ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN t ELSE 0 END)::BIGINT AS toxic_lost FROM c, s GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM r""",
}

"""The numbered queries: thin callers of the operators, over whole tables."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from townsheet.llm import anchors, bpe, fim, jaccard, katz, langid, quality, repair, secrets, sharding, simhash, templates, whitening
from townsheet.llm.common import crc_mod, documents, shared_dir

TOKENIZER = "word_bpe_49k.json"


def op1_repair_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/grammar-{uuid.uuid4().hex}"
    repair.write(documents(spark, sf_dir), path, public_tokenizers.path(TOKENIZER))
    return repair.read(spark, path)


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.flag(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"))
    model = langid.fit(docs.where("not held_out"))
    return langid.predict(docs.select("doc_id", "text", "held_out"), model)


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir).select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(documents(spark, sf_dir).select("doc_id", "text", "lang", "source"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op7_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", (crc_mod(F.col("doc_id"), 5) == 1).alias("held_out"))
    model = katz.fit(docs.where("not held_out"))
    found = katz.score(docs, model)
    held = (crc_mod(F.col("doc_id"), 5) == 1).alias("held_out")
    return found.select("doc_id", held, "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op8_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.assign(documents(spark, sf_dir), sharding.base_tree(40), sharding.base_tree(40, extra=1))
    return found.withColumn("law", F.lit("key"))


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path(TOKENIZER))


def op10_fixed_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = anchors.dedup(documents(spark, sf_dir))
    spans = F.transform("removed", lambda s: F.concat_ws(":", F.get(s, 0).cast("string"), F.get(s, 1).cast("string")))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256", F.array_join(spans, ",").alias("removed"))


def op11_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(documents(spark, sf_dir))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(documents(spark, sf_dir))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


#: Every window of 13 words by its words themselves, beside the anchors of the operator.
OP10_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, p, array_to_string(list_slice(w, p + 1, p + 13), ' ') AS s FROM (SELECT doc_id, w, unnest(range(len(w) - 12)) AS p FROM d WHERE len(w) > 12)),
hit AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS least FROM win) WHERE least < doc_id),
cov AS (SELECT DISTINCT doc_id, p + k AS q FROM hit, (SELECT unnest(range(13)) AS k)),
islands AS (SELECT doc_id, min(q) AS a, max(q) + 1 AS b FROM (SELECT doc_id, q, q - row_number() OVER (PARTITION BY doc_id ORDER BY q) AS g FROM cov) GROUP BY doc_id, g),
gone AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n, string_agg(a || ':' || b, ',' ORDER BY a) AS spans FROM islands GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY q) AS words FROM (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS q FROM d) ANTI JOIN cov USING (doc_id, q) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256, coalesce(spans, '') AS removed
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


#: Cuts by joining the tokens themselves, beside the rank index of the operator.
OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents),
x AS (SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM x),
f AS (SELECT *, array_to_string(list_slice(u, 1, a), '') AS p, array_to_string(list_slice(u, a + 1, b), '') AS m, array_to_string(list_slice(u, b + 1, n), '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM f
"""


def oracle_sql() -> dict[str, str]:
    return {"op10_fixed_block_anchors": OP10_SQL, "op12_fill_in_middle": OP12_SQL}

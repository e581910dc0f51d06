"""The ten queries, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import delete_at_exit, shared_dir, table
from tickloom.llm.fingerprints import edited_fingerprints
from tickloom.llm.minhash import near_duplicates
from tickloom.llm.mixing import mix_sources
from tickloom.llm.neighbours import near_vectors
from tickloom.llm.packing import pack_best_fit
from tickloom.llm.secrets import scan_secrets
from tickloom.llm.sharding import assign_shards
from tickloom.llm.suffixes import remove_repeats
from tickloom.llm.tokens import token_index, write_tokens
from tickloom.llm.toxicity import fit_toxicity, score_toxicity

#: Target weights of op1: src0 alone is a third of the input and is cut to an eighth; src1 is tripled.
MIX_WEIGHTS = {"src0": 3.0, "src1": 3.0}
MIX_EPOCHS = 1.5
MIX_SEED = 17


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mix_sources(docs, MIX_WEIGHTS, epochs=MIX_EPOCHS, seed=MIX_SEED)
    text = F.coalesce("text", F.lit(""))
    return mixed.select("doc_id", "source", "copy", "n_copies", "position", F.octet_length(text).cast("long").alias("n_bytes"), F.md5(text).alias("text_md5"))


OP1_SQL = f"""
WITH RECURSIVE d AS (
  SELECT *, octet_length(encode(coalesce(text, ''))) + 1 AS size,
         CASE source WHEN 'src0' THEN {MIX_WEIGHTS["src0"]} WHEN 'src1' THEN {MIX_WEIGHTS["src1"]} ELSE 1.0 END::DOUBLE AS weight
  FROM documents
), per AS (
  SELECT source, sum(size)::DOUBLE AS size, max(weight) AS weight FROM d GROUP BY source
), rates AS (
  SELECT source, {MIX_EPOCHS}::DOUBLE * (SELECT sum(size) FROM per) * weight / (SELECT sum(weight) FROM per) / size AS mu FROM per
), poisson AS (
  SELECT source, mu, 0 AS k, exp(-mu) AS p, exp(-mu) AS cdf FROM rates
  UNION ALL
  SELECT source, mu, k + 1, p * mu / (k + 1), cdf + p * mu / (k + 1) FROM poisson WHERE k < ceil(mu + 12 * sqrt(mu) + 30)
), u AS (
  SELECT d.*, (('0x' || substr(md5('={MIX_SEED}|' || coalesce('=' || doc_id, 'null') || '|0'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM d
), drawn AS (
  SELECT u.doc_id, u.source, u.text, count(*)::INTEGER AS n_copies
  FROM u JOIN poisson ON u.source IS NOT DISTINCT FROM poisson.source AND poisson.cdf < u.u AND (k < mu OR p > 1e-18)
  GROUP BY u.doc_id, u.source, u.text
), copies AS (
  SELECT doc_id, source, text, n_copies, unnest(range(1, n_copies + 1))::INTEGER AS copy FROM drawn
)
SELECT doc_id, source, copy, n_copies,
       row_number() OVER (ORDER BY md5('={MIX_SEED}|=place|' || coalesce('=' || doc_id, 'null') || '|=' || copy), doc_id, copy) - 1 AS position,
       octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes, md5(coalesce(text, '')) AS text_md5
FROM copies
"""


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), length=100).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


#: Every string of 100 bytes, by its MD5 as a number.
OP2_SQL = """
WITH d AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents
), string AS (
  SELECT doc_id, p, md5_number((b[p + 1:p + 100])::VARCHAR) AS x FROM (SELECT doc_id, b, unnest(range(0, octet_length(b) - 99)) AS p FROM d)
), earliest AS (
  SELECT x, min({'doc_id': doc_id, 'p': p}) AS e FROM string GROUP BY x HAVING count(*) > 1
), later AS (
  SELECT doc_id, p FROM string JOIN earliest USING (x) WHERE {'doc_id': doc_id, 'p': p} > e
), run AS (
  SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS r
  FROM (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS fresh FROM later)
), span AS (
  SELECT doc_id, r, min(p) AS lo, max(p) + 100 AS hi FROM run GROUP BY doc_id, r
), kept AS (
  SELECT doc_id, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS a, lo AS z, 1 AS spans FROM span
  UNION ALL
  SELECT d.doc_id, coalesce(max(hi), 0), any_value(octet_length(b)), 0 FROM d LEFT JOIN span ON span.doc_id = d.doc_id GROUP BY d.doc_id
), rest AS (
  SELECT d.doc_id, any_value(octet_length(b))::BIGINT AS n_bytes, sum(spans)::BIGINT AS n_spans, string_agg(hex(b[a + 1:z]), '' ORDER BY a) AS left_over
  FROM kept JOIN d USING (doc_id) GROUP BY d.doc_id
)
SELECT doc_id, n_bytes, n_bytes - length(left_over) // 2 AS n_removed, n_spans, sha256(unhex(left_over)) AS kept_sha256 FROM rest
"""


def op3_iblt_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op4_projection_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.95)


OP4_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
  SELECT vec_id, vec_id AS r FROM embeddings UNION SELECT reach.vec_id, link.w FROM reach JOIN link ON reach.r = link.u
), n AS (
  SELECT u, count(*) AS n_links FROM link GROUP BY u
)
SELECT vec_id, coalesce(any_value(n_links), 0) AS n_links, min(r) AS component_id, vec_id = min(r) AS kept
FROM reach LEFT JOIN n ON n.u = reach.vec_id GROUP BY vec_id
"""


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2, part=80, whole=100)


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]] ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh
  FROM w
), item AS (
  SELECT doc_id, len(sh) AS n, hash(unnest(sh)) AS h FROM s
), pair AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM item a JOIN item b ON a.h = b.h AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), link AS (
  SELECT a AS u, b AS v FROM pair UNION ALL SELECT b, a FROM pair
), reach AS (
  SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, link.v FROM reach JOIN link ON reach.r = link.u
)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, min(r) AS component_id, s.doc_id = min(r) AS kept FROM s JOIN reach USING (doc_id) GROUP BY s.doc_id, sh
"""


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = delete_at_exit(spark, f"{shared_dir(spark)}/tickloom-tokens-{uuid.uuid4().hex}/files")
    write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path=tokenizer_path())
    return token_index(spark, path).select(F.col("tk_id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op7_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"), shards=16)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("found", lambda s: s["kind"] != "novel")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), count("novel").alias("n_novel"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_best_fit(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mix_sources": op1_mix_sources,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_iblt_fingerprints": op3_iblt_fingerprints,
        "op4_projection_dedup": op4_projection_dedup,
        "op5_minhash_near_dedup": op5_minhash_near_dedup,
        "op6_token_binary": op6_token_binary,
        "op7_balanced_shards": op7_balanced_shards,
        "op8_secret_scan": op8_secret_scan,
        "op9_toxicity": op9_toxicity,
        "op10_best_fit_packing": op10_best_fit_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": OP1_SQL, "op2_suffix_dedup": OP2_SQL, "op4_projection_dedup": OP4_SQL, "op5_minhash_near_dedup": OP5_SQL}

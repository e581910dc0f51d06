"""The registered queries over whole small tables, against SQL and plain versions; and the pipeline."""

from __future__ import annotations

import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from edge import SCHEMA, documents
from pyspark.sql import functions as F
from test_mixing_packing import brute_pack
from test_near import brute_near, brute_repeats
from test_secrets_toxicity import plain_base

import __spark_entry__ as entry
import corpus_pipeline
from tickloom.llm import registry
from tickloom.llm.mixing import mix_sources
from tickloom.llm.secrets import Novelty, find_secrets, redact
from tickloom.llm.toxicity import fit_toxicity

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_match_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    got, want = entry.queries()[name](spark, SF_DIR).toPandas(), c.execute(entry.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    got, want = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    assert got.dtypes.equals(want.dtypes) and np.array_equal(got.to_numpy(), want.to_numpy())


COLUMNS = {
    "op2_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op3_iblt_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op6_token_binary": "doc_id start n_tokens ids_crc32",
    "op7_balanced_shards": "doc_id size text_crc32 law shard slot grown_shard",
    "op8_secret_scan": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op9_toxicity": "doc_id held_out score predicted",
    "op10_best_fit_packing": "doc_id piece bin_id bin_offset",
}


def run_query(spark, name):
    out = entry.queries()[name](spark, SF_DIR).toPandas()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    assert set(COLUMNS[name].split()) <= set(out.columns) and set(out["doc_id"]) == set(texts) and (name.startswith("op10") or len(out) == len(texts))
    return out, texts


def test_op2_query_matches_brute_force(spark):
    out, texts = run_query(spark, "op2_suffix_dedup")
    want = brute_repeats(list(texts.items()))
    assert all(want[r.doc_id] == (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out.itertuples())


def test_op3_query_matches_plain_texts(spark):
    out, texts = run_query(spark, "op3_iblt_fingerprints")
    out = out.set_index("doc_id")
    ids, prints = sorted(texts, reverse=True), {}
    for i, after in zip(ids, [*ids[1:], ids[0]], strict=True):
        text, third, r = texts[i], len(texts[i]) // 3, out.loc[i]
        edited = text[: len(text) - third] + texts[after][:third]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest()) and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint and prints.setdefault(edited, r.edited_fingerprint) == r.edited_fingerprint
        assert (text != texts[after] or r.near_next == 1) and (text != edited or r.near_edited == 1)


def test_op6_query_matches_the_tokenizer(spark):
    tokenizers = pytest.importorskip("tokenizers")
    out, texts = run_query(spark, "op6_token_binary")
    model, at = tokenizers.Tokenizer.from_file(registry.tokenizer_path()), 0
    for r in out.sort_values("doc_id").itertuples():
        ids = [*model.encode(texts[r.doc_id], add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_op7_query_keeps_its_law(spark):
    out, texts = run_query(spark, "op7_balanced_shards")
    assert all((r.size, r.text_crc32) == (len(texts[r.doc_id].encode()) + 1, zlib.crc32(texts[r.doc_id].encode())) for r in out.itertuples())
    sizes = out.groupby("shard")["size"].sum()
    assert set(out["law"]) == {"bytes"} and sorted(sizes.index) == list(range(16)) and out["grown_shard"].isna().all()
    even = sizes.sum() / 16
    assert sizes.max() - sizes.min() <= out["size"].max() and (abs(sizes - even) <= max(0.25 * even, out["size"].max() - even)).all()
    assert all(sorted(own["slot"]) == list(range(len(own))) for _, own in out.groupby("shard"))


def test_op8_query_matches_the_patterns(spark):
    out, texts = run_query(spark, "op8_secret_scan")
    order = ("assign", "access", "hex")
    for r in out.itertuples():
        base = sorted(plain_base(texts[r.doc_id]), key=lambda s: (s[0], order.index(s[2])))
        joined = ",".join(f"{k}:{a}:{b}" for a, b, k in base)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[2] == k for s in base) for k in order)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        spans = [x for x in r.spans.split(",") if x]
        assert [x for x in spans if not x.startswith("novel")] == joined.split(",") * bool(joined) and len(spans) == len(base) + r.n_novel


def test_op9_query_matches_the_scorer(spark):
    out, texts = run_query(spark, "op9_toxicity")
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    score = fit_toxicity(docs, labels).scorer().score
    for r in out.itertuples():
        assert r.score == score(texts[r.doc_id]) and r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_op10_query_matches_a_plain_search(spark):
    out, texts = run_query(spark, "op10_best_fit_packing")
    assert out.groupby("doc_id")["length"].sum().to_dict() == {i: len(t) for i, t in texts.items()}
    for _, own in out.groupby(out["bin_id"] // 2**32):
        own = own.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True])
        want, _ = brute_pack(own["length"].tolist(), own["source"].tolist(), own["cluster"].tolist(), 16_384, 4)
        assert [(b % 2**32, o) for b, o in zip(own["bin_id"], own["bin_offset"], strict=True)] == want


def test_pipeline_on_empty_tables_and_other_columns(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for name, rows in (("documents", docs), ("labels", labels)):
        rows.write.parquet(str(tmp_path / "empty" / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0
    more = spark.createDataFrame([(1, "the same text here twice", None, None, 1), (1, "the same text here twice", None, None, 1), (None, None, "en", "s", None), (3, "", "en", "s", 0)], SCHEMA)
    more = more.withColumns({"copy": F.lit("c"), "score": F.lit(1.5), "id": F.lit("x"), "bands": F.lit(0)})
    more.write.parquet(str(tmp_path / "more" / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "more" / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "more" / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path / "more"))
        if name != "packing":
            assert out.columns == more.columns and {r["copy"] for r in out.collect()} <= {"c"}, name
        out.write.parquet(str(tmp_path / "more" / name))
        now = spark.read.parquet(str(tmp_path / "more" / name))


def test_pipeline_stages_match_plain_ones(spark, tmp_path):
    rows = documents() + [(7000, 'my token = "0123456789abcdef0123" and more', "en", "src1", 1), (7003, "you idiot you utter moron", "en", "x", 1), (7006, "plain words that nobody minds", "en", None, 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("n_chars", F.length("text").cast("long"))
    labels = spark.createDataFrame([(7003, 1, 1), (0, 1, 0)], "doc_id long, quality int, toxic int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    score = fit_toxicity(docs, labels).scorer().score
    left = [r for r in rows if score(r[1] or "") < 0.7]
    assert len(left) < len(rows) and all(r[0] != 7003 for r in left)
    _, comp = brute_near(left, 5)
    left = [r for r in left if comp[r[0]] == r[0]]
    novelty = Novelty()
    left = [(r[0], r[1] if r[1] is None else redact(r[1], find_secrets(r[1], novelty)), *r[2:4]) for r in left]
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"stage{k}"))
        now = spark.read.parquet(str(tmp_path / f"stage{k}"))
        if name == "secret_scan":
            got = sorted(((r["doc_id"], r["text"], r["lang"], r["source"]) for r in now.collect()), key=str)
            assert got == sorted(left, key=str) and all(r["n_chars"] == len(r["text"]) for r in now.collect() if r["text"] is not None)
            mixed = sorted(r["doc_id"] for r in mix_sources(now, corpus_pipeline.WEIGHTS, epochs=corpus_pipeline.EPOCHS).collect())
        if name == "mixing":
            assert sorted(r["doc_id"] for r in now.collect()) == mixed
    packed = now.toPandas()
    assert sorted(packed[packed["piece"] == 0]["doc_id"]) == mixed and packed["bin_used"].max() <= corpus_pipeline.CAPACITY
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(packed) and corpus_pipeline.ORACLE_SQL is None

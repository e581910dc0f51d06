from __future__ import annotations

import math
import random
from collections import Counter

import pyarrow.parquet as pq
import pytest
from edge import SCHEMA, documents, frame
from pyspark.sql import functions as F

from tickloom.llm import mixing, packing
from tickloom.llm.mixing import CHUNK_MEAN, mix_sources, poisson_count, source_rates
from tickloom.llm.packing import Bins, pack_best_fit, pack_window


def test_poisson_counts(spark):
    for mean in (0.1, 1.0, 3.7, CHUNK_MEAN * 3 + 1):
        rows = spark.range(20_000).select(poisson_count(F.lit(mean), F.col("id").cast("string")).alias("n")).toPandas()["n"]
        assert abs(rows.mean() - mean) < 5 * math.sqrt(mean / 20_000) and 0.9 < rows.var() / mean < 1.1
        if mean == 1.0:
            seen = Counter(rows)
            assert all(abs(seen[k] / 20_000 - math.exp(-1) / math.factorial(k)) < 0.02 for k in range(4))
    none = spark.range(3).select(poisson_count(F.lit(0.0), F.lit("a")).alias("n"), poisson_count(F.lit(None).cast("double"), F.lit("a")).alias("m")).collect()
    assert all(tuple(r) == (0, 0) for r in none)


def test_mixing(spark):
    docs = frame(spark, documents())
    weights = {"src0": 3.0, None: 0.0}
    rates = {r["source"]: r for r in source_rates(docs, weights, epochs=40.0).collect()}
    total = sum(r["size"] for r in rates.values())
    assert rates[None]["rate"] == 0 and rates["src0"]["rate"] * rates["src0"]["size"] == pytest.approx(40 * total * 3 / 5)
    out = mix_sources(docs, weights, epochs=40.0).toPandas()
    assert out["source"].notna().all() and sorted(out["position"]) == list(range(len(out)))
    for _, own in out.groupby("doc_id"):
        assert sorted(own["copy"]) == list(range(1, own["n_copies"].iloc[0] + 1))
    again = mix_sources(docs.repartition(7), weights, epochs=40.0).toPandas()
    key = ["position", "doc_id", "copy"]
    assert out[key].sort_values("position").values.tolist() == again[key].sort_values("position").values.tolist()
    order = out.sort_values("position")["doc_id"].tolist()
    assert order != sorted(order) and set(out.columns) == {*docs.columns, "copy", "n_copies", "rate", "position"}


def test_mixing_edges(spark):
    rows = [(None, "a", "en", "s", 1), (None, "a", "en", "s", 1), (5, None, None, None, None), (5, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("copy", F.lit("old")).withColumn("mix_source", F.lit(1)).withColumn("Rate", F.lit(1))
    out = mix_sources(docs, {"s": 1.0}, epochs=5.0).toPandas()
    counts = out.groupby(out["doc_id"].isna())["n_copies"].agg(["first", "size"])
    assert (counts["size"] == 2 * counts["first"]).all() and out["mix_source"].eq(1).all()
    assert mix_sources(spark.createDataFrame([], SCHEMA)).count() == 0


def brute_pack(sizes, sources, clusters, capacity, per_source):
    """The bin of each piece: of all compatible ones the fullest, then the first."""
    bins, out = [], []
    for n, s, c in zip(sizes, sources, clusters, strict=True):
        fit = [(b["left"], k) for k, b in enumerate(bins) if b["left"] >= n and c not in b["clusters"] and b["sources"][s] < per_source]
        if not fit:
            bins.append({"left": capacity, "clusters": set(), "sources": Counter()})
        k = min(fit)[1] if fit else len(bins) - 1
        out.append((k, capacity - bins[k]["left"]))
        bins[k]["left"] -= n
        bins[k]["clusters"].add(c)
        bins[k]["sources"][s] += 1
    return out, [capacity - b["left"] for b in bins]


def test_best_fit_matches_a_plain_search():
    rng = random.Random(3)
    for round_ in range(40):
        n = rng.randrange(1, 250)
        sizes = sorted((rng.randrange(0, 60) for _ in range(n)), reverse=True)
        # few clusters and sources conflict often, many hardly
        kinds = rng.choice([3, 20, n])
        sources, clusters = [rng.choice("aaab") for _ in sizes], [rng.randrange(kinds) for _ in sizes]
        per_source = rng.randrange(1, 5)
        bins, offsets, used = pack_window(sizes, sources, clusters, 100, per_source)
        want, filled = brute_pack(sizes, sources, clusters, 100, per_source)
        assert list(zip(bins, offsets, strict=True)) == want and used == [filled[b] for b in bins], round_
    one = Bins(10, 1)
    assert [one.place(6, 0, 0), one.place(4, 0, 1), one.place(4, 1, 0), one.place(4, 1, 2)] == [(0, 0), (1, 0), (1, 4), (0, 6)]


def test_packing(spark, monkeypatch):
    docs = frame(spark, [*documents(), *documents()[:5], (None, "x" * 70, "en", None, 70)])
    out = pack_best_fit(docs, capacity=1000, per_source=2).toPandas()
    length = sum(len(r[1] or "") for r in documents()) + sum(len(r[1] or "") for r in documents()[:5]) + 70
    assert out["length"].sum() == length and out["length"].max() <= 1000
    for _, own in out.groupby("bin_id"):
        own = own.sort_values(["bin_offset", "length"])
        assert own["length"].sum() == own["bin_used"].iloc[0] <= 1000 and own["cluster"].is_unique
        assert own["source"].fillna("none").value_counts().max() <= 2
        assert (own["bin_offset"] == own["length"].cumsum() - own["length"]).all()
    for _, own in out[out["doc_id"].notna()].drop_duplicates(["doc_id", "piece"]).groupby("doc_id"):
        own = own.sort_values("piece")
        assert own["piece"].tolist() == list(range(len(own))) and (own["start"] == own["piece"] * 1000).all()
    assert out["doc_id"].isna().sum() == 1
    # rows alike are dealt to several windows
    alike = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same text").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(9).cast("long").alias("n_chars"))
    monkeypatch.setattr(packing, "WINDOW", 500)
    spread = pack_best_fit(alike, capacity=100, per_source=2).toPandas()
    assert len(spread) == 3000 and spread["bin_id"].is_unique and (spread["bin_id"] // 2**32).nunique() == 6
    # the query's own parameters, whole: what a bin holds is what its window's plain search puts there
    whole = pack_best_fit(docs, capacity=3000, per_source=3, cluster_col="lang").toPandas()
    for _, own in whole.groupby(whole["bin_id"] // 2**32):
        own = own.assign(key=own["doc_id"].isna()).sort_values(["length", "key", "doc_id", "piece", "cluster", "source"], ascending=[False, False, True, True, True, True], na_position="first")
        want, _ = brute_pack(own["length"].tolist(), own["source"].tolist(), own["cluster"].tolist(), 3000, 3)
        assert sorted((b % 2**32, o) for b, o in zip(own["bin_id"], own["bin_offset"], strict=True)) == sorted(want)
    assert pack_best_fit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hot_ids_are_sorted_by_ranges(spark, monkeypatch):
    """A repeated id fills a bucket; the other way gives the same positions."""
    from tickloom.llm import mixing, packing

    rows = [(None if i % 3 == 0 else i, f"text {i % 40}", "en", "s", 1) for i in range(600)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)

    def placed():
        return sorted((r["position"], r["doc_id"], r["text"], r["copy"]) for r in mix_sources(docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(-1))), epochs=2.0).collect())

    by_buckets = placed()
    assert [p for p, *_ in by_buckets] == list(range(len(by_buckets)))
    monkeypatch.setattr(mixing, "EACH", 20)
    monkeypatch.setattr(mixing, "HOT", 2)
    assert placed() == by_buckets


def test_mix_in_order_is_a_global_shuffle(spark, tmp_path):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("src"), F.col("id") % 3).alias("source"), F.lit(2).cast("long").alias("n_chars"))
    mixing.mix_in_order(docs, {"src0": 2.0}, epochs=2.0).write.parquet(str(tmp_path / "m"))
    want = [r["doc_id"] for r in mix_sources(docs, {"src0": 2.0}, epochs=2.0).orderBy("position").collect()]
    got = [i for f in sorted((tmp_path / "m").glob("part-*.parquet")) for i in pq.read_table(f)["doc_id"].to_pylist()]
    assert got == want and got != sorted(got)
    # neighbours in the output stand far apart in the input
    assert sum(abs(a - b) for a, b in zip(got, got[1:], strict=False)) / len(got) > 500

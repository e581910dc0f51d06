from __future__ import annotations

import hashlib
import math
import random
import re

import numpy as np
import pytest
from edge import SCHEMA, documents, frame, prose
from pyspark.sql import functions as F

from tickloom.llm import minhash
from tickloom.llm.components import components
from tickloom.llm.minhash import Signer, estimates, exact_links, keep_one, near_duplicates, shingle_sets
from tickloom.llm.neighbours import near_vectors
from tickloom.llm.suffixes import remove_repeats


def closure(nodes, links):
    comp = {n: n for n in nodes}

    def root(n):
        while comp[n] != n:
            n = comp[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        comp[b] = a
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("local", [0, 500_000])
def test_components(spark, monkeypatch, local):
    monkeypatch.setattr("tickloom.llm.components.LOCAL_EDGES", local)
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(200)] + [(7, 7)]
    want = closure({n for e in edges for n in e}, edges)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: c for n, c in want.items() if n in got} and all(n in got or all(n not in e or e[0] == e[1] for e in edges) for n in want)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def words_of(text: str | None, k: int) -> set:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def brute_near(rows, k):
    sets = {i: words_of(t, k) for i, t, *_ in rows}
    ids = sorted(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return sets, closure(ids, links)


def check_near(spark, rows, k):
    sets, comp = brute_near(rows, k)
    out = near_duplicates(frame(spark, rows), words=k).toPandas()
    assert len(out) == len(rows)
    for r in out.itertuples():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), comp[r.doc_id], comp[r.doc_id] == r.doc_id), r
    return comp


def test_near_duplicates(spark):
    rows = documents()
    rng = random.Random(8)
    base = prose(rng, 200).split(" ")
    # a star: copies near the first, many of them not near one another
    for i in range(40):
        words = list(base)
        for _ in range(9):
            words[rng.randrange(200)] = f"w{rng.randrange(10**6)}"
        rows.append((5000 + i, " ".join(words), "en", "s", 1))
    rows += [(6000, "A b\x1cc  d", "", "", 1), (6001, "a B\x1cc\td", "", "", 1), (6002, "É x", "", "", 1), (6003, "é x", "", "", 1)]
    for k in (2, 5):
        comp = check_near(spark, rows, k)
        assert len(set(comp.values())) < len(comp) - 10


def test_near_duplicates_in_blocks(spark, monkeypatch):
    """Groups larger than a block, with checks across components."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "CHECKED", 5)
    monkeypatch.setattr(minhash, "HUBS", 4)
    rng = random.Random(3)
    rows = []
    for g in range(3):
        base = prose(rng, 120).split(" ")
        for i in range(50):
            words = list(base)
            for _ in range(rng.randrange(3, 11)):
                words[rng.randrange(120)] = f"w{rng.randrange(10**6)}"
            rows.append((g * 100 + i, " ".join(words), "en", "s", 1))
    check_near(spark, rows, 2)


def test_estimates_and_exact_links():
    rng = np.random.default_rng(0)
    common, signer = rng.integers(0, 1 << 62, 800, dtype=np.uint64), Signer()
    for share in (0.0, 0.5, 0.8, 1.0):
        n = int(800 * share)
        sets = [np.unique(np.concatenate((common[:n], rng.integers(0, 1 << 62, 800 - n, dtype=np.uint64)))) for _ in range(2)]
        bits = signer.packed(signer.sign(sets))
        true = n / (1600 - n)
        assert abs(estimates(bits[0], bits[1:])[0] - true) < 0.17
    sets = [np.unique(np.concatenate((common[: 700 + 5 * i], rng.integers(0, 1 << 62, 40, dtype=np.uint64)))) for i in range(14)]
    n = np.array([len(s) for s in sets])
    args = (np.arange(14), np.arange(14), n, signer.packed(signer.sign(sets)), sets, np.full(14, -1), 0.3, 80, 100)
    i, j = exact_links(*args)
    want = {(a, b) for a in range(14) for b in range(a + 1, 14) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and want


def test_near_edges(spark):
    rows = [(None, "a b c", "", "", 1), (None, None, "", "", 1), (4, "x y z", "", "", 1), (4, "x y z", "", "", 1), (4, "p q r s", "", "", 1), (9, "p q r s", "", "", 1), (2, "x y z", "", "", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit("clash")).withColumn("bands", F.lit(0))
    out = near_duplicates(docs, words=2).toPandas()
    assert out[out["doc_id"].isna()]["kept"].all() and out[out["doc_id"].isna()]["component_id"].isna().all()
    assert set(out[out["doc_id"].notna()]["component_id"]) == {2}
    kept = keep_one(docs, words=2)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "None", "None"]
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0 and keep_one(spark.createDataFrame([], SCHEMA)).count() == 0
    assert shingle_sets([b"", b" \t ", b"a"], 5)[2].size == 1


def brute_repeats(rows, length=100):
    seen, out = set(), {}
    for d, t in sorted((r[0], r[1] or "") for r in rows):
        raw = t.encode()
        covered = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            piece = raw[s : s + length]
            if piece in seen:
                covered[s : s + length] = b"\1" * length
            seen.add(piece)
        rest = bytes(x for x, c in zip(raw, covered, strict=True) if not c)
        spans = sum(1 for i, c in enumerate(covered) if c and (i == 0 or not covered[i - 1]))
        out[d] = (len(raw), sum(covered), spans, hashlib.sha256(rest).hexdigest())
    return out


def check_repeats(spark, rows):
    want = brute_repeats(rows)
    for r in remove_repeats(frame(spark, rows)).collect():
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]], r["doc_id"]
        assert len(r["spans"]) == r["n_spans"] and sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"]


def test_repeats(spark):
    check_repeats(spark, documents())


def test_hot_repeats(spark, monkeypatch):
    """Buckets of many different contexts, refined in tasks and string by string."""
    from tickloom.llm import suffixes

    rng = random.Random(6)
    line = prose(rng, 14)[:80]
    rows = [(i, prose(rng, 15) + line + prose(rng, 3) + rng.choice(["common tail of some length here", prose(rng, 8)]), "en", "s", 1) for i in range(120)]
    check_repeats(spark, rows)
    monkeypatch.setattr(suffixes, "HOT", 3)
    monkeypatch.setattr(suffixes, "TOGETHER", 20)
    check_repeats(spark, rows + [(500, "z" * 700_000, "en", "s", 1), (501, "z" * 99, "en", "s", 1)])


def test_repeat_edges(spark):
    long = prose(random.Random(1), 60)
    rows = [(None, long, "", "", 1), (3, long, "", "", 1), (3, long, "", "", 1), (3, "other " + long, "", "", 1), (7, None, "", "", 1)]
    out = remove_repeats(spark.createDataFrame(rows, SCHEMA).withColumn("d", F.lit(1)).withColumn("h", F.lit(1)), with_bytes=True).toPandas()
    assert out[out["doc_id"].isna()]["n_removed"].tolist() == [0] and out[out["doc_id"] == 7]["n_bytes"].tolist() == [0]
    n = len(long.encode())
    assert sorted(out[out["doc_id"] == 3]["n_removed"]) == [n, n, n] and bytes(out[out["doc_id"].isna()]["kept"].iloc[0]).decode() == long
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def brute_vectors(rows):
    unit = {}
    for i, v in rows:
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, float)
            x /= np.abs(x).max()
            unit[i] = x / np.linalg.norm(x)
    links = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]
    comp = closure([i for i, _ in rows], links)
    return {i: (sum(i in e for e in links), comp[i], comp[i] == i) for i, _ in rows}


def test_vectors(spark):
    rng = np.random.default_rng(7)
    rows = []
    for c in rng.standard_normal((12, 16)):
        rows += [c + rng.standard_normal(16) * s for s in rng.uniform(0, 0.35, 60)]
    rows += list(rng.standard_normal((300, 16))) + [rows[0]] * 3
    rows = [(int(i), [float(np.float32(x)) for x in v]) for i, v in zip(rng.permutation(len(rows)), rows, strict=True)]
    n = len(rows)
    rows += [(n, None), (n + 1, [0.0] * 16), (n + 2, []), (n + 3, [1.0, None] * 8), (n + 4, [float("nan")] * 16), (n + 5, [float("inf")] * 16), (n + 6, rows[0][1][:8]), (n + 7, [x * 1e30 for x in rows[0][1]])]
    out = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rep", F.lit(1))).collect()
    want = brute_vectors([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows])
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in out}
    assert len(out) == len(rows) and sum(w[0] for w in want.values()) > 5000
    missed = sum(want[i][0] - got[i][0] for i in want)
    assert all(got[i][0] <= want[i][0] for i in want) and missed <= 0.001 * sum(w[0] for w in want.values())
    assert {i: g[1:] for i, g in got.items()} == {i: w[1:] for i, w in want.items()}


def test_vector_blocks_and_edges(spark, monkeypatch):
    from tickloom.llm import neighbours

    monkeypatch.setattr(neighbours, "BLOCK", 32)
    rng = np.random.default_rng(1)
    c = rng.standard_normal(8)
    rows = [(i, [float(x) for x in c + rng.standard_normal(8) * 0.05]) for i in range(150)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {i: w[:2] for i, w in brute_vectors(rows).items()}
    odd = spark.createDataFrame([(None, [1.0, 0.0]), (5, [1.0, 0.0]), (5, [1.0, 0.0]), (5, [0.0, 1.0]), (6, [0.0, 2.0])], "vec_id long, embedding array<double>")
    out = near_vectors(odd).toPandas()
    assert sorted(out[out["vec_id"] == 5]["n_links"]) == [1, 1, 1] and set(out[out["vec_id"].notna()]["component_id"]) == {5} and out[out["vec_id"].isna()]["n_links"].tolist() == [0]
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_few_words_in_a_chunk():
    for words in (2, 3, 4, 5, 9):
        for text in (b"hello", b"hello world", b"a b c", b"a b c d"):
            alone = shingle_sets([text], words)
            beside = shingle_sets([text, b"x " * minhash.CHUNK, text], words)
            assert len(alone[0]) >= 1 and (alone[0] == beside[0]).all() and (alone[0] == beside[2]).all()

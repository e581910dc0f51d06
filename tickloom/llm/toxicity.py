"""Toxicity scores from a lexicon that tolerates misspellings and tells quotation from abuse."""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.automata import FuzzyLexicon
from tickloom.llm.common import bounded_batches, discard, id_type, settle

#: Terms that count as toxic where labels teach nothing about them.
BASE_TERMS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "clown", "worthless", "pathetic", "disgusting")
#: Words beside a term that report speech instead of using it.
REPORTING = frozenset("said says quote quoted quotes wrote writes called calls word words term phrase".split())
QUOTES = "\"'«»„“”‘’"
WORD = re.compile(r"\w+")
#: Tokens on either side of a term that make its context window.
CONTEXT = 3
#: Distinct terms that a task counts before it hands the counts on.
MOST_COUNTED = 150_000


@dataclass
class ToxicModel:
    """Terms as (text, is_prefix, max_edits), known harmless look-alikes, and the weights of the score.

    Prefixes in ``dense`` count only where a text holds several words with them, and not by chance.
    """

    terms: list[tuple[str, bool, int]]
    dense: frozenset[str] = frozenset()
    harmless: frozenset[str] = frozenset()
    weights: list[float] = field(default_factory=lambda: [-3.0, 4.5, 0.8, 2.0, 0.3])

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    def __init__(self, model: ToxicModel):
        self.model = model
        self.lexicon = FuzzyLexicon(model.terms)
        self.dense = {k for k, (t, prefix, _) in enumerate(model.terms) if prefix and t in model.dense}

    def hits(self, text: str) -> list[tuple[str, int, int, bool]]:
        """(word, term, edits, quoted) of every hit in the whole text, in order."""
        low = text.lower()
        words = WORD.findall(low)
        match, harmless = self.lexicon.match, self.model.harmless
        found = {w: m for w in set(words) if w not in harmless and (m := match(w))}
        if not found:
            return []
        many = Counter(found[w][0] for w in words if w in found)
        weak = {k for k in self.dense if not is_dense(many[k], len(words))}
        out, recent = [], []
        spans = [(m[0], m.start(), m.end()) for m in WORD.finditer(low)]
        for i, (w, lo, hi) in enumerate(spans):
            if w in found and found[w][0] not in weak:
                recent = [x[0] for x in spans[max(0, i - CONTEXT) : i + CONTEXT + 1]]
                marked = (low[lo - 1 : lo] if lo else "") in QUOTES and low[hi : hi + 1] in QUOTES and lo > 0 and hi < len(low)
                out.append((w, *found[w], marked or any(x in REPORTING for x in recent)))
        return out

    def counts(self, text: str) -> tuple[int, int, int]:
        """Hits that are exact, misspelled, and quoted."""
        hits = self.hits(text)
        quoted = sum(h[3] for h in hits)
        exact = sum(h[2] == 0 and not h[3] for h in hits)
        return exact, len(hits) - quoted - exact, quoted

    def features(self, text: str) -> list[float]:
        return features_of(*self.counts(text))

    def score(self, text: str) -> float:
        return self.score_of(*self.counts(text))

    def score_of(self, exact: int, near: int, quoted: int) -> float:
        z = sum(a * b for a, b in zip(features_of(exact, near, quoted), self.model.weights, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def features_of(exact: int, near: int, quoted: int) -> list[float]:
    return [1.0, float(exact > 0), math.log1p(exact), float(near > 0), math.log1p(quoted)]


def is_dense(hits: int, words: int) -> bool:
    """Whether a family of words is frequent enough in a text to be meant: twice, and one word in a hundred."""
    return hits >= 2 and hits * 100 >= words


def bucket_of(id_col: str) -> Column:
    """crc32(id as text) mod 3; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3


def term_edits(term: str, is_prefix: bool) -> int:
    return 1 if len(term) >= 5 and not is_prefix else 0


def _candidates(words: list[str]) -> set[str]:
    """A text's words; as ``xyz*`` beginnings that may mark a family, and as ``xyz**`` those that are dense in it."""
    seen = Counter(words)
    out = {w for w in seen if 3 <= len(w) <= 40}
    starts: Counter[str] = Counter()
    for w, k in seen.items():
        for n in range(4, min(8, len(w))):
            starts[w[:n]] += k
    out.update(f"{p}*" for p in starts)
    out.update(f"{p}**" for p, k in starts.items() if is_dense(k, len(words)))
    return out


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_train: int = 20_000) -> ToxicModel:
    """Learn the lexicon and weights from labelled rows whose crc32(id) mod 3 is not 1.

    A bounded sample is used: the ``most_train`` ids with the smallest hashes, equal texts once, with
    the label that most of them have (toxic if as many have either).  Nothing else is bounded.
    Words, word beginnings, and beginnings that are dense in a text, are counted by document on the
    executors; those (almost) never seen in clean texts, with more support than chance explains, are
    taken by greedy cover of the toxic texts; all that have the support take part, and all are taken
    that explain as many texts anew.  Which text holds which term is found on the executors; the
    driver gets term numbers, once for texts that hold the same.  Words that only resemble a term
    and occur in clean texts become ``harmless``.  A logistic model over the hits is then fitted.

    Without usable labels the base terms and default weights stand.  Rows with null ids, texts or
    labels teach nothing; very long texts teach as others do.  An empty table teaches nothing.
    """
    bounded_batches(docs)
    seen = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (bucket_of(id_col) != 1)).groupBy(F.col(id_col).alias("tx_id")).agg(F.max(F.col(label_col)).cast("int").alias("y"))
    # ids alone say which rows are the sample; it is small enough to go to every task, so texts stay
    lot = F.xxhash64("tx_id", F.lit("train"))
    last = seen.select(lot.alias("lot")).orderBy("lot").limit(most_train).agg(F.max("lot")).first()[0]
    picked = seen.where(lot <= F.lit(last)) if last is not None else seen.limit(0)
    sample = docs.select(F.col(id_col).alias("tx_id"), F.col(text_col).alias("t")).where(F.col("t").isNotNull()).join(F.broadcast(picked), "tx_id")
    sample = sample.groupBy("t").agg(F.when(F.sum("y") * 2 >= F.count(F.lit(1)), 1).otherwise(0).alias("y"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clean, toxic, among = Counter(), Counter(), Counter()

        def counted() -> pa.RecordBatch:
            keys = list(toxic.keys() | clean.keys())
            return pa.RecordBatch.from_pydict({"term": pa.array(keys, pa.string()), "bad": pa.array([toxic[k] for k in keys], pa.int64()), "good": pa.array([clean[k] for k in keys], pa.int64()), "among": pa.array([among[k] for k in keys], pa.int64())})

        for batch in batches:
            for t, y in zip(batch.column("t").to_pylist(), batch.column("y").to_pylist(), strict=True):
                terms = _candidates(WORD.findall(t.lower()))
                (toxic if y else clean).update(terms)
                if y:
                    own = int.from_bytes(blake2b(t.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)
                    for k in terms:
                        among[k] ^= own
                if len(clean) + len(toxic) > MOST_COUNTED:
                    yield counted()
                    clean.clear()
                    toxic.clear()
                    among.clear()
        yield counted()

    kept = settle(sample.select("t", "y"), "train")
    sizes = {r["y"]: r["n"] for r in kept.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    learned: list[tuple[str, bool, int]] = []
    dense: set[str] = set()
    if bad and good:
        support = max(4, math.ceil(math.log(1e-7) / math.log(max(1e-6, min(0.5, bad / (bad + good))))))
        counts = kept.select("t", "y").mapInArrow(count, "term string, bad long, good long, among long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.bit_xor("among").alias("among"))
        # of terms that stand in the same toxic texts only the one that the cover prefers counts
        rank = F.struct(F.length(F.regexp_replace("term", r"\*+$", "")) - F.length("term"), F.length("term"), "term")
        strong = counts.where((F.col("bad") >= support) & (F.col("good") * 50 <= F.col("bad"))).groupBy("bad", "among").agg(F.max_by("term", rank).alias("term")).select("term").collect()
        terms = sorted((r["term"] for r in strong), key=_preference)
        place = {t: i for i, t in enumerate(terms)}

        def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = [sorted(place[k] for k in _candidates(WORD.findall(t.lower())) if k in place) for t in batch.column("t").to_pylist()]
                yield pa.RecordBatch.from_pydict({"own": pa.array(own, pa.list_(pa.int32()))})

        sets = kept.where("y = 1").select("t").mapInArrow(held, "own array<int>").where(F.size("own") > 0).groupBy("own").agg(F.count(F.lit(1)).alias("n")).toArrow()
        for term in _cover(terms, sets["own"], sets["n"].to_pylist(), support):
            text, prefix = term.rstrip("*"), term.endswith("*")
            if any(t == text and p == prefix for t, p, _ in learned):
                continue
            learned.append((text, prefix, term_edits(text, prefix)))
            if term.endswith("**"):
                dense.add(text)
    have = {t for t, p, _ in learned if not p}
    base = [(t, False, term_edits(t, False)) for t in BASE_TERMS if t not in have and not any(p and t.startswith(x) for x, p, _ in learned)]
    model = ToxicModel(learned + base, frozenset(dense))
    if bad and good:
        _calibrate(model, kept)
    discard(kept)
    return model


def _preference(term: str) -> tuple:
    """Of terms that explain as much the last is taken: without stars, then the longest."""
    return -term.count("*"), len(term), term


def _cover(terms: list[str], sets: Iterable, counts: list[int], support: int) -> list[str]:
    """Greedy cover: a term has to explain ``support`` toxic texts that no earlier term explains.

    ``sets`` are the numbers of the terms that texts hold, ``counts`` how many texts hold just these.
    Copies of one toxic text share all their words; once a term explains them, the rest add nothing.
    """
    where: list[set[int]] = [set() for _ in terms]
    for g, own in enumerate(sets):
        for k in getattr(own, "as_py", lambda own=own: own)():
            where[k].add(g)
    # what a term still explains only shrinks, so one that is first after a recount is first of all
    heap = [(-sum(counts[g] for g in own), -k) for k, own in enumerate(where)]
    heapq.heapify(heap)
    out: list[str] = []
    gone: set[int] = set()
    while heap and -heap[0][0] >= support:
        n, k = heap[0]
        own = where[-k]
        own -= gone
        left = sum(counts[g] for g in own)
        if left < -n:
            heapq.heapreplace(heap, (-left, k))
            continue
        heapq.heappop(heap)
        out.append(terms[-k])
        gone |= own
    return out


def _calibrate(model: ToxicModel, kept: DataFrame) -> None:
    """Fit weights on the sample, after taking out look-alikes that clean texts hold."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches:
            x, y = [], batch.column("y").to_pylist()
            for t in batch.column("t").to_pylist():
                hits = scorer.hits(t)
                x.append(sorted({h[0] for h in hits if h[2] > 0}))
            yield pa.RecordBatch.from_pydict({"y": pa.array(y, pa.int32()), "near": pa.array(x, pa.list_(pa.string()))})

    near = kept.mapInArrow(look, "y int, near array<string>").select("y", F.explode("near").alias("w")).groupBy("w").agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good"))
    model.harmless = frozenset(r["w"] for r in near.where("good > 0 and good * 4 > bad").select("w").collect())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches:
            feats = [scorer.features(t) for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_pydict({"y": pa.array(batch.column("y").to_pylist(), pa.int32()), "x": pa.array(feats, pa.list_(pa.float64()))})

    # in a fixed order, so that sums round alike in every run
    table = kept.mapInArrow(rows, "y int, x array<double>").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).orderBy("x", "y").collect()
    x, y, n = np.array([r["x"] for r in table]), np.array([r["y"] for r in table], float), np.array([r["n"] for r in table], float)
    w = np.array(model.weights)
    prior, strength = w.copy(), np.array([0.01, 0.5, 2.0, 0.5, 2.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (y - p)) - strength * (w - prior)
        hess = (x * (n * p * (1 - p))[:, None]).T @ x + np.diag(strength)
        step = np.linalg.solve(hess, grad)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    model.weights = [float(v) for v in w]


def score_toxicity(docs: DataFrame, model: ToxicModel, *, id_col: str = "doc_id", text_col: str = "text", reject: float = 0.7) -> DataFrame:
    """Score every whole text: the id column, held_out, score, predicted, n_hits, n_near, n_quoted.

    Null and empty texts score the intercept alone; texts of any length are scored whole.  Repeated
    rows score alike; a null id is in the fold of an empty text.  An empty table gives an empty one.
    Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches:
            found = [scorer.counts(t.as_py() or "") for t in batch.column("t")]
            hits, near, quoted = ([f[k] for f in found] for k in range(3))
            scores = [scorer.score_of(*f) for f in found]
            yield pa.RecordBatch.from_arrays([batch.column("tx_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array(hits, pa.int64()), pa.array(near, pa.int64()), pa.array(quoted, pa.int64())], ["tx_id", "held_out", "score", "n_hits", "n_near", "n_quoted"])

    kind = id_type(docs, id_col).simpleString()
    rows = bounded_batches(docs).select(F.col(id_col).alias("tx_id"), (bucket_of(id_col) == 1).alias("held_out"), F.col(text_col).alias("t"))
    out = rows.mapInArrow(run, f"tx_id {kind}, held_out boolean, score double, n_hits long, n_near long, n_quoted long")
    return out.select(F.col("tx_id").alias(id_col), "held_out", "score", (F.col("score") >= reject).cast("int").alias("predicted"), "n_hits", "n_near", "n_quoted")


def drop_toxic(docs: DataFrame, model: ToxicModel, *, text_col: str = "text", reject: float = 0.7) -> DataFrame:
    """The rows of ``docs``, whole, whose text scores below ``reject``.

    Null and empty texts score the intercept alone, texts of any length are scored whole.  Repeated rows
    stay repeated; ids and other columns are not looked at.  An empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches:
            keep = [scorer.score(t.as_py() or "") < reject for t in batch.column(text_col)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return bounded_batches(docs).mapInArrow(run, docs.schema)

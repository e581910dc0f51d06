"""Near-duplicate vectors: collision-counting projections."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import block_pairs, discard, keyed_runs, power_of_two, settle
from tickloom.llm.components import components, least_labels

#: One-dimensional projections whose window collisions are counted for a pair.
PROJECTIONS = 24
#: Vectors that meet in one task; larger cells are cut into blocks, and pairs of blocks.
BLOCK = 4096
#: Vectors that are compared at once with all in reach.
STRIPE = 128
#: Chance that a pair just at the threshold is missed by all cells, and by the count.
MISS_CELLS, MISS_COUNT = 1e-4, 1e-5


def window_of(cosine: float) -> float:
    """Half-width of the query-centred window: two standard deviations of a projected difference at the threshold."""
    return 2 * math.sqrt(2 - 2 * cosine)


def least_count(miss: float = MISS_COUNT, m: int = PROJECTIONS) -> int:
    """The recall-calibrated count: a pair at the threshold has fewer collisions with chance ``miss`` at most."""
    p = math.erf(2 / math.sqrt(2))
    below = 0.0
    for count in range(m + 1):
        below += math.comb(m, count) * p**count * (1 - p) ** (m - count)
        if below > miss:
            return count
    return m


def plan_cells(rows: int, cosine: float, each: int = 1024, miss: float = MISS_CELLS) -> tuple[int, int]:
    """(bits, tables): cells of about ``each`` vectors by signs of ``bits`` projections, and how many such tables."""
    bits = max(1, power_of_two(rows, each, 1 << 24).bit_length() - 1)
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log(1 - agree)))


def count_block(v: np.ndarray, proj: np.ndarray, cells: np.ndarray, table: int, side: np.ndarray, many: np.ndarray, ids: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a cell how many vectors it links with, and the smallest id that these links reach.

    A link is a pair whose cosine reaches the threshold and that no earlier table shares.  Rows are
    taken in the order of the first projection, a stripe at a time; a stripe is compared with the
    rows in its widened window there.  Collisions in the windows of all projections are counted, and
    pairs with the calibrated count are verified.  A stripe keeps only what its links connect.
    """
    order = np.argsort(proj[:, 0], kind="stable")
    p, w, need = np.ascontiguousarray(proj[order].T), np.float32(window_of(cosine)), least_count()
    v, cells, side, many = v[order], cells[order], side[order], many[order]
    reach = np.searchsorted(p[0], p[0] + np.float32(2.5) * w, side="right")
    links = np.zeros(len(order), np.int64)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(order), STRIPE):
        to = min(at + STRIPE, len(order))
        hi = int(reach[at:to].max())
        if hi <= at + 1:
            continue
        count = np.zeros((to - at, hi - at), np.uint8)
        for q in p:
            count += np.abs(q[at:to, None] - q[None, at:hi]) <= w
        good = (count >= need) & (np.arange(at, to)[:, None] < np.arange(at, hi)[None, :])
        if side[0] >= 0:
            good &= side[at:to, None] != side[None, at:hi]
        if not good.any():
            continue
        for k in range(table):
            good &= cells[at:to, k, None] != cells[None, at:hi, k]
        i, j = np.nonzero(good)
        near = np.concatenate([np.einsum("ij,ij->i", v[i[k : k + 20_000] + at], v[j[k : k + 20_000] + at]) >= cosine for k in range(0, len(i), 20_000)] or [np.zeros(0, bool)])
        i, j = i[near] + at, j[near] + at
        np.add.at(links, i, many[j])
        np.add.at(links, j, many[i])
        some = np.unique(np.concatenate((i, j)))
        label = least_labels(np.searchsorted(some, i), np.searchsorted(some, j), some)
        left.append(some[some != label])
        right.append(label[some != label])
    label = least_labels(np.concatenate(left), np.concatenate(right), ids[order])
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return links[back], label[back]


def units(raw: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in doubles; first by their largest component, so that neither huge nor tiny ones overflow."""
    x = raw.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def random_lines(seed: int, dim: int, tables: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The planes whose signs make cells, and the lines that are projected on."""
    rng = np.random.default_rng((seed, dim))
    return rng.standard_normal((dim, tables * bits)), rng.standard_normal((dim, PROJECTIONS))


def near_vectors(vectors: DataFrame, *, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 5) -> DataFrame:
    """Link vectors whose cosine, in double precision, is at least ``cosine``.

    Returns a row a vector: the id column (long), n_links (other vectors linked directly),
    component_id (smallest id that links reach, itself included), kept (whether it is its own).

    Equal vectors are one class with a multiplicity; its code is a hash, since repeated ids may lead several.  Signs of a few projections deal the classes
    to cells, in as many tables as make a pair at the threshold share one but for MISS_CELLS.  In
    a cell, projections are sorted and each row counts window collisions with the rows near it;
    pairs with the calibrated count are verified.  A pair is counted in the first table that it
    shares, so links add up without any pair leaving its task; components get one edge a row.

    A dense cell is cut into blocks whose pairs are compared; a vector travels once a table, and in a
    cell of several blocks once a block.

    Null vectors and those that are empty, zero or hold null or non-finite components link with
    nothing, as do vectors of different dimensions.  Rows with equal ids count one by one in
    n_links and share a component; ids are whole numbers.  A null id has a null component, is kept and links with
    nothing.  Empty tables give empty ones.  Other columns, whatever their names, are not read.
    """
    # single-precision vectors travel as such: nothing is lost, and cosines are taken in doubles
    kind = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    number = np.float32 if kind == "float" else np.float64
    v = F.col(vector_col).cast(f"array<{kind}>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0) & (F.size(v) > 0)
    zero = F.lit(0.0).cast(kind)
    rows = settle(vectors.select(F.col(id_col).cast("long").alias("id"), F.when(fine & F.col(id_col).isNotNull(), F.transform(v, lambda x: x + zero)).alias("v")), "vectors")
    classes = settle(rows.where("v IS NOT NULL").groupBy("v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("many")).withColumn("code", F.xxhash64("v")), "classes")
    n = classes.count()
    bits, tables = plan_cells(n, cosine)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            out: list[tuple] = []
            for rep, many, code, values in zip(*[batch.column(c).to_pylist() for c in ("rep", "many", "code")], batch.column("v"), strict=True):
                raw = values.values.to_numpy().astype(number)
                if len(raw) not in made:
                    made[len(raw)] = random_lines(seed, len(raw), tables, bits)
                signs = (units(raw[None, :])[0] @ made[len(raw)][0] > 0).reshape(tables, bits)
                cells = (signs @ (1 << np.arange(bits, dtype=np.int64))).astype(np.int32)
                out.append((rep, many, code, raw.tobytes(), cells.tobytes(), cells.tolist(), len(raw)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["rep", "many", "code", "x", "own_cells", "cells", "dim"])

    placed = settle(classes.mapInArrow(deal, "rep long, many long, code long, x binary, own_cells binary, cells array<int>, dim int"), "cells")
    sizes = placed.select("dim", F.posexplode("cells").alias("table", "cell")).groupBy("dim", "table", "cell").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    keyed = placed.select("rep", "many", "code", "x", "own_cells", "dim", F.posexplode("cells").alias("table", "cell"))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    # tables x cells rows: a few thousand vectors a row
    sizes = F.broadcast(sizes) if tables << bits <= 1 << 16 else sizes
    dealt = block_pairs(keyed.join(sizes, ["dim", "table", "cell"]), blocks, "code").select("dim", "table", "cell", "i", "j", "own", "rep", "many", "code", "x", "own_cells")
    key = ["dim", "table", "cell", "i", "j"]
    dealt = dealt.repartition(*key).sortWithinPartitions(*key, "rep", "code")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in keyed_runs(batches, key):
            ids, many, own = (t[c].to_numpy() for c in ("rep", "many", "own"))
            raw = np.frombuffer(b"".join(t["x"].to_pylist()), number).reshape(len(ids), -1)
            cells = np.frombuffer(b"".join(t["own_cells"].to_pylist()), np.int32).reshape(len(ids), -1)
            x = units(raw)
            p = (x @ random_lines(seed, raw.shape[1], tables, bits)[1]).astype(np.float32)
            side = own if t["i"][0] != t["j"][0] else np.full(len(ids), -1)
            links, label = count_block(x, p, cells, t["table"][0].as_py(), side, many, ids, cosine)
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), t["code"].combine_chunks().take(pa.array(some)), pa.array(links[some]), pa.array(label[some])], ["rep", "code", "links", "label"])

    found = settle(dealt.mapInArrow(compare, "rep long, code long, links long, label long"), "vector_links")
    ties = rows.where("v IS NOT NULL").join(classes.select("v", "rep"), "v").groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("a", "b")
    comp = components(found.select(F.col("rep").alias("a"), F.col("label").alias("b")).union(ties))
    links = found.groupBy("rep", "code").agg(F.sum("links").alias("links"))
    facts = classes.join(links, ["rep", "code"], "left").join(comp, F.col("rep") == F.col("node"), "left")
    out = rows.join(facts.select("v", "rep", (F.col("many") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("comp")), "v", "left")
    discard(placed)
    component = F.coalesce("comp", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))

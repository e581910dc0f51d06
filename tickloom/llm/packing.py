"""Packing texts into bins of fixed capacity: conflict-constrained best fit."""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import id_type, settle

#: Pieces that are packed together; a window holds all open bins, so this bounds a task's memory.
WINDOW = 8192


class Bins:
    """Open bins ordered by residual; each carries bitmaps of its sources and duplicate clusters.

    ``place`` starts at the smallest residual that holds the piece and goes on to the successors
    until a bin has neither the piece's cluster nor its source in every plane: that bin is the
    tightest compatible one, and of those with one residual the first that was opened.  Which
    residuals have bins is one integer's bits, so a successor is found by shifting it.
    """

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.at: dict[int, list[int]] = {}
        self.mask = 0
        self.sources: list[list[int]] = []  # a bin's planes: bit s of plane i: it holds more than i pieces of source s
        self.clusters: list[int] = []
        self.used: list[int] = []

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        s, c = 1 << source, 1 << cluster
        last, residual = self.per_source - 1, size
        while rest := self.mask >> residual:
            residual += (rest & -rest).bit_length() - 1
            for b in self.at[residual]:
                if not self.clusters[b] & c and not self.sources[b][last] & s:
                    self._take(b, residual)
                    return b, self._add(b, size, s, c)
            residual += 1
        b = len(self.used)
        self.sources.append([0] * self.per_source)
        self.clusters.append(0)
        self.used.append(0)
        return b, self._add(b, size, s, c)

    def _take(self, b: int, residual: int) -> None:
        own = self.at[residual]
        own.remove(b)
        if not own:
            del self.at[residual]
            self.mask ^= 1 << residual

    def _add(self, b: int, size: int, s: int, c: int) -> int:
        offset = self.used[b]
        self.used[b] += size
        self.clusters[b] |= c
        plane = next(i for i, p in enumerate(self.sources[b]) if not p & s)
        self.sources[b][plane] |= s
        residual = self.capacity - self.used[b]
        insort(self.at.setdefault(residual, []), b)
        self.mask |= 1 << residual
        return offset


def pack_window(sizes: list[int], sources: list, clusters: list[int], capacity: int, per_source: int) -> tuple[list[int], list[int], list[int]]:
    """Bins, offsets and fills of pieces that come largest first."""
    bins, ids, kinds = Bins(capacity, per_source), {}, {}
    placed = [bins.place(n, ids.setdefault(s, len(ids)), kinds.setdefault(c, len(kinds))) for n, s, c in zip(sizes, sources, clusters, strict=True)]
    return [b for b, _ in placed], [o for _, o in placed], [bins.used[b] for b, _ in placed]


def pack_best_fit(
    docs: DataFrame,
    *,
    capacity: int = 16_384,
    per_source: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    cluster_col: str | None = None,
) -> DataFrame:
    """Place every text in bins of ``capacity`` code points, by best fit, largest first.

    Two pieces of one duplicate cluster (``cluster_col``; by default: equal texts) never share a
    bin, and a bin holds at most ``per_source`` pieces of one source.  A text longer than a bin is
    cut into pieces of ``capacity`` and a rest; pieces of one text have different clusters.

    Returns one row a piece: the id column, ``piece`` (from 0), ``start`` and ``length`` in code
    points, ``source`` (text), ``cluster`` long, ``bin_id`` long, ``bin_offset``, ``bin_used``.
    Rows are dealt by a hash to windows of about 8,192 pieces, each packed on its own; only
    lengths, sources and hashes are shuffled, never texts.  Rows alike are counted first and then
    numbered, so they are dealt to different windows; a window that chance makes much larger is
    packed in runs of 4 times that, so no task holds an unbounded group.

    Null and empty texts are one piece of length 0; a very long text is as many pieces as it fills
    bins.  Null ids and sources are values like others.  Repeated rows are placed once each, in
    different bins.  An empty table gives an empty one.  Other columns are not read, whatever their
    names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    cluster = F.xxhash64(text) if cluster_col is None else F.xxhash64(F.col(cluster_col).cast("string"))
    length = F.char_length(text).cast("long")
    rows = docs.select(F.col(id_col).alias("pk_id"), F.col(source_col).cast("string").alias("source"), length.alias("n"), cluster.alias("c"))
    rows = rows.groupBy("pk_id", "source", "n", "c").agg(F.count(F.lit(1)).alias("alike"))
    rows = settle(rows, "to_pack")
    pieces = F.greatest(F.ceil(F.col("n") / capacity), F.lit(1)).cast("int")
    total = rows.agg(F.sum(pieces * F.col("alike"))).first()[0] or 0
    groups = max(1, -(-int(total) // WINDOW))
    cut = rows.select("pk_id", "source", "n", "c", "alike", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"))
    cut = cut.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("alike"))).alias("number"))
    cut = cut.select(
        "pk_id",
        "piece",
        (F.col("piece").cast("long") * capacity).alias("start"),
        F.greatest(F.least(F.col("n") - F.col("piece").cast("long") * capacity, F.lit(capacity)), F.lit(0)).cast("long").alias("length"),
        "source",
        F.when(F.col("piece") == 0, F.col("c")).otherwise(F.xxhash64("c", "piece")).alias("cluster"),
        "number",
    ).withColumn("window", F.pmod(F.xxhash64("pk_id", "piece", "cluster", "number"), F.lit(groups)))
    # a task packs its windows one after the other
    partitions = min(groups, max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), groups // 64))
    dealt = cut.repartition(partitions, "window").sortWithinPartitions("window", F.desc("length"), "pk_id", "piece", "cluster", "source", "number").drop("number")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(part: pa.Table, window: int, first: int) -> tuple[list[pa.RecordBatch], int]:
            b, o, u = pack_window(part["length"].to_pylist(), part["source"].to_pylist(), part["cluster"].to_pylist(), capacity, per_source)
            out = part.drop_columns(["window"])
            for name, values in (("bin_id", [(window << 32) + first + x for x in b]), ("bin_offset", o), ("bin_used", u)):
                out = out.append_column(name, pa.array(values, pa.int64()))
            return out.combine_chunks().to_batches(), first + max(b) + 1

        held: list[pa.RecordBatch] = []
        n, window, first = 0, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column("window").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(own)) + 1), len(own)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                w = int(own[lo])
                if held and (w != window or n >= 4 * WINDOW):
                    out, first = packed(pa.Table.from_batches(held), window, first)
                    yield from out
                    held, n = [], 0
                if w != window:
                    window, first = w, 0
                held.append(batch.slice(lo, hi - lo))
                n += hi - lo
        if held:
            yield from packed(pa.Table.from_batches(held), window, first)[0]

    kind = id_type(docs, id_col).simpleString()
    done = dealt.mapInArrow(run, f"pk_id {kind}, piece int, start long, length long, source string, cluster long, bin_id long, bin_offset long, bin_used long")
    return done.withColumnRenamed("pk_id", id_col)

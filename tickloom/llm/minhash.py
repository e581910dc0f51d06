"""Near-duplicate texts: b-bit MinHash signatures, banding, and exact checks on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import bounded_batches, discard, fresh, keyed_runs, settle
from tickloom.llm.components import components, least_labels

#: Minima in a band and bands.  A pair at similarity 0.8 shares none of 30 bands of 5 once in 150,000 times.
ROWS, BANDS = 5, 30
#: Low bits kept of each minimum; packed, 150 of them take 75 bytes.
BITS = 4
#: Pairs whose estimate is this many standard errors below the threshold are not checked.
ERRORS = 4.5
#: Members of a bucket whose estimates are compared together; larger buckets are cut into blocks of this size.
BLOCK = 1024
#: Members of a large bucket, about, that stand in every one of its blocks and so tie them together.
HUBS = 16
#: Members, and shingles of full sets, of a block whose members are checked against another block's.
CHECKED, SHINGLES = 64, 100_000
#: Bytes of text that are hashed at once.
CHUNK = 1 << 19
#: Ids up to which the documents to check are picked by a broadcast and not by a shuffle of texts.
PICKED = 200_000

_B = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse; those for usual lengths are kept."""

    def __init__(self):
        self.kept = self._make(CHUNK + CHUNK // 4)

    @staticmethod
    def _make(n: int) -> tuple[np.ndarray, np.ndarray]:
        back = np.uint64(pow(int(_B), -1, 1 << 64))
        return tuple(np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, base, np.uint64), dtype=np.uint64))) for base in (_B, back))

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        up, down = self.kept if n <= len(self.kept[0]) else self._make(n)
        return up[:n], down[:n]


_powers = Powers()


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles of ``words`` words.

    A-Z count as a-z; words are runs of bytes other than blanks and 0x09 to 0x0D.  A text with
    fewer words has its whole sequence as one shingle; without words it has none.
    """
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        size, to = 0, at
        while to < len(texts) and (to == at or size + len(texts[to]) < CHUNK):
            size += len(texts[to]) + 1
            to += 1
        out += _chunk_sets(texts[at:to], words)
        at = to
    return out


def _chunk_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    c = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    c = np.where((c >= 65) & (c <= 90), c + np.uint8(32), c)
    full = ~((c == 32) | ((c >= 9) & (c <= 13)))
    edge = np.diff(full.astype(np.int8), prepend=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers.of(len(c) + 1)
    sums = np.concatenate(([np.uint64(0)], np.cumsum((c.astype(np.uint64) + np.uint64(1)) * up[: len(c)], dtype=np.uint64)))
    h = mix64(((sums[end] - sums[start]) * down[start]) ^ mix64((end - start).astype(np.uint64)))
    # where each text's words begin among all words
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    first = np.searchsorted(start, np.concatenate(([0], np.cumsum(lengths))))
    n = np.diff(first)
    whole = h.copy()
    for k in range(1, words):
        m = max(len(h) - k, 0)
        whole[:m] = mix64(whole[:m] * np.uint64(3) + h[k:] + np.uint64(k))
    out = []
    for lo, hi, count in zip(first[:-1].tolist(), first[1:].tolist(), n.tolist(), strict=True):
        if count >= words:
            out.append(np.unique(whole[lo : hi - words + 1]))
        elif count:
            x = np.array([count], np.uint64)
            for y in h[lo:hi]:
                x = mix64(x * np.uint64(5) + y)
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class Signer:
    """Minima of a set under many bijections, their bands, and their low bits packed."""

    def __init__(self, rows: int = ROWS, bands: int = BANDS, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.rows, self.bands = rows, bands
        self.mul = rng.integers(0, 1 << 63, rows * bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = rng.integers(0, 1 << 63, rows * bands, dtype=np.uint64)

    def sign(self, sets: list[np.ndarray]) -> np.ndarray:
        """A row of minima for each nonempty set."""
        flat = np.concatenate(sets)
        starts = np.cumsum([0, *[len(s) for s in sets[:-1]]])
        out = np.empty((len(sets), len(self.mul)), np.uint64)
        for k, (m, a) in enumerate(zip(self.mul, self.add, strict=True)):
            out[:, k] = np.minimum.reduceat(flat * m + a, starts)
        return out

    def band_keys(self, minima: np.ndarray) -> np.ndarray:
        x = mix64(minima).reshape(len(minima), self.bands, self.rows)
        key = np.tile(np.arange(1, self.bands + 1, dtype=np.uint64), (len(minima), 1))
        for r in range(self.rows):
            key = mix64(key * np.uint64(7) + x[:, :, r])
        return key.view(np.int64)

    def packed(self, minima: np.ndarray) -> np.ndarray:
        """The low BITS bits of all minima, 16 to a 64-bit word."""
        low = minima & np.uint64((1 << BITS) - 1)
        each = 64 // BITS
        low = np.pad(low, ((0, 0), (0, -low.shape[1] % each))).reshape(len(low), -1, each)
        return np.bitwise_or.reduce(low << (np.arange(each, dtype=np.uint64) * np.uint64(BITS)), axis=2)


def estimates(one: np.ndarray, many: np.ndarray, k: int = ROWS * BANDS) -> np.ndarray:
    """Similarity from packed low bits, corrected for minima that agree in them by chance."""
    x = one ^ many
    x = (x | x >> np.uint64(1)) | (x | x >> np.uint64(1)) >> np.uint64(2)
    differ = np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(axis=1, dtype=np.int64)
    chance = 1 / (1 << BITS)
    return ((k - differ) / k - chance) / (1 - chance)


def likely(i: int, among: np.ndarray, comp: np.ndarray, n: np.ndarray, bits: np.ndarray, side: np.ndarray, least: float, part: int, whole: int) -> np.ndarray:
    """Estimates of row i with the rows ``among``; -1 where a link is impossible or tells nothing new."""
    est = estimates(bits[i], bits[among])
    fits = np.minimum(n[i], n[among]) * whole >= np.maximum(n[i], n[among]) * part
    return np.where(fits & (est >= least) & (comp[i] != comp[among]) & ((side[i] != side[among]) | (side[i] < 0)), est, -1.0)


def spanning(ids: np.ndarray, n: np.ndarray, bits: np.ndarray, side: np.ndarray, least: float, part: int, whole: int) -> list[tuple[int, int]]:
    """A maximum spanning forest of a bucket's members by estimated similarity, over pairs that may link."""
    best, near = np.full(len(ids), -1.0), np.zeros(len(ids), np.int64)
    left = np.ones(len(ids), bool)
    out: list[tuple[int, int]] = []
    i = 0
    for _ in range(len(ids) - 1):
        left[i] = False
        rest = np.flatnonzero(left)
        est = likely(i, rest, ids, n, bits, side, least, part, whole)
        better = est > best[rest]
        best[rest[better]], near[rest[better]] = est[better], i
        i = int(rest[np.argmax(best[rest])])
        if best[i] >= 0:
            out.append((int(ids[near[i]]), int(ids[i])))
    return out


def exact_links(ids: np.ndarray, comp: np.ndarray, n: np.ndarray, bits: np.ndarray, sets: list[np.ndarray], side: np.ndarray, least: float, part: int, whole: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs, in different components, whose sets are similar enough; every likely pair is checked.

    Many pairs are counted together: a product of 0/1 matrices over the shingles that several rows
    hold, some columns at a time, gives all intersections.
    """
    rows = np.arange(len(ids))
    picked = [rows[i + 1 :][likely(i, rows[i + 1 :], comp, n, bits, side, least, part, whole) >= 0] for i in rows[:-1]]
    i, j = np.repeat(rows[:-1], [len(p) for p in picked]), np.concatenate(picked or [rows[:0]])
    if len(i) <= 4 * len(ids):
        common = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], np.int64)
    else:
        row = np.repeat(rows, [len(s) for s in sets])
        _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        place = np.cumsum(count > 1) - 1
        several = count[column] > 1
        row, column = row[several], place[column[several]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        total = np.zeros((len(ids), len(ids)), np.float32)
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            lo, hi = np.searchsorted(column, [at, at + 4096])
            held = np.zeros((len(ids), 4096), np.float32)  # float32 counts exactly to 2**24; 4,096 are added at a time
            held[row[lo:hi], column[lo:hi] - at] = 1
            total += held @ held.T
        common = total[i, j].astype(np.int64)
    good = whole * common >= part * (n[i] + n[j] - common)
    return i[good], j[good]


def signatures(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """One row a document: id, n, two halves of a digest of its set, band keys, packed bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sets = shingle_sets([(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column("t")], words)
                some = [i for i, s in enumerate(sets) if len(s)]
                bands: list = [[] for _ in sets]
                bits: list = [b"" for _ in sets]
                if some:
                    minima = signer.sign([sets[i] for i in some])
                    for i, k, p in zip(some, signer.band_keys(minima), signer.packed(minima), strict=True):
                        bands[i], bits[i] = k, p.tobytes()
                one = [int(mix64(s).sum(dtype=np.uint64).view(np.int64)) for s in sets]
                two = [int(mix64(s ^ _B).sum(dtype=np.uint64).view(np.int64)) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(bits, pa.binary())], ["id", "n", "s1", "s2", "bands", "bits"]
                )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, "id long, n long, s1 long, s2 long, bands array<long>, bits binary")


def full_sets(docs: DataFrame, ids: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(id, set array<long>) of the documents named by ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sets = shingle_sets([(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column("t")], words)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["id", "set"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    few = ids.count() <= PICKED
    return rows.join(F.broadcast(ids) if few else ids, "id", "left_semi").mapInArrow(run, "id long, set array<long>")


def near_duplicates(docs: DataFrame, *, words: int = 5, part: int = 80, whole: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Link documents whose shingle sets have ``whole`` * intersection >= ``part`` * union.

    Returns one row a document: the id column (long), n_shingles, component_id (smallest id that
    links reach, itself included), kept (whether that is its own id).

    Documents with equal sets are one class, found by a digest, and only its least id goes on.
    Classes sharing a band are candidates.  In each bucket of candidates a maximum spanning forest
    by b-bit estimate is checked on full sets first; a large bucket is cut into blocks that share a
    few hubs.  Where a check fails, the bucket's tree holds several components; then members outside
    of its largest component are checked against all likely ones, inside tasks that get the full
    sets and give back only what connects.  So no link that the estimate admits is lost, a group of
    copies costs about one check a member, and what one task holds is bounded.

    Very long texts are hashed in bounded chunks of texts.  Columns of other names are not read.
    Null, empty and blank texts have no shingles and link with nothing.  Rows with equal ids count
    as one document; ids are whole numbers.  A null id has a null component and is kept.  Empty tables
    give empty ones.
    """
    bounded_batches(docs)
    sig = settle(signatures(docs, words, id_col, text_col), "signatures")
    classes = settle(sig.where("n > 0 AND id IS NOT NULL").groupBy("s1", "s2", "n").agg(F.min("id").alias("rep")), "classes")
    found = _links(docs, sig, classes, words, part, whole, id_col, text_col)
    # rows with one id but several sets tie their classes together
    same = sig.where("n > 0 AND id IS NOT NULL").join(classes, ["s1", "s2", "n"]).select("id", "rep")
    ties = same.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("a", "b")
    comp = components(found.select("a", "b").union(ties))
    member = sig.join(classes, ["s1", "s2", "n"], "left").select("id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("rep")).alias("rep"))
    out = member.join(comp, F.col("rep") == F.col("node"), "left")
    component = F.coalesce("component", "rep", "id")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("id").isNotNull(), component).alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def _links(docs: DataFrame, sig: DataFrame, classes: DataFrame, words: int, part: int, whole: int, id_col: str, text_col: str) -> DataFrame:
    """Checked links (a, b) between classes, enough to connect what is connected."""
    reps = sig.join(classes, ["s1", "s2", "n"], "left_semi").join(classes.select(F.col("rep").alias("id")), "id", "left_semi").dropDuplicates(["id"]).select("id", "n", "bits", "bands")
    reps = settle(reps, "reps")
    keys = reps.select("id", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = settle(keys.join(shared, "key").join(reps.select("id", "n", "bits"), "id"), "members")
    least = part / whole - ERRORS * float(np.sqrt(0.1525 / (ROWS * BANDS))) / (1 - 1 / (1 << BITS))

    edges = settle(_forests(members, least, part, whole), "pairs")
    discard(members)
    links = settle(_checked(edges.where("likely").select("a", "b").distinct(), docs, words, part, whole, id_col, text_col), "checked")
    trees = components(edges.select("a", "b")).select(F.col("node").alias("id"), F.col("component").alias("tree"))
    comp = components(links).select(F.col("node").alias("id"), "component")
    placed = settle(trees.join(comp, "id", "left").select("id", "tree", F.coalesce("component", "id").alias("comp")).join(reps.select("id", "n", "bits"), "id"), "trees")
    # a row a component of the trees that have several: how much stands in its largest one and outside
    per_comp = placed.groupBy("tree", "comp").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("total"))
    per_tree = per_comp.groupBy("tree").agg(F.max(F.struct("k", "comp", "total")).alias("main"), F.sum("k").alias("k"), F.sum("total").alias("total")).where("k > main.k")

    def blocks(members: Column, shingles: Column) -> Column:
        return F.greatest(F.ceil(F.greatest(members / CHECKED, shingles / SHINGLES)).cast("int"), F.lit(1))

    split = per_tree.select("tree", F.col("main.comp").alias("main"), blocks(F.col("k") - F.col("main.k"), F.col("total") - F.col("main.total")).alias("outer"), blocks(F.col("main.k"), F.col("main.total")).alias("inner"))
    apart = settle(placed.join(split, "tree"), "apart")
    again = settle(_across(apart, docs, least, words, part, whole, id_col, text_col), "links_across")
    return links.union(again)


def _forests(members: DataFrame, least: float, part: int, whole: int) -> DataFrame:
    """Edges (a, b, likely) from members (key, size, id, n, bits) of the buckets.

    Likely ones are forests of pairs to check first.  The others say that members of a bucket of
    several blocks belong together without having been compared.  Each block of such a bucket also
    holds its hubs, picked by a hash, so the forests meet; rows grow by HUBS a block.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    hub = (blocks > 1) & (F.pmod(F.xxhash64("id", F.lit("hub")), F.greatest(F.ceil(F.col("size") / HUBS), F.lit(1))) == 0)
    places = F.when(hub, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), blocks).cast("int")))
    dealt = members.select("key", (blocks > 1).alias("cut"), hub.alias("hub"), "id", "n", "bits", F.explode(places).alias("block"))
    dealt = dealt.repartition("key", "block").sortWithinPartitions("key", "block", F.desc("hub"), "n", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        likely_, other = set(), set()
        for rows in keyed_runs(batches, ["key", "block"]):
            ids, n = (rows[c].to_numpy() for c in ("id", "n"))
            bits = np.frombuffer(b"".join(rows["bits"].to_pylist()), np.uint64).reshape(len(ids), -1)
            likely_.update((min(p), max(p)) for p in spanning(ids, n, bits, np.full(len(ids), -1), least, part, whole))
            if rows["cut"][0].as_py():
                # the first row is a hub that every block holds
                first = int(ids[0])
                other.update((min(first, i), max(first, i)) for i in ids[1:].tolist())
            if len(likely_) + len(other) > 100_000:
                yield _edge_batch(likely_, other)
                likely_, other = set(), set()
        yield _edge_batch(likely_, other)

    return dealt.mapInArrow(run, "a long, b long, likely boolean").distinct()


def _edge_batch(likely_: set[tuple[int, int]], other: set[tuple[int, int]]) -> pa.RecordBatch:
    both = pa.Table.from_batches([_pair_batch(likely_), _pair_batch(other)]).combine_chunks()
    flags = np.arange(both.num_rows) < len(likely_)
    return pa.RecordBatch.from_arrays([both["a"].combine_chunks(), both["b"].combine_chunks(), pa.array(flags)], ["a", "b", "likely"])


def _across(apart: DataFrame, docs: DataFrame, least: float, words: int, part: int, whole: int, id_col: str, text_col: str) -> DataFrame:
    """Links (a, b) across the components of a tree, from (tree, main, outer, inner, id, comp, n, bits).

    A tree's members outside of its main component are dealt to ``outer`` blocks and those of it to
    ``inner`` ones.  Members of the main one need no company of their own, so an inner block goes to
    each outer block only, and an outer block to all: the work is what stands outside times the tree.
    """
    sets = full_sets(docs, apart.select("id"), words, id_col, text_col).dropDuplicates(["id"])
    lot = F.xxhash64("id", F.lit("block"))
    out = F.col("comp") != F.col("main")
    own = F.when(out, F.pmod(lot, F.col("outer"))).otherwise(F.col("outer") + F.pmod(lot, F.col("inner"))).cast("int")
    meets = F.when(out, F.sequence(F.lit(0), F.col("outer") + F.col("inner") - 1)).otherwise(F.sequence(F.lit(0), F.col("outer") - 1))
    dealt = apart.join(sets, "id").withColumn("own", own).withColumn("with", F.explode(meets))
    dealt = dealt.select("tree", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", "id", "comp", "n", "bits", "set")
    dealt = dealt.repartition("tree", "i", "j").sortWithinPartitions("tree", "i", "j", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in keyed_runs(batches, ["tree", "i", "j"]):
            ids, comp, n, own = (rows[c].to_numpy() for c in ("id", "comp", "n", "own"))
            if comp.min() == comp.max():
                continue
            bits = np.frombuffer(b"".join(rows["bits"].to_pylist()), np.uint64).reshape(len(ids), -1)
            own_sets = [s.values.to_numpy().view(np.uint64) for s in rows["set"]]
            side = own if rows["i"][0] != rows["j"][0] else np.full(len(ids), -1)
            label = least_labels(*exact_links(ids, comp, n, bits, own_sets, side, least, part, whole), ids)
            yield _pair_batch({(int(b), int(a)) for a, b in zip(ids, label, strict=True) if a != b})

    return dealt.mapInArrow(run, "a long, b long")


def _pair_batch(pairs: set[tuple[int, int]]) -> pa.RecordBatch:
    rows = list(pairs)
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in rows], pa.int64()), pa.array([p[1] for p in rows], pa.int64())], ["a", "b"])


def _checked(pairs: DataFrame, docs: DataFrame, words: int, part: int, whole: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    ids = settle(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), "to_check")
    sets = settle(full_sets(docs, ids, words, id_col, text_col).dropDuplicates(["id"]), "sets")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    return both.select("a", "b", common.alias("c"), (F.size("sa").cast("long") + F.size("sb")).alias("t")).where(F.lit(whole) * F.col("c") >= F.lit(part) * (F.col("t") - F.col("c"))).select("a", "b")


def keep_one(docs: DataFrame, *, words: int = 5, part: int = 80, whole: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps: one document of each group.

    Rows with the kept id are all kept, since they are one document to ``near_duplicates``; where ids
    are unique, as in ``documents``, that is one row a group.  Null, empty and blank texts all stay.
    """
    gone = near_duplicates(docs, words=words, part=part, whole=whole, id_col=id_col, text_col=text_col).where("NOT kept").select(F.col(id_col).alias("md_gone")).distinct()
    name = fresh(docs, "md_key")
    return docs.withColumn(name, F.col(id_col).cast("long")).join(F.broadcast(gone) if gone.count() <= PICKED else gone, F.col(name) == F.col("md_gone"), "left_anti").drop(name)

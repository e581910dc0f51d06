"""Removal of long repeated byte strings: bucket-pointer refinement of anchored suffixes.

Every byte position starts a suffix.  Two suffixes matter to each other only if they agree on
``length`` bytes, and then the same q-gram of those bytes has the least hash in both: their anchor.
So suffixes are put in buckets by their anchor's q-gram.  A bucket is refined by sorting on the
bucket identifiers of later offsets, and identifiers of refined buckets are used again for the next,
twice as long, until suffixes with one identifier agree on ``length`` bytes.

Suffixes that share an anchor travel together as one context, whose identifier is built in the same
way from those of its q-grams; equal contexts count as one.  So the shuffled work follows the anchors
(one in 35 bytes).  Contexts that differ within a bucket, where repeated passages begin and end, are
refined inside tasks from their bytes.  Identifiers that travel are 64-bit names: two contexts of one
q-gram, place and length that differ are taken for equal with a chance of 2**-64.  Inside tasks,
buckets hold by their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.llm.common import bounded_batches, discard, id_type, settle
from tickloom.llm.minhash import PICKED, Powers, mix64

GRAM = 32
#: Bytes of text that are anchored at once; positions must fit in 20 bits.
CHUNK = 1 << 19
#: Different contexts of an anchor up to which one task refines them; beyond, each string is a key of its own.
HOT = 4096
#: Contexts that are refined together.
TOGETHER = 2048
#: Documents of which one in SAMPLE is looked at to find q-grams that one document in COMMON, and LEAST of them, hold.
#: Contexts of those are buckets of their own; nothing else depends on it.  At most COMMON q-grams for each anchor of a usual text qualify.
SAMPLE, COMMON, LEAST = 64, 64, 12

_powers = Powers()


def anchors_of(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(text, anchor, first start, last start, gram hash, context hash) of every anchor.

    An anchor is the leftmost of the q-grams with the least hash in a string of ``length`` bytes; it
    owns the strings, with consecutive starts, that chose it.
    """
    parts: list[tuple[np.ndarray, ...]] = []
    at = 0
    while at < len(texts):
        if len(texts[at]) > CHUNK:
            # pieces overlap so that each start is in one piece
            step = CHUNK - length + 1
            for lo in range(0, len(texts[at]) - length + 1, step):
                t, a, s, e, h, c = _chunk_anchors([texts[at][lo : lo + CHUNK]], length)
                parts.append((t + at, a + lo, s + lo, e + lo, h, c))
            at += 1
            continue
        size, to = 0, at
        while to < len(texts) and size + len(texts[to]) <= CHUNK:
            size += len(texts[to])
            to += 1
        t, *rest = _chunk_anchors(texts[at:to], length)
        parts.append((t + at, *rest))
        at = to
    return tuple(np.concatenate([p[k] for p in parts]) for k in range(6)) if parts else tuple(np.zeros(0, np.int64) for _ in range(6))


def _chunk_anchors(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    c = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    if len(c) < length:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.int64),) * 2
    up, down = _powers.of(len(c) + 1)
    sums = np.concatenate(([np.uint64(0)], np.cumsum((c.astype(np.uint64) + np.uint64(1)) * up[: len(c)], dtype=np.uint64)))
    gram = mix64((sums[GRAM:] - sums[:-GRAM]) * down[: len(c) - GRAM + 1])
    # hash above, position below: a sliding minimum also says where it is, leftmost first
    low = (gram & ~np.uint64((1 << 20) - 1)) | np.arange(len(gram), dtype=np.uint64)
    window, width = length - GRAM + 1, 1
    while 2 * width <= window:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < window:
        gap = window - width
        low = np.minimum(low[:-gap], low[gap:])
    chosen = (low & np.uint64((1 << 20) - 1)).astype(np.int64)
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(texts)), sizes)[: len(chosen)]
    valid = np.arange(len(chosen)) + length <= ends[text]
    # runs of starts with one anchor in one text
    fresh = valid & np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1]) | ~valid[:-1]))
    first = np.flatnonzero(fresh)
    last = np.flatnonzero(valid & np.concatenate((fresh[1:] | ~valid[1:], [True])))
    a, t = chosen[first], text[first]
    whole = named(gram, first, last - first + length) ^ mix64(((a - first) * 1024 + (last - first)).astype(np.uint64))
    begin = (ends - sizes)[t]
    return t, a - begin, first - begin, last - begin, gram[a].view(np.int64), whole.view(np.int64)


def named(gram: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Identifiers of the ``size`` bytes from each place: the pair of those of half the length, at the start and
    at the later offset that reaches the end, down to the identifiers of q-grams."""
    out = gram[at]
    longer = np.flatnonzero(size > GRAM)
    if len(longer):
        n = size[longer]
        half = GRAM << np.ceil(np.log2(n / GRAM)).astype(np.int64) - 1
        for h in np.unique(half):
            own = longer[half == h]
            part = np.full(len(own), h)
            out[own] = mix64(named(gram, at[own], part) * np.uint64(3) + mix64(named(gram, at[own] + size[own] - h, part) + size[own].astype(np.uint64)))
    return out


def later_here(h: np.ndarray, c: np.ndarray, lead: np.ndarray, span: np.ndarray, d: np.ndarray, t: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Which anchors repeat the context of an earlier one in the same batch: a combiner for hot passages."""
    late = np.zeros(len(c), bool)
    order = np.argsort(c, kind="stable")
    twin = np.concatenate(([False], c[order][1:] == c[order][:-1]))
    some = order[twin | np.concatenate((twin[1:], [False]))] if len(c) else order
    if len(some):
        some = some[np.lexsort((a[some], t[some], d[some], span[some], lead[some], c[some], h[some]))]
        x, y = some[1:], some[:-1]
        same = (h[x] == h[y]) & (c[x] == c[y]) & (lead[x] == lead[y]) & (span[x] == span[y])
        first = np.concatenate(([True], ~same))
        start = np.maximum.accumulate(np.where(first, np.arange(len(some)), 0))
        head = some[start]
        # a row alike in id and place (a repeated document) is not later than the first
        late[some] = ~((d[some] == d[head]) & (t[some] == t[head]) & (a[some] == a[head]))
    return late


def refine(contexts: list[bytes], left: np.ndarray, span: np.ndarray, length: int) -> np.ndarray:
    """Which owned strings occur in an earlier context: a row a context, a column for each start.

    Contexts are aligned at their anchors; ``left`` bytes stand before it.  Rows come in the order
    of "earlier".  All suffixes of all contexts start in buckets of 8 bytes.  A round sorts pairs of
    a suffix's bucket and the bucket of the suffix at the later offset, which makes buckets of twice
    the length; the last round's offset is what ``length`` leaves.  Equal strings have their anchor at
    the same place, so they meet in one bucket and one column.
    """
    k = len(contexts)
    most = int(left.max())
    grid = np.zeros((k, most + length + 8), np.uint8)
    lens = np.array([len(c) for c in contexts], np.int64)
    flat = np.frombuffer(b"".join(contexts), np.uint8)
    rows = np.repeat(np.arange(k), lens)
    grid[rows, np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens) + np.repeat(most - left, lens)] = flat

    def buckets(keys: np.ndarray) -> np.ndarray:
        return np.unique(keys, return_inverse=True)[1].reshape(keys.shape).astype(np.uint64)

    width, size = grid.shape[1] - 8, 8
    first = np.zeros((k, width), np.uint64)
    for j in range(8):
        first = first << np.uint64(8) | grid[:, j : j + width]
    bucket = buckets(first)
    while 2 * size <= length:
        bucket = buckets(bucket[:, :-size] << np.uint64(32) | bucket[:, size:])
        size *= 2
    # the strings that each context owns, in the order of "earlier"
    row = np.repeat(np.arange(k), span)
    start = np.arange(len(row)) - np.repeat(np.cumsum(span) - span, span)
    at = start + (most - left)[row]
    keys = bucket[row, at] << np.uint64(32) | bucket[row, at + length - size]
    _, earliest, where = np.unique(keys, return_index=True, return_inverse=True)
    again = earliest[where.reshape(-1)] != np.arange(len(row))
    found = np.zeros((k, int(span.max())), bool)
    found[row[again], start[again]] = True
    return found


def runs_of(found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of the runs of True in each row."""
    padded = np.pad(found, ((0, 0), (1, 1))).astype(np.int8)
    step = np.diff(padded, axis=1)
    row, first = np.nonzero(step == 1)
    _, end = np.nonzero(step == -1)
    return row, first, end - 1


def repeated_starts(docs: DataFrame, length: int) -> DataFrame:
    """(d, t, s1, s2): starts s1 to s2 of document (d, t) begin strings that also start earlier.

    ``docs`` has d (long), t (long, tells apart rows with one d) and text.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                yield batch, anchors_of([x.as_buffer().to_pybytes() if x.is_valid else b"" for x in batch.column("text")], length)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (text, _, _, _, h, _) in pieces(batches):
            once = np.unique(np.stack([text, h]), axis=1)[1]
            yield pa.RecordBatch.from_arrays([pa.array(once, pa.int64())], ["h"])

    sampled = docs.where(F.pmod(F.xxhash64("d", "t"), F.lit(SAMPLE)) == 0)
    counts = sampled.select("text").mapInArrow(grams, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    common = np.sort(np.array([r["h"] for r in counts.where(F.col("n") >= max(LEAST, sampled.count() // COMMON)).select("h").collect()], np.int64))

    def anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, (text, a, s, e, h, c) in pieces(batches):
            take = pa.array(text, pa.int64())
            d, t = batch.column("d").take(take), batch.column("t").take(take)
            late = later_here(h, c, a - s, e - s, d.to_numpy(), t.to_numpy(), a)
            hot = np.isin(h, common)
            # a common q-gram's contexts are dealt one by one; what surely repeats needs no company: any bucket will do
            bucket = np.where(hot, mix64((h ^ c).astype(np.uint64)).view(np.int64), h)
            bucket = np.where(late, mix64((d.to_numpy() * 1_000_003 + a).astype(np.uint64)).view(np.int64), bucket)
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(c, pa.int64()), d, t, pa.array(a, pa.int64()), pa.array(a - s, pa.int16()), pa.array(e - s + 1, pa.int16()), pa.array(late), pa.array(hot)], ["h", "c", "d", "t", "a", "lead", "span", "late", "hot"])

    rows = docs.select("d", "t", "text").mapInArrow(anchor, "h long, c long, d long, t long, a long, lead short, span short, late boolean, hot boolean")
    # one shuffle by q-gram bucket serves both windows: equal contexts, and how many differ
    same = Window.partitionBy("h", "late", "c", "lead", "span").orderBy("d", "t", "a")
    ranked = rows.repartition("h").withColumn("again", F.col("late") | (F.rank().over(same) > 1))
    # a bucket's different contexts; a context of rows alike in all (repeated rows) counts once
    kinds = F.sum(F.when(F.col("again"), 0).otherwise(1)).over(Window.partitionBy("h"))
    ranked = ranked.withColumn("kinds", F.when(F.col("hot"), F.lit(HOT + 1)).otherwise(kinds)).drop("hot")
    marked = settle(ranked.where("again OR kinds > 1"), "anchors")
    sure = marked.where("again").select("d", "t", (F.col("a") - F.col("lead")).alias("s1"), (F.col("a") - F.col("lead") + F.col("span") - 1).alias("s2"))
    open_rows = marked.where("NOT again AND kinds > 1")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 16):
                batch = whole.slice(at, 16)
                own, text = batch.column("own"), batch.column("text")
                counts = pa.array([len(x) for x in own], pa.int64()).to_numpy()
                of = np.repeat(np.arange(len(counts)), counts)
                flat = own.flatten()
                columns = {k: flat.field(k) for k in ("h", "kinds", "a", "lead", "span")}
                start = columns["a"].to_numpy() - columns["lead"].to_numpy()
                end = start + columns["span"].to_numpy() - 1 + length
                raw = [t.as_buffer().to_pybytes() for t in text]
                pieces_ = pa.array([raw[i][lo:hi] for i, lo, hi in zip(of.tolist(), start.tolist(), end.tolist(), strict=True)], pa.binary())
                take = pa.array(of)
                yield pa.RecordBatch.from_arrays([columns["h"], columns["kinds"], batch.column("d").take(take), batch.column("t").take(take), columns["a"], columns["lead"], columns["span"], pieces_], ["h", "kinds", "d", "t", "a", "lead", "span", "bytes"])

    by_doc = open_rows.groupBy("d", "t").agg(F.collect_list(F.struct("h", "kinds", "a", "lead", "span")).alias("own"))
    contexts = settle(_with_text(docs, by_doc).mapInArrow(cut, "h long, kinds long, d long, t long, a long, lead short, span short, bytes binary"), "contexts")

    def refined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            lead, span, a = (rows[k].to_numpy().astype(np.int64) for k in ("lead", "span", "a"))
            row, first, last = runs_of(refine(rows["bytes"].to_pylist(), lead, span, length))
            take = pa.array(row, pa.int64())
            s = (a - lead)[row]
            return pa.RecordBatch.from_arrays([rows["d"].combine_chunks().take(take), rows["t"].combine_chunks().take(take), pa.array(s + first, pa.int64()), pa.array(s + last, pa.int64())], ["d", "t", "s1", "s2"])

        held: list[pa.RecordBatch] = []
        n, last_h = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            h = batch.column("h").to_numpy()
            # cut only between buckets
            edges = np.concatenate(([0], np.flatnonzero(np.diff(h)) + 1, [len(h)]))
            lo = 0
            for edge, to in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if n + to - lo > TOGETHER and (edge > lo or (edge == 0 and last_h != h[0] and held)):
                    if edge > lo:
                        held.append(batch.slice(lo, edge - lo))
                    yield flush(held)
                    held, n, lo = [], 0, edge
            held.append(batch.slice(lo))
            n += len(h) - lo
            last_h = h[-1]
        if held:
            yield flush(held)

    few = contexts.where(F.col("kinds") <= HOT).repartition("h").sortWithinPartitions("h", "d", "t", "a")
    found = few.select("h", "d", "t", "a", "lead", "span", "bytes").mapInArrow(refined, "d long, t long, s1 long, s2 long")
    # hot buckets: every string is a key, pre-aggregated to its first start; any contexts that come together
    # first find what repeats among them, so that a common passage sends its strings once a group
    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TOGETHER):
                rows = whole.slice(at, TOGETHER)
                d, t, a = (rows.column(k).to_numpy() for k in ("d", "t", "a"))
                order = np.lexsort((a, t, d))
                d, t, a = d[order], t[order], a[order]
                lead, span = (rows.column(k).to_numpy()[order].astype(np.int64) for k in ("lead", "span"))
                raw = rows.column("bytes").take(pa.array(order)).to_pylist()
                here = refine(raw, lead, span, length)
                row, first, last = runs_of(here)
                alone, col = np.nonzero(~here & (np.arange(here.shape[1]) < span[:, None]))
                of, lo, hi = np.concatenate((row, alone)), np.concatenate((first, col)), np.concatenate((last, col))
                start = (a - lead)[of]
                strings = pa.array([None] * len(row) + [raw[r][c : c + length] for r, c in zip(alone.tolist(), col.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(d[of]), pa.array(t[of]), pa.array(start + lo), pa.array(start + hi), strings], ["d", "t", "s1", "s2", "str"])

    hot = contexts.where(F.col("kinds") > HOT).select("d", "t", "a", "lead", "span", "bytes").mapInArrow(combined, "d long, t long, s1 long, s2 long, str binary")
    hot = settle(hot, "strings")
    strings = hot.where("str IS NOT NULL")
    least = strings.groupBy("str").agg(F.min(F.struct("d", "t", "s1")).alias("first"))
    late = strings.join(least, "str").where(F.struct("d", "t", "s1") > F.col("first")).select("d", "t", "s1", "s2")
    late = late.union(hot.where("str IS NULL").select("d", "t", "s1", "s2"))
    out = settle(sure.union(found).union(late), "repeats")
    for made in (marked, contexts, hot):
        discard(made)
    return out


def _with_text(docs: DataFrame, by_doc: DataFrame) -> DataFrame:
    """``by_doc`` joined to its texts; texts that it doesn't name aren't shuffled if it names few."""
    ids = settle(by_doc, "named")
    if ids.count() <= PICKED:
        docs = docs.join(F.broadcast(ids.select("d", "t")), ["d", "t"], "left_semi")
    return docs.join(ids, ["d", "t"])


def remove_repeats(docs: DataFrame, *, length: int = 100, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = False) -> DataFrame:
    """Remove each byte that a ``length``-byte string covers which also starts earlier.

    Earlier: in a document with a smaller id, or further left in the same one; strings are judged
    on the input.  Returns a row a document: the id column, n_bytes, n_removed, n_spans (maximal
    removed runs), kept_sha256 (of the remaining bytes), spans (start and end of each run), and
    with ``with_bytes`` the remaining bytes as ``kept``.

    Null texts are empty; texts under ``length`` bytes keep all.  Null ids come before all others; ids
    are whole numbers.  Rows alike in id and text count as one document and get the same result; rows
    with one id and different texts are ordered by a hash of the text.  A very long text is anchored
    in overlapping pieces.  Empty tables give empty ones.  Other columns, whatever their names, are
    not read.
    """
    if not 64 <= length <= 512:
        raise ValueError("length must be 64 to 512")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = bounded_batches(docs).select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("d"), text.alias("text"))
    ids = rows.agg(F.count(F.lit(1)), F.countDistinct("d")).first()
    rows = rows.withColumn("t", F.lit(0).cast("long") if ids[0] == ids[1] else F.xxhash64("text"))
    distinct = rows if ids[0] == ids[1] else rows.dropDuplicates(["d", "t"])
    starts = repeated_starts(distinct, length)
    by_doc = settle(starts.groupBy("d", "t").agg(F.collect_set(F.struct("s1", "s2")).alias("own")), "repeats_by_doc")
    if by_doc.count() <= PICKED:
        named = F.broadcast(by_doc.select("d", "t"))
        joined = rows.join(named, ["d", "t"], "left_semi").join(by_doc, ["d", "t"]).select("d", "text", "own").union(rows.join(named, ["d", "t"], "left_anti").select("d", "text", F.lit(None).alias("own")))
    else:
        joined = rows.join(by_doc, ["d", "t"], "left").select("d", "text", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                rows, first, end = [], [], []
                for text, own in zip(batch.column("text"), batch.column("own"), strict=True):
                    raw = text.as_buffer().to_pybytes()
                    lo, hi = runs_covered(own.values, length) if own.is_valid else (_NONE, _NONE)
                    rest = without(raw, lo, hi)
                    rows.append((len(raw), len(raw) - len(rest), len(lo), hashlib.sha256(rest).hexdigest(), rest))
                    first.append(lo)
                    end.append(hi)
                spans = pa.StructArray.from_arrays([pa.array(np.concatenate(first)), pa.array(np.concatenate(end))], ["start", "end"])
                offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in first]))), pa.int32())
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
                columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
                kept = [pa.array([r[4] for r in rows], pa.binary())] if with_bytes else []
                yield pa.RecordBatch.from_arrays([batch.column("d"), *columns, pa.ListArray.from_arrays(offsets, spans), *kept], ["d", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", *["kept"] * with_bytes])

    schema = "d long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>" + (", kept binary" if with_bytes else "")
    done = joined.mapInArrow(run, schema)
    back = F.when(F.col("d") != -(1 << 63), F.col("d")).cast(id_type(docs, id_col))
    return done.select(back.alias(id_col), *done.columns[1:])


_NONE = np.zeros(0, np.int64)


def runs_covered(starts: pa.StructArray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the maximal runs that strings of ``length`` bytes cover, from runs (s1, s2) of their starts."""
    s1, s2 = (starts.field(k).to_numpy() for k in ("s1", "s2"))
    order = np.argsort(s1, kind="stable")
    lo, hi = s1[order], np.maximum.accumulate(s2[order] + length)
    apart = lo[1:] > hi[:-1]
    return lo[np.concatenate(([True], apart))], hi[np.concatenate((apart, [True]))]


def without(raw: bytes, lo: np.ndarray, hi: np.ndarray) -> bytes:
    """The bytes outside of the runs."""
    return b"".join(raw[a:b] for a, b in zip([0, *hi.tolist()], [*lo.tolist(), len(raw)], strict=True))

"""Token ids in a word-aligned binary form: Simple-8b with escapes and block offsets."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.llm.common import bounded_batches, id_type, sent, settle, with_offsets

#: Fixed values of the format: ids in a word and bits of each, by selector 0 to 13.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
#: Selector 14 says that its one id stands in the list of escapes, at the place that the payload names.
ESCAPE = 14
BLOCK = 4096
_COUNT = np.array([*COUNTS, 1], np.int64)


def block_ends(lengths: np.ndarray) -> np.ndarray:
    """Where blocks end when each document of these lengths is cut into blocks of BLOCK ids."""
    stops = np.cumsum(lengths)
    cuts = [np.arange(stop - n + BLOCK, stop, BLOCK) for stop, n in zip(stops[lengths > BLOCK], lengths[lengths > BLOCK], strict=True)]
    return np.unique(np.concatenate([stops[lengths > 0], *cuts]))


#: Bits of small ids, looked up.
_NARROW = np.frexp(np.arange(1 << 17, dtype=np.float64))[1].astype(np.uint8)


def widths(ids: np.ndarray) -> np.ndarray:
    """Bits that each id takes; 99 for an escape."""
    if len(ids) and int(ids.max()) < len(_NARROW):
        return _NARROW[ids]
    # both halves are small enough for a double, so the exponents are exact
    high = (ids >> np.uint64(30)).astype(np.float64)
    out = np.where(high > 0, np.frexp(high)[1] + 30, np.frexp((ids & np.uint64((1 << 30) - 1)).astype(np.float64))[1]).astype(np.uint8)
    out[ids >> np.uint64(60) != 0] = 99
    return out


def encode_blocks(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, escapes, word_ends, escape_ends) of unsigned 64-bit ids cut into blocks at ``ends``.

    A word holds a selector in its top 4 bits and then as many of the next ids as fit in one of the
    layouts, the first id lowest; the last word of a block may be partly filled.  An id of 2**60 or
    more is an escape, numbered within its block.
    """
    n = len(ids)
    width = widths(ids)
    big = width > 60
    stop = np.repeat(ends, np.diff(ends, prepend=0))
    # from each place, the first layout whose next ids in the block are all narrow enough; where a
    # layout doesn't fit, those before it (more ids, fewer bits) don't either, and where a layout takes
    # the rest of the block none is better
    most = int(width[~big].max()) if n and not big.all() else 0
    easy = next(s for s in range(14) if BITS[s] >= most)
    best = np.where(big, ESCAPE, 13)
    fits = np.flatnonzero(~big)
    for s in range(12 if big.any() else easy, -1, -1):
        if s == easy and len(fits) == n:
            best[:] = s
        else:
            fits = fits[stop[fits] - fits > COUNTS[s + 1]]
            if not len(fits):
                break
            wide = np.concatenate((np.zeros(1, np.int32), np.cumsum(width > BITS[s], dtype=np.int32)))
            fits = fits[wide[np.minimum(fits + COUNTS[s], stop[fits])] == wide[fits]]
            best[fits] = s
    reach = np.minimum(np.arange(n) + _COUNT[best], stop)
    # words are found from each to the next, in all blocks at once
    starts, here = np.zeros(n, bool), np.concatenate(([0], ends[:-1])).astype(np.int64)[: len(ends)]
    until = np.asarray(ends, np.int64)
    while len(here):
        starts[here] = True
        here = reach[here]
        more = here < until
        if not more.all():
            here, until = here[more], until[more]
    at = np.flatnonzero(starts)
    selector, last = best[at], np.append(at[1:], n)
    words = selector.astype(np.uint64) << np.uint64(60)
    for s in np.unique(selector[selector < ESCAPE]):
        rows = np.flatnonzero(selector == s)
        first, n_held, word = at[rows], last[rows] - at[rows], words[rows]
        part = np.flatnonzero(n_held < COUNTS[s])
        whole = np.flatnonzero(n_held == COUNTS[s])
        for k in range(COUNTS[s]):
            word[whole] |= ids[first[whole] + k] << np.uint64(k * BITS[s])
            some = part[n_held[part] > k]
            word[some] |= ids[first[some] + k] << np.uint64(k * BITS[s])
        words[rows] = word
    word_ends = np.searchsorted(at, ends)
    escaped = at[selector == ESCAPE]
    escape_ends = np.searchsorted(escaped, ends)
    block = np.searchsorted(ends, escaped, side="right")
    words[selector == ESCAPE] |= (np.arange(len(escaped)) - np.concatenate(([0], escape_ends))[block]).astype(np.uint64)
    return words, ids[escaped], word_ends, escape_ends


def encode_documents(ids: np.ndarray, lengths: np.ndarray) -> list[dict]:
    """Documents' ids, one after another, as rows of the file.

    Block i of a row is words[word_ends[i-1]:word_ends[i]], and its escapes likewise.
    """
    ends = block_ends(lengths)
    words, escapes, word_ends, escape_ends = encode_blocks(ids.astype(np.uint64), ends)
    out, b, w, e = [], 0, 0, 0
    for n, blocks in zip(lengths.tolist(), (-(-lengths // BLOCK)).tolist(), strict=True):
        we, ee = word_ends[b : b + blocks], escape_ends[b : b + blocks]
        w1, e1 = (int(we[-1]), int(ee[-1])) if blocks else (w, e)
        out.append({"n_ids": n, "words": words[w:w1].astype("<u8").tobytes(), "word_ends": (we - w).tolist(), "escapes": escapes[e:e1].astype("<u8").tobytes(), "escape_ends": (ee - e).tolist()})
        b, w, e = b + blocks, w1, e1
    return out


def decode_documents(rows: list[tuple[int, bytes, list[int], bytes, list[int]]]) -> tuple[np.ndarray, np.ndarray]:
    """(ids one after another, lengths) of rows of the file: n_ids, words, word_ends, escapes, escape_ends.

    All words of all rows are decoded layout by layout; what partly filled words hold beyond their
    block is cut off.
    """
    lengths = np.array([r[0] for r in rows], np.int64)
    words = np.frombuffer(b"".join([r[1] for r in rows]), "<u8")
    escapes = np.frombuffer(b"".join([r[3] for r in rows]), "<u8")
    # blocks of all rows: how many words, escapes and ids each has
    n_words = np.concatenate([np.diff(r[2], prepend=0) for r in rows] or [np.zeros(0, np.int64)]).astype(np.int64)
    n_escapes = np.concatenate([np.diff(r[4], prepend=0) for r in rows] or [np.zeros(0, np.int64)]).astype(np.int64)
    blocks = -(-lengths // BLOCK)
    n_ids = np.full(int(blocks.sum()), BLOCK, np.int64)
    full = lengths > 0
    n_ids[np.cumsum(blocks)[full] - 1] = (lengths - (blocks - 1) * BLOCK)[full]
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = _COUNT[selector]
    start = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    payload = words & np.uint64((1 << 60) - 1)
    for s in np.unique(selector):
        at = np.flatnonzero(selector == s)
        if s == ESCAPE:
            base = np.repeat(np.cumsum(n_escapes) - n_escapes, n_words)[at]
            out[start[at]] = escapes[payload[at].astype(np.int64) + base]
            continue
        own, low = payload[at], np.uint64((1 << BITS[s]) - 1)
        for k in range(COUNTS[s]):
            out[start[at] + k] = (own >> np.uint64(k * BITS[s])) & low
    held = np.add.reduceat(counts, np.cumsum(n_words) - n_words) if len(n_words) else n_words
    spare = held - n_ids
    ends = np.cumsum(held)
    keep = np.ones(len(out), bool)
    for e, k in zip(ends[spare > 0].tolist(), spare[spare > 0].tolist(), strict=True):
        keep[e - k : e] = False
    return out[keep], lengths


class WordCache:
    """Ids of whole texts from the ids of their pieces, each distinct piece encoded once.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its
    blank-separated strings.  A text of ASCII and Latin letters, where lower case is plain, is
    split further, as the tokenizer itself splits: letters, single digits, other signs.  Strings
    that may hold a special token are left whole, in their own case, to the tokenizer.
    """

    BLANKS = re.compile(r"[^ \t\n\r]+")
    PLAIN = re.compile(r"[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")
    LETTERS = re.compile(r"[a-zß-öø-ÿ]+")
    PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\s0-9a-zß-öø-ÿ]+")
    MOST = 1_200_000
    TOGETHER = 4000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True

    def _whole(self, strings: list[str]) -> None:
        """Encode strings one by one."""
        for w, e in zip(strings, self.tokenizer.encode_batch_fast(strings, add_special_tokens=False), strict=True):
            self.known[w] = array("I", e.ids).tobytes()

    def _pieces(self, pieces: list[str]) -> None:
        """Encode pieces, many in one text: each ends with its first token that can end a word."""
        for i in range(0, len(pieces), self.TOGETHER):
            part = pieces[i : i + self.TOGETHER]
            # the fast form leaves out offsets
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            stops = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(stops) != len(part):
                self._whole(part)
                continue
            raw = ids.tobytes()
            self.known.update(zip(part, [raw[4 * lo : 4 * hi] for lo, hi in zip([0, *stops[:-1]], stops, strict=True)], strict=True))

    def learn(self, strings: list[str]) -> None:
        """Add blank-separated strings: plain ones by the pieces of their lower case, others whole."""
        known, joined, odd, new, letters = self.known, [], [], set(), self.LETTERS.fullmatch
        for w in strings:
            if letters(w):
                new.add(w)
                continue
            if "<|" in w or not self.PLAIN.fullmatch(w):
                odd.append(w)
                continue
            # strings of a text that isn't all plain come as they are written
            own = self.PIECE.findall(w.lower())
            new.update(own)
            if own != [w]:
                joined.append((w, own))
        self._whole(odd)
        self._pieces(list(new.difference(known)))
        for w, own in joined:
            known[w] = b"".join([known[p] for p in own])

    def encode(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, how many each text has), with ``end_id`` after each text."""
        # special tokens are case-sensitive, so a text that may hold one is lowered after the split, string by string
        split = [t.lower().split() if "<|" not in t and self.PLAIN.fullmatch(t) else self.BLANKS.findall(t) for t in texts]
        if len(self.known) > self.MOST:
            self.known.clear()
        self.learn(list(set().union(*split).difference(self.known)))
        end, get = array("I", [end_id]).tobytes(), self.known.__getitem__
        joined = [b"".join(map(get, own)) + end for own in split]
        return np.frombuffer(b"".join(joined), np.uint32), np.array([len(x) // 4 for x in joined], np.int64)


#: A worker's caches live as long as it does, over many tasks.
_caches: dict[str, WordCache] = {}


def cache_of(path: str) -> WordCache:
    if path not in _caches:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for every core
        _caches[path] = WordCache(path)
    return _caches[path]


#: Rows of a range whose running sum one task takes, and documents that one file holds, about.
RANGE_ROWS, FILE_ROWS = 50_000, 20_000
FILE_COLUMNS = "n_ids long, words binary, word_ends array<long>, escapes binary, escape_ends array<long>"


def write_tokens(docs: DataFrame, path: str, *, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text and write the ids, in ascending order of the id column, under ``path``.

    The files are Parquet containers, committed by Spark's writer, with a row a document: the id,
    n_ids, words (little-endian Simple-8b words), escapes (little-endian), and for each block of
    4,096 ids where its words and escapes end.  Each document's ids end with ``end_id``.  Null texts
    are empty.  Null ids come first; rows with equal ids stand side by side, by a hash of the text.
    Files follow one another in ascending order.  A text of any length is one row.  An empty table
    gives files without rows.  Columns of other names, however called, are not read.
    """
    kind = id_type(docs, id_col).simpleString()
    rows = bounded_batches(docs).select(F.col(id_col).alias("tk_id"), F.col(text_col).alias("t"))
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // FILE_ROWS))
    # ranges may cut between rows with one id, so a repeated or null id spans several
    order = [F.col("tk_id").asc_nulls_first(), "tk_tie", "tk_row"]
    ordered = rows.withColumns({"tk_tie": F.xxhash64("t"), "tk_row": F.monotonically_increasing_id()}).repartitionByRange(n, *order).sortWithinPartitions(*order).select("tk_id", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = cache_of(tokenizer_path)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                coded = encode_documents(*cache.encode([t or "" for t in batch.column("t").to_pylist()], end_id))
                columns = {k: [c[k] for c in coded] for k in ("n_ids", "words", "word_ends", "escapes", "escape_ends")}
                kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("tk_id"), *[pa.array(v, k) for v, k in zip(columns.values(), kinds, strict=True)]], ["tk_id", *columns])

    ordered.mapInArrow(run, f"tk_id {kind}, {FILE_COLUMNS}").write.parquet(path)


def _file_rows(batch: pa.RecordBatch) -> list[tuple]:
    return list(zip(*[batch.column(c).to_pylist() for c in batch.schema.names[1:]], strict=True))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files as (id, ids array<long>), decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lengths = decode_documents(_file_rows(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), pa.array(ids.astype(np.int64)))], ["tk_id", "ids"])

    files = spark.read.parquet(path)
    return files.mapInArrow(run, f"tk_id {files.schema['tk_id'].dataType.simpleString()}, ids array<long>")


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """One row a document, from the files alone: tk_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it (by id, then length and checksum).  The
    running sum is taken in ranges of ids, so no task sees all documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                ids, lengths = decode_documents(_file_rows(batch))
                raw, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(lengths) * 4
                crc = [zlib.crc32(raw[lo:hi]) for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], ["tk_id", "n_tokens", "ids_crc32"])

    files = bounded_batches(spark.read.parquet(path))
    # the narrow result is kept, so that the files are decoded once
    found = settle(files.mapInArrow(run, f"tk_id {files.schema['tk_id'].dataType.simpleString()}, n_tokens long, ids_crc32 long"), "token_index")
    return running_start(found, "tk_id", "n_tokens", ["n_tokens", "ids_crc32"])


def running_start(df: DataFrame, id_col: str, size_col: str, ties: list[str]) -> DataFrame:
    """``df`` with ``start``: the sum of ``size_col`` over all rows before, in ascending order of the id.

    ``df`` holds few bytes a row.  Its rows are sorted by ranges of id, ties and place, so rows with
    one id may span ranges; sums are taken in each range and over the ranges.
    """
    parts = max(1, -(-df.count() // RANGE_ROWS))
    order = [F.col(id_col).asc_nulls_first(), *ties, "rs_row"]
    ranged = df.withColumn("rs_row", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    kept = settle(ranged.withColumn("rs_range", F.spark_partition_id()).withColumn("rs_at", F.monotonically_increasing_id()).drop("rs_row"), "ranged")
    before = with_offsets(kept, "rs_range", {"rs_before": F.col(size_col)})
    own = Window.partitionBy("rs_range").orderBy("rs_at").rowsBetween(Window.unboundedPreceding, -1)
    summed = kept.withColumn("start", F.coalesce(F.sum(size_col).over(own), F.lit(0)))
    return summed.join(sent(before, parts), "rs_range").withColumn("start", F.col("start") + F.col("rs_before")).drop("rs_range", "rs_at", "rs_before")

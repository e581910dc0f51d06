"""Document fingerprints that can be subtracted: invertible Bloom lookup sketches of paragraph digests.

Everything here is built-in functions on columns; no Python runs on the executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.llm.common import id_type, power_of_two, range_number

#: A digest is 64 bits: 38 of the paragraph's hash above 26 that check them.
CHECK = 26
#: A digest falls in one cell of each of 3 rows of 8 in its block; a block is 24 cells.
ROWS, WIDE = 3, 8
CELLS = ROWS * WIDE
#: Paragraphs that a block of a fingerprint is meant for.
LOAD = 8
#: Lines longer than this count by their sentences: all do, so that a text and its edited form are cut alike.
LONG_LINE = 0
#: Texts under these lengths count by sentences of the whole text (none: all lines are cut), and by words too.
SHORT, TINY = 0, 450
#: Where a sentence ends; the CJK signs need no blank.
ENDS = r"(?<=[.!?])\s+|(?<=[。！？])"
#: A sentence goes on in chunks of CHUNK code points or more.  A chunk ends by what stands before its end, at
#: the first place that content marks, else at the first between words or ideographs, else at 512: so chunks
#: agree as far as texts agree, and soon again after a change.
CHUNK = 250
_MARK = r"(?<=[aeio1357]\s|[\u4e00-\u57ff\u306e\u306f\u3092])"
_PLACE = r"(?<=[^\p{L}\p{M}\p{N}]|[\p{IsHan}\p{IsHiragana}\p{IsKatakana}])"
CHUNKS = rf"(?s).{{{CHUNK},{CHUNK + 50}}}?{_MARK}|.{{{CHUNK},511}}?{_PLACE}|.{{1,512}}"
#: Words of short texts are cut in the same way, as some scripts have no blanks.
PIECE = 8
PIECES = rf"(?s).{{{PIECE},511}}?{_PLACE}|.{{1,512}}"
#: Ranges of ids that rows are put in order by, at most: their cuts are part of the plan.
MOST_RANGES = 1 << 15
ROUNDS = 8
#: Share of cells that hold something beyond which peeling is not tried.
MOST_FULL = 0.93
#: A block that can't be peeled is cut into so many.
FINER = 16


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _check(v: Column) -> Column:
    return F.xxhash64(v).bitwiseAND(F.lit((1 << CHECK) - 1))


def digests(text: Column) -> Column:
    """Distinct digests of a text's paragraphs: the sentences of its lines, long ones in chunks; short texts by word too.

    Sentences and chunks are cut by what stands before the cut, never by the length of the text or the line.
    """

    def pieces(units: Column, most: int, pattern: str) -> Column:
        # the patterns leave units up to this length whole
        return F.flatten(F.transform(units, lambda x: F.when(F.char_length(x) <= most, F.array(x)).otherwise(F.regexp_extract_all(x, F.lit(pattern), F.lit(0)))))

    sentences = F.flatten(F.transform(F.split(text, "\n"), lambda x: F.split(x, ENDS)))
    parts = pieces(sentences, CHUNK, CHUNKS)
    parts = F.when(F.char_length(text) < TINY, F.concat(parts, pieces(F.split(text, r"\s+"), PIECE, PIECES))).otherwise(parts)

    hashes = F.transform(F.filter(parts, lambda x: F.char_length(x) > 0), lambda x: F.shiftrightunsigned(F.xxhash64(x), CHECK))
    return F.array_distinct(F.transform(hashes, lambda v: F.shiftleft(v, CHECK).bitwiseOR(_check(v))))


def blocks_for(units: Column) -> Column:
    """Blocks of the fingerprint of so many paragraphs: the power of two that gives each LOAD or fewer."""
    return F.call_function("shiftleft", F.lit(1), F.ceil(F.log2(F.greatest(F.size(units) / LOAD, F.lit(1.0)))).cast("int"))


def _block(u: Column) -> Column:
    return F.shiftrightunsigned(u, CHECK + 3 * ROWS)


def _bits(row: int, place: int = WIDE - 1) -> Column:
    """A place in a row of cells where digests hold it; without a place all bits that do."""
    return F.lit(place << (CHECK + 3 * row)).cast("long")


def _held(u: Column, cell: Column) -> Column:
    """Whether the digest falls in this cell of its block."""
    mask = F.array(*[_bits(c // WIDE) for c in range(CELLS)])
    own = F.array(*[_bits(c // WIDE, c % WIDE) for c in range(CELLS)])
    return u.bitwiseAND(F.get(mask, cell)) == F.get(own, cell)


def _cells(own: Column) -> Column:
    """The cells of one block: row by row, each the XOR of the digests that fall in it."""
    none = F.lit(0).cast("long")

    def row(r: int) -> Column:
        places = F.array(*[_bits(r, w) for w in range(WIDE)])
        return F.transform(places, lambda w: F.aggregate(own, none, lambda acc, u: F.when(u.bitwiseAND(_bits(r)) == w, acc.bitwiseXOR(u)).otherwise(acc)))

    return F.when(F.size(own) == 0, F.array(*[none] * CELLS)).otherwise(F.concat(*[row(r) for r in range(ROWS)]))


def _root(n: Column) -> Column:
    """The power of two at or under the root of a power of two."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.floor(F.log2(n.cast("double")) / 2).cast("int"))


def sketch(units: Column, blocks: Column) -> Column:
    """Cells of all blocks: each the XOR of its digests.

    Subtracting is XOR too, so a cell needs no count: a digest says by its check bits that it is
    alone.  Digests are dealt to blocks in two steps, so a long text costs n * sqrt(n).
    """

    def of(n: Column, outer: Column) -> Column:
        # numbers that the lambdas over digests use are bound once, not computed for each digest
        def part(g: Column, low: Column, all_: Column) -> Column:
            mine = F.filter(units, lambda u: _block(u).bitwiseAND(low) == g)
            return _let(mine, lambda own: F.transform(F.sequence(g, all_, low + 1), lambda b: _cells(F.filter(own, lambda u: _block(u).bitwiseAND(all_) == b))))

        nested = _let(outer - 1, lambda low: _let(n - 1, lambda all_: F.transform(F.sequence(F.lit(0).cast("long"), low), lambda g: part(g, low, all_))))
        place = F.sequence(F.lit(0).cast("long"), n - 1)
        return _let(nested, lambda t: F.flatten(F.transform(place, lambda b: F.get(F.get(t, F.pmod(b, outer).cast("int")), (b / outer).cast("int")))))

    return _let(blocks.cast("long"), lambda n: F.when(n == 1, _cells(units)).otherwise(_let(_root(n), lambda outer: of(n, outer))))


def _sketched(units: str) -> Column:
    return sketch(F.col(units), blocks_for(F.col(units)))


def fold(cells: Column, blocks: Column) -> Column:
    """The sketch of the same digests in fewer blocks: cells of blocks that fall together, XORed."""

    def parts(width: Column) -> Column:
        step = F.sequence(F.lit(0), F.size(cells) - 1, width)
        return _let(step, lambda at: F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.aggregate(at, F.lit(0).cast("long"), lambda acc, k: acc.bitwiseXOR(F.get(cells, i + k)))))

    return _let(blocks * CELLS, lambda width: F.when(F.size(cells) == width, cells).otherwise(parts(width)))


def peel(difference: Column, *, one: bool = False) -> Column:
    """How many digests a difference of sketches holds, or null if some can't be recovered; ``one`` says that it is one block.

    In each round the cells with one digest give it up, and it leaves its other cells.
    """

    def alone(x: Column, c: Column) -> Column:
        return (x != 0) & (_check(F.shiftrightunsigned(x, CHECK)) == x.bitwiseAND(F.lit((1 << CHECK) - 1))) & _held(x, c)

    def step(acc: Column, _: Column) -> Column:
        def next_(p: Column) -> Column:
            left = F.zip_with(acc["cells"], _cells(p), lambda x, y: x.bitwiseXOR(y))
            return F.struct(left.alias("cells"), (acc["n"] + F.size(p)).alias("n"), F.lit(False).alias("over"))

        over = F.struct(acc["cells"].alias("cells"), acc["n"].alias("n"), F.lit(True).alias("over"))
        pure = F.filter(acc["cells"], alone)
        return F.when(acc["over"], acc).otherwise(_let(pure, lambda p: F.when(F.size(p) == 0, over).otherwise(_let(F.array_distinct(p), next_))))

    def block(cells: Column) -> Column:
        start = F.struct(cells.alias("cells"), F.lit(0).alias("n"), F.lit(False).alias("over"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda acc: F.when(F.exists(acc["cells"], lambda x: x != 0), F.lit(None).cast("int")).otherwise(acc["n"]))

    def whole(cells: Column) -> Column:
        return F.when(F.exists(cells, lambda x: x != 0), block(cells)).otherwise(F.lit(0))

    if one:
        return whole(difference)
    starts = F.sequence(F.lit(1), F.size(difference), F.lit(CELLS))
    peeled = F.aggregate(starts, F.lit(0), lambda acc, at: F.when(acc.isNull(), acc).otherwise(acc + _let(F.slice(difference, at, CELLS), whole)))
    # with nearly all cells full there are more digests than any peeling recovers
    full = F.size(F.filter(difference, lambda x: x != 0)) > F.size(difference) * MOST_FULL
    return F.when(full, F.lit(None).cast("int")).otherwise(peeled)


def apart(units: Column) -> Column:
    """How many digests of two lists, one behind the other, are in one of them alone.

    XOR is its own inverse: the sketch of both lists is the one minus the other.  It has blocks for
    all digests, and each is made, peeled and forgotten by itself.  A block that can't be peeled is made
    again as FINER smaller ones, and only if digests of such a one stay entangled (two differing ones
    that share all three cells) are its digests counted.
    """
    none = F.lit(0)

    def total(places: Column, body: Callable[[Column], Column]) -> Column:
        return F.aggregate(places, none, lambda acc, x: acc + body(x))

    def peeled(own: Column) -> Column:
        return _let(_cells(own), lambda cells: peel(cells, one=True))

    def counted(own: Column) -> Column:
        # what both lists hold is in ``own`` twice
        return F.size(F.array_distinct(own)) * 2 - F.size(own)

    def finer(own: Column, b: Column, n: Column) -> Column:
        return _let(n * FINER - 1, lambda all_: total(F.sequence(b, all_, n), lambda c: _let(F.filter(own, lambda u: _block(u).bitwiseAND(all_) == c), lambda few: F.when(F.size(few) == 0, none).otherwise(F.coalesce(peeled(few), counted(few))))))

    def of(n: Column, outer: Column) -> Column:
        # digests are dealt to blocks in two steps, as in ``sketch``
        def block(mine: Column, b: Column, all_: Column) -> Column:
            return _let(F.filter(mine, lambda u: _block(u).bitwiseAND(all_) == b), lambda own: F.when(F.size(own) == 0, none).otherwise(F.coalesce(peeled(own), finer(own, b, n))))

        def part(g: Column, low: Column, all_: Column) -> Column:
            return _let(F.filter(units, lambda u: _block(u).bitwiseAND(low) == g), lambda mine: total(F.sequence(g, all_, low + 1), lambda b: block(mine, b, all_)))

        return _let(outer - 1, lambda low: _let(n - 1, lambda all_: total(F.sequence(F.lit(0).cast("long"), low), lambda g: part(g, low, all_))))

    return _let(blocks_for(units).cast("long"), lambda n: _let(_root(n), lambda outer: of(n, outer)))


def likeness(a: Column, b: Column, units_a: Column, units_b: Column) -> Column:
    """Jaccard likeness of two texts from their sketches: shared paragraphs of all, 0 to 1.

    The larger sketch is folded to the size of the smaller and they are subtracted.  If the
    difference can't be peeled, it is made again from the digests of both, see ``apart``.
    """

    def minus(x: Column, y: Column) -> Column:
        return F.zip_with(x, y, lambda p, q: p.bitwiseXOR(q))

    small = (F.least(F.size(a), F.size(b)) / CELLS).cast("int")
    subtracted = _let(small, lambda n: peel_of(minus(fold(a, n), fold(b, n))))
    both = F.size(units_a) + F.size(units_b)
    return _let(F.coalesce(subtracted, _let(F.concat(units_a, units_b), apart)), lambda d: F.when(both == 0, 1.0).otherwise(F.greatest(both - d, F.lit(0)) / (both + d)))


def peel_of(difference: Column) -> Column:
    return _let(difference, lambda x: peel(x))


def printed(cells: Column, units: Column) -> Column:
    """The fingerprint as text: paragraphs, then the cells, in hex."""
    return F.concat(F.lower(F.hex(F.size(units).cast("long"))), F.lit(":"), F.lower(F.array_join(F.transform(cells, lambda x: F.lpad(F.hex(x), 16, "0")), "")))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column, n_units and fingerprint of every text; equal texts have equal fingerprints.

    Null and empty texts have the fingerprint of no paragraphs.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), digests(text).alias("units"))
    return rows.select(id_col, F.size("units").cast("long").alias("n_units"), printed(_sketched("units"), F.col("units")).alias("fingerprint"))


def with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", each: int = 1500) -> DataFrame:
    """(id, text, units, cells, next_text, next_units, next_cells): each document with the next in descending order of ids.

    After the last comes the first; ties of ids go by a hash of the text; null ids come last.  Ids
    are cut into ranges of about ``each`` rows and put in order range by range, in one shuffle; a
    range's last row finds its successor in a copy of the next range's first row.  Beyond
    ``each`` * MOST_RANGES rows ranges grow; a task sorts its range outside of memory.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("o"), text.alias("text"))
    parts = power_of_two(docs.count(), each, MOST_RANGES)
    cuts = sorted(set(rows.agg(F.percentile_approx("o", [i / parts for i in range(1, parts)], 10 * MOST_RANGES)).first()[0] or [])) if parts > 1 else []
    tie = F.xxhash64("text")
    rows = rows.withColumn("range", range_number(F.col("o"), cuts))
    # at most MOST_RANGES first rows, one a range
    firsts = rows.groupBy("range").agg(F.max(F.struct(F.col("o"), tie.alias("h"))).alias("first")).collect()
    firsts = sorted(((r["range"], r["first"]["o"], r["first"]["h"]) for r in firsts), reverse=True)
    ghosts = [(firsts[i][0], o, h) for i, (_, o, h) in enumerate(firsts[1:] + firsts[:1])]
    named = spark.createDataFrame(ghosts, "to_range int, go long, gh long")
    copies = rows.join(F.broadcast(named), (F.col("o") == F.col("go")) & (tie == F.col("gh"))).dropDuplicates(["to_range"])
    both = rows.select("id", "o", "text", "range", F.lit(False).alias("ghost")).union(copies.select("id", "o", "text", F.col("to_range").alias("range"), F.lit(True).alias("ghost")))
    dealt = both.repartition("range").withColumn("units", digests(F.col("text"))).withColumn("cells", _sketched("units")).withColumn("h", tie)
    order = Window.partitionBy("range").orderBy("ghost", F.desc("o"), F.desc("h"))
    own = ("text", "units", "cells")
    placed = dealt.withColumns({f"next_{name}": F.lead(name).over(order) for name in own})
    return placed.where("NOT ghost").select("id", *own, *[f"next_{name}" for name in own])


def edited_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how like they are.

    The edited text has its last floor(n/3) code points replaced by the first as many (or all) of
    the next document's, in descending order of ids.  Returns the id column, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Null texts are empty; two texts without paragraphs are alike (1.0).  A single row is its own
    successor.  Rows with one id follow one another by a hash of the text, rows alike in both in any
    order.  Null ids come last; ids are whole numbers.  A very long text has a longer fingerprint and
    costs n * sqrt(n) for n paragraphs.  An empty table gives an empty one.  Other columns, whatever
    their names, are not read.
    """
    rows = with_next(docs, id_col=id_col, text_col=text_col)
    n, third = F.char_length("text"), (F.char_length("text") / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third)))
    rows = rows.select("id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "units", "cells", digests(F.col("edited")).alias("edited_units"), "next_units", "next_cells")
    rows = rows.withColumn("edited_cells", _sketched("edited_units"))
    return rows.select(
        F.col("id").cast(id_type(docs, id_col)).alias(id_col),
        "n_chars",
        "edited_sha256",
        printed(F.col("cells"), F.col("units")).alias("fingerprint"),
        printed(F.col("edited_cells"), F.col("edited_units")).alias("edited_fingerprint"),
        likeness(F.col("cells"), F.col("edited_cells"), F.col("units"), F.col("edited_units")).alias("near_edited"),
        likeness(F.col("cells"), F.col("next_cells"), F.col("units"), F.col("next_units")).alias("near_next"),
    )

"""Shards of even size that keep linked documents together: balanced label propagation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.llm.common import discard, power_of_two, sent, settle, with_offsets

#: Shortest line, in code points, that links the documents holding it.
LINK_LINE = 24
#: Members of a link that meet in one task; those of a larger one are dealt to several.
SALTED = 2_000
#: Rounds of moves at most, and the least relative gain in kept links for another.
ROUNDS, GAIN = 8, 0.005
#: Sub-buckets that a group of equal texts, or of linked ones, may be dealt to.
SPREAD = 1 << 14


def text_links(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(node, link, n) for texts and lines of LINK_LINE code points and more that n > 1 documents hold.

    Distinct pairs.  A node is the hash of an id.
    """
    lines = F.filter(F.split(F.col(text_col), "\n"), lambda x: F.char_length(x) >= LINK_LINE)
    keys = F.array_distinct(F.concat(F.array(F.xxhash64(F.lit("text"), F.col(text_col))), F.transform(lines, lambda x: F.xxhash64(x))))
    pairs = docs.where(F.col(text_col).isNotNull()).select(F.xxhash64(id_col).alias("node"), F.explode(keys).alias("link"))
    pairs = settle(pairs, "links")
    # settled, so that a popular link's pairs can be split when they are joined
    shared = settle(pairs.groupBy("link").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "link_sizes")
    kept = settle(pairs.join(shared, "link"), "shared_links")
    discard(pairs)
    discard(shared)
    return kept


def rarest_links(links: DataFrame) -> DataFrame:
    """(node, cluster): the link of a node that the fewest documents hold, which near copies agree on."""
    return links.groupBy("node").agg(F.min(F.struct("n", "link")).alias("m")).select("node", F.col("m.link").alias("cluster"))


def propagate_labels(nodes: DataFrame, links: DataFrame, *, shards: int, rounds: int = ROUNDS, gain: float = GAIN, slack: float = 0.02) -> DataFrame:
    """Move nodes towards the shards of their neighbours, under quotas that keep shard sizes even.

    ``nodes`` has node, size, shard; ``links`` has (node, link, n).  In a round, each link sums its
    members' bytes by shard, each node adds up its links' shares (its own left out) and asks for the
    shard with the most, if that beats its own.  A link's shares add up to one however many hold it,
    so a popular line says little.  Every other node, by a coin of the round, may move, or two
    neighbours would only change places.  Between two shards as many bytes may move one way as the
    other, plus what the giver has over and the taker under an even share; of the askers, a hash
    picks that share, so no task ranks them all.

    Rounds end when the shares that nodes have in their own shards grow by less than ``gain``, or after
    ``rounds``.  Sums of links are pre-aggregated, and members of a large link meet its sums by salts.
    """
    salts = F.greatest(F.ceil(F.col("n") / SALTED), F.lit(1)).cast("int")
    best = -1.0
    for k in range(rounds):
        held = links.join(nodes, "node").withColumn("salt", F.pmod(F.xxhash64("node", F.lit("salt")), salts).cast("int"))
        per_link = held.groupBy("link").agg(F.max("n").alias("n"), F.sum("size").alias("total"), *[F.sum(F.when(F.col("shard") == s, F.col("size")).otherwise(0)).alias(f"s{s}") for s in range(shards)])
        per_link = per_link.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("n")
        seen = held.join(per_link, ["link", "salt"])

        def others(s: int) -> Column:
            own = F.when(F.col("shard") == s, F.col("size")).otherwise(0)
            return F.sum((F.col(f"s{s}") - own) / F.greatest(F.col("total") - F.col("size"), F.lit(1)))

        votes = seen.groupBy("node", "size", "shard").agg(*[others(s).alias(f"v{s}") for s in range(shards)])
        ballot = F.array(*[F.col(f"v{s}") for s in range(shards)])
        top = F.array_max(ballot)
        asks = votes.select("node", "size", "shard", (F.array_position(ballot, top) - 1).cast("int").alias("want"), top.alias("top"), F.element_at(ballot, F.col("shard") + 1).alias("here"))
        asks = settle(asks, f"asks{k}")
        kept = asks.agg(F.sum("here")).first()[0] or 0.0
        if kept <= best * (1 + gain):
            discard(asks)
            break
        best = kept
        asking = asks.where((F.col("want") != F.col("shard")) & (F.col("top") > F.col("here")) & (F.pmod(F.xxhash64("node", F.lit(k), F.lit("coin")), F.lit(2)) == 0))
        # three tables of at most shards x shards rows
        load = nodes.groupBy("shard").agg(F.sum("size").alias("load"))
        flow = asking.groupBy("shard", "want").agg(F.sum("size").alias("out"))
        back = flow.select(F.col("want").alias("shard"), F.col("shard").alias("want"), F.col("out").alias("back"))
        even = nodes.agg((F.sum("size") / shards).alias("even"))
        quota = (
            flow.join(back, ["shard", "want"], "left")
            .join(load, "shard")
            .join(load.select(F.col("shard").alias("want"), F.col("load").alias("want_load")), "want", "left")
            .crossJoin(F.broadcast(even))
            .select("shard", "want", (F.least(F.col("out"), F.coalesce("back", F.lit(0))) + F.greatest(F.least(F.col("load") - F.col("even"), F.col("even") * (1 + slack) - F.coalesce("want_load", F.lit(0))), F.lit(0)) / (shards - 1 or 1)).alias("quota"), "out")
            .select("shard", "want", (F.col("quota") / F.col("out")).alias("share"))
        )
        lot = F.pmod(F.xxhash64("node", F.lit(k)), F.lit(1 << 30)) / float(1 << 30)
        moves = asking.join(F.broadcast(quota), ["shard", "want"]).where(lot < F.col("share")).select("node", F.col("want").alias("to"))
        nodes = settle(nodes.join(moves, "node", "left").select("node", "size", F.coalesce("to", "shard").alias("shard")), f"labels{k}")
        discard(asks)
    return nodes


def assign_shards(docs: DataFrame, *, shards: int = 16, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal documents to ``shards`` shards by the law ``bytes``: shard sizes differ by about one document.

    Returns the id column, size (UTF-8 bytes of the text, null as none, plus 1), text_crc32, law,
    shard (int), slot (gapless from 0 in each shard), grown_shard (null: only the law ``key`` has
    one).  Only built-in functions are used; texts are read where they lie and never shuffled.

    Labels come from ``propagate_labels`` over shared texts and lines.  A document starts in the shard
    that its rarest link hashes to, without a link where its text does.  Then rows are put in an
    order that is cut into ``shards`` runs of equal bytes.  A label's linked documents stand in the
    middle of its stretch, side by side by rarest link; the others stand around them, small ones
    outside, so that cuts fall between small documents without links where they can.  The smaller half
    of the documents without links is left out of these runs and fills each of them up to an even
    share, so sizes differ by a small document.  Documents of more than a quarter of an even share, of
    which there are few, are dealt first, each to the emptiest shard.  A group that is larger than a
    shard spans several, and is dealt to sub-buckets for the order's running sums.

    Repeated ids share a label; each row still has its own slot.  Null ids and texts are values; a
    very long text is one row, and where it is more than an even share, the others share the rest.  An
    empty table gives an empty one.
    Other columns, whatever their names, are not read.
    """
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("sh_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.lit("text"), text).alias("grp"),
        F.xxhash64(id_col).alias("node"),
    )
    rows = settle(rows, "shard_rows")
    facts = rows.agg(F.count(F.lit(1)), F.sum("size")).first()
    n, total = int(facts[0]), int(facts[1] or 1)
    links = text_links(docs, id_col=id_col, text_col=text_col)
    start = rows.groupBy("node").agg(F.sum("size").alias("size"), F.min("grp").alias("grp")).join(rarest_links(links), "node", "left")
    start = settle(start.select("node", "size", "cluster", F.pmod(F.coalesce("cluster", "grp"), F.lit(shards)).cast("int").alias("shard")), "labels")
    labels = propagate_labels(start.drop("cluster"), links, shards=shards, rounds=rounds).select("node", "shard")

    # kinds by size on either side, and the linked ones between them; fillers come after all labels
    kinds, fine = 51, max(8, power_of_two(n // shards, 32_000, 512))
    unit = max(2, total // (shards * fine * 8))
    small = start.where("cluster IS NULL").agg(F.percentile_approx("size", 0.5)).first()[0] or 0
    given, loads = _dealt_first(rows, shards, total)
    level = _level(loads, total)
    rows = rows.join(start.select("node", "cluster"), "node").join(labels, "node").join(F.broadcast(given), ["node", "grp", "size"], "left")
    part = F.when(F.col("given").isNotNull(), 2).when(F.col("cluster").isNull() & (F.col("size") <= small), 1).otherwise(0)
    rows = rows.withColumns({"near": F.coalesce("cluster", "grp"), "part": part})
    # sizes add up to the whole, so at most shards x fine x 8 groups can be this large
    hot = rows.groupBy("near").agg(F.sum("size").alias("g")).where(F.col("g") >= unit).select("near", F.least(F.ceil(F.col("g") / unit), F.lit(SPREAD)).cast("int").alias("deals"))
    placed = rows.join(sent(hot, shards * fine * 8), "near", "left")
    kind = F.least(F.floor(F.log2(F.col("size").cast("double"))), F.lit(kinds // 2 - 1)).cast("int")
    kind = F.when(F.col("cluster").isNotNull(), kinds // 2).when(F.pmod("grp", F.lit(2)) == 0, kind).otherwise(kinds - 1 - kind)
    inner = kind * fine + F.pmod(F.xxhash64("near", F.lit("fine")), F.lit(fine)).cast("int")
    deal = F.coalesce(F.pmod(F.xxhash64("node", F.lit("hot")), F.col("deals")).cast("int"), F.lit(0))
    # fillers of all labels share the stretch after the last one, as finely cut as all labels together
    filler = F.pmod(F.xxhash64("node", F.lit("filler")), F.lit(shards * kinds * fine)) + shards * kinds * fine
    at = F.when(F.col("part") == 2, F.col("given") + 2 * shards * kinds * fine).when(F.col("part") == 1, filler).otherwise(F.col("shard") * kinds * fine + inner)
    placed = placed.select("sh_id", "size", "text_crc32", "near", "grp", "node", "part", "given", (at.cast("long") * SPREAD + deal).alias("bucket"))
    before = with_offsets(placed, "bucket", {"bytes_before": F.col("size"), "rows_before": F.lit(1)}, span=64 * SPREAD)
    order = Window.partitionBy("bucket").orderBy("near", "grp", "node", F.col("sh_id").asc_nulls_first(), "text_crc32", "size")
    up_to = order.rowsBetween(Window.unboundedPreceding, -1)
    cut = placed.withColumn("b", F.coalesce(F.sum("size").over(up_to), F.lit(0))).withColumn("r", F.row_number().over(order) - 1)
    cut = cut.join(sent(before, shards * fine * (2 * kinds + 16)), "bucket").select("sh_id", "size", "text_crc32", "part", "given", (F.col("b") + F.col("bytes_before")).alias("b"), (F.col("r") + F.col("rows_before")).alias("r"))
    cut = settle(cut, "shard_order")
    main = int(cut.where("part = 0").agg(F.sum("size")).first()[0] or 0)

    def dealt(room: list[float], since: int, whole: int) -> Column:
        """The shard of a row by its middle: a stretch of ``whole`` bytes is cut in proportion to the shards' room."""
        scale = whole / (sum(room) or 1.0)
        bounds = [F.lit(since + scale * sum(room[: s + 1])) for s in range(shards - 1)]
        middle = F.col("b") + F.col("size") / 2
        return F.size(F.filter(F.array(*bounds), lambda c: c <= middle)).cast("int") if bounds else F.lit(0)

    run = dealt([max(0.0, level - x) for x in loads], 0, main)
    for r in cut.where("part = 0").groupBy(run.alias("run")).agg(F.sum("size").alias("load")).collect():
        loads[r["run"]] += r["load"]
    # what each run lacks of its share is filled up
    fillers = int(cut.where("part = 1").agg(F.sum("size")).first()[0] or 0)
    filled = dealt([max(0.0, level - x) for x in loads], main, fillers)
    shard = F.when(F.col("part") == 2, F.col("given")).when(F.col("part") == 1, filled).otherwise(run)
    cut = cut.select("sh_id", "size", "text_crc32", "part", shard.alias("shard"), "r")
    # a shard's rows are three runs of the order: shards x 3 rows say where they begin
    facts = cut.groupBy("shard", "part").agg(F.min("r").alias("first"), F.count(F.lit(1)).alias("rows"))
    firsts = facts.withColumn("ahead", F.coalesce(F.sum("rows").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    slot = (F.col("r") - F.col("first") + F.col("ahead")).cast("long")
    return cut.join(F.broadcast(firsts), ["shard", "part"]).select(F.col("sh_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _dealt_first(rows: DataFrame, shards: int, total: int) -> tuple[DataFrame, list[float]]:
    """(node, grp, size, given) of documents over a quarter of an even share, and the shards' loads of them.

    Sizes add up to the whole, so there are fewer than 4 x ``shards``; the largest goes first, to the emptiest.
    """
    large = rows.where(F.col("size") * (4 * shards) > total).groupBy("node", "grp", "size").agg(F.count(F.lit(1)).alias("n")).collect()
    loads, given = [0.0] * shards, []
    for r in sorted(large, key=lambda r: (-r["size"] * r["n"], r["node"], r["grp"] or 0)):
        s = loads.index(min(loads))
        loads[s] += r["size"] * r["n"]
        given.append((r["node"], r["grp"], r["size"], s))
    return rows.sparkSession.createDataFrame(given, "node long, grp long, size long, given int"), loads


def _level(loads: list[float], total: int) -> float:
    """How full all shards get that aren't fuller already."""
    level, rest = 0.0, total - sum(loads)
    ordered = sorted(loads)
    for k, x in enumerate(ordered, 1):
        upper = ordered[k] if k < len(ordered) else math.inf
        level = (sum(ordered[:k]) + rest) / k
        if level <= upper:
            break
    return level

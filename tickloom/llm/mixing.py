"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.llm.common import fresh, key_text, power_of_two, sent, settle, small_or_none, unit_hash, with_offsets

#: Means above this are drawn as a sum of independent draws, so that exp(-mean) stays exact.
CHUNK_MEAN = 50.0
#: Columns that the draw adds.
DRAWN = ("copy", "n_copies", "rate", "position")


def poisson_table(mean: Column) -> Column:
    """A struct of ``cdf``, the Poisson distribution's sums from k = 0 on, and ``draws``.

    A mean above CHUNK_MEAN is split into ``draws`` equal means, whose distribution it is.
    """
    draws = F.greatest(F.ceil(mean / CHUNK_MEAN).cast("int"), F.lit(1))
    mu = mean / draws
    last = F.ceil(mu + 12 * F.sqrt(mu) + 30).cast("int")
    zero = F.struct(F.exp(-mu).alias("p"), F.array(F.exp(-mu)).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mu / k
        # beyond the mean a vanishing p no longer moves the sum; the table ends there
        more = F.when((k < mu) | (p > 1e-18), F.array(F.element_at(acc["cdf"], -1) + p)).otherwise(F.array().cast("array<double>"))
        return F.struct(p.alias("p"), F.concat(acc["cdf"], more).alias("cdf"))

    return F.struct(F.aggregate(F.sequence(F.lit(1), last), zero, step, lambda acc: acc["cdf"]).alias("cdf"), draws.alias("draws"))


def drawn_count(table: Column, key: Column) -> Column:
    """The Poisson quantile of a uniform number hashed from ``key``: how often to repeat a row."""

    def draw(j: Column) -> Column:
        u = F.element_at(F.array(unit_hash(F.concat_ws("|", key, j.cast("string")))), 1)
        return F.aggregate(F.array(u), F.lit(0), lambda _, v: F.size(F.filter(table["cdf"], lambda c: c < v)))

    return F.aggregate(F.sequence(F.lit(0), table["draws"] - 1), F.lit(0), lambda acc, j: acc + draw(j))


def poisson_count(mean: Column, key: Column) -> Column:
    """``drawn_count`` for a mean; a null mean, or none above 0, gives 0."""
    return F.when(mean > 0, drawn_count(poisson_table(mean), key)).otherwise(0)


def source_rates(docs: DataFrame, weights: Mapping[str | None, float] | None = None, default_weight: float = 1.0, epochs: float = 1.0, *, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row a source: source, n_docs, size, rate.

    A document's size is its UTF-8 bytes plus 1.  A source's rate is the mean number of times that
    each of its documents has to appear, so that sources share ``epochs`` times the whole size in
    proportion to their weights.  A null source is a source of its own.
    """
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1
    per = docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(size).alias("size"))
    weight = F.lit(float(default_weight))
    for name, w in (weights or {}).items():
        weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    per = per.withColumn("weight", weight)
    whole = per.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight"))
    return per.crossJoin(F.broadcast(whole)).select("source", "n_docs", "size", (F.lit(float(epochs)) * F.col("all_size") * F.col("weight") / F.col("all_weight") / F.col("size")).alias("rate"))


def mix_sources(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    *,
    default_weight: float = 1.0,
    epochs: float = 1.0,
    seed: int = 17,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """Repeat each document as often as its source's target weight asks, in a global random order.

    Returns the columns of ``docs`` plus ``copy`` (1 to n_copies), ``n_copies``, ``rate`` (the mean
    that the count was drawn for) and ``position`` (gapless from 0: the place in the shuffled
    output).  Input columns of these names are replaced.  The count is the Poisson quantile of a
    number hashed from seed and id, so any rerun gives the same rows.

    Null ids hash as one value; rows with the same id draw the same count and keep their own copies,
    placed in the order of a hash of the whole row (rows alike in everything are interchangeable).
    Null or empty texts have size 1; texts of any length travel whole, once.  A null source is a source
    of its own; weights may name it as None.  An empty table gives an empty one.  Sources of weight
    0 vanish.
    """
    copies, rows, _ = drawn_copies(docs, weights, default_weight, epochs, seed, id_col, source_col, text_col)
    return placed(copies, rows, seed, id_col)


def mix_in_order(docs: DataFrame, weights: Mapping[str | None, float] | None = None, *, default_weight: float = 1.0, epochs: float = 1.0, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of ``mix_sources`` with the columns of ``docs`` only, in the order of their positions.

    Partition k holds the k-th range of the placing hash, sorted, so what is written of it is the
    global shuffle, file by file.  Nulls, ties, repeats and empty tables as there.
    """
    # columns of the input that are called like those of the draw keep their values under other names meanwhile
    names, other = docs.columns, {c: f"mix_kept_{i}" for i, c in enumerate(docs.columns) if c.lower() in DRAWN}
    docs = docs.withColumnsRenamed(other)
    copies, rows, size = drawn_copies(docs, weights, default_weight, epochs, seed, id_col, source_col, text_col)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // (64 << 20)))
    key, tie, part = fresh(copies, "mix_hash"), fresh(copies, "mix_tie"), fresh(copies, "mix_part")
    keyed = copies.withColumns({key: place_hash(seed, id_col), tie: row_hash(copies)})
    keyed = keyed.withColumn(part, F.least(F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("long") * parts / (1 << 32)), F.lit(parts - 1)).cast("int"))
    return keyed.repartitionById(parts, part).sortWithinPartitions(key, id_col, "copy", tie).select(*[F.col(other.get(c, c)).alias(c) for c in names])


def drawn_copies(docs: DataFrame, weights: Mapping[str | None, float] | None, default_weight: float, epochs: float, seed: int, id_col: str, source_col: str, text_col: str) -> tuple[DataFrame, int, int]:
    """(rows repeated as drawn, about how many, about their bytes).

    The distribution is tabled once a source; a row only looks its number up.  Up to 20,000 sources
    go to every task, beyond they are joined with each source's rows dealt over 64 salts.
    """
    spark = docs.sparkSession
    docs = docs.drop(*[c for c in docs.columns if c.lower() in DRAWN])
    rates = source_rates(docs, weights, default_weight, epochs, source_col=source_col, text_col=text_col)
    src = fresh(docs, "mix_source")
    small = small_or_none(rates)
    keyed = docs.withColumn(src, F.col(source_col).cast("string"))
    shape = "mix_key string, n_docs long, mix_size long, rate double"
    if small is not None:
        rows, size = (sum(r["rate"] * r[c] for r in small) for c in ("n_docs", "size"))
        # joined on null-safe equality; at most BROADCAST_ROWS rows, as counted, go to every task
        sides = spark.createDataFrame(small, shape).select("mix_key", "rate", poisson_table(F.col("rate")).alias("mix_table"))
        drawn = keyed.join(F.broadcast(sides), F.col(src).eqNullSafe(F.col("mix_key")))
    else:
        rows, size = rates.agg(F.sum(F.col("rate") * F.col("n_docs")), F.sum(F.col("rate") * F.col("size"))).first()
        salts = 64
        keyed = keyed.withColumn("mix_salt", F.pmod(F.xxhash64(id_col, text_col), F.lit(salts)).cast("int"))
        sides = rates.select(F.col("source").alias("mix_key"), "rate", poisson_table(F.col("rate")).alias("mix_table"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("mix_salt2"))
        drawn = keyed.join(sides, F.col(src).eqNullSafe(F.col("mix_key")) & (F.col("mix_salt") == F.col("mix_salt2"))).drop("mix_salt", "mix_salt2")
    count = F.when(F.col("rate") > 0, drawn_count(F.col("mix_table"), key_text(F.lit(seed), F.col(id_col)))).otherwise(0)
    drawn = drawn.withColumn("n_copies", count).drop(src, "mix_key", "mix_table")
    return drawn.where(F.col("n_copies") > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies")))), int(rows or 0), int(size or 0)


def place_hash(seed: int, id_col: str) -> Column:
    """What a copy is placed by: 128 bits as text."""
    return F.md5(key_text(F.lit(seed), F.lit("place"), F.col(id_col), F.col("copy")))


def row_hash(df: DataFrame) -> Column:
    """A hash of a whole row, for the order of rows with one id; maps can't be hashed and are left out."""
    return F.xxhash64(*[f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()])


#: Rows of a bucket, planned; and times that many from which on a repeated id, not chance, fills it.
EACH, HOT = 4_000, 16


def placed(copies: DataFrame, rows: int, seed: int, id_col: str) -> DataFrame:
    """``copies`` with ``position``: the rank of each copy's hash, found without one task seeing all rows.

    Buckets are ranges of the hash, and ranks are taken in each.  Where a repeated (or null) id makes
    a bucket large, all rows are sorted by ranges instead, which may cut between rows that are alike.
    """
    buckets = power_of_two(rows, EACH)
    key, bucket, tie = fresh(copies, "mix_hash"), fresh(copies, "mix_bucket"), fresh(copies, "mix_tie")
    high = F.conv(F.substring(key, 1, 6), 16, 10).cast("int")
    keyed = copies.withColumn(key, place_hash(seed, id_col)).withColumn(bucket, F.shiftright(high, 24 - (buckets.bit_length() - 1)))
    # the draw is evaluated for the counts and for the rows: from ids and sources alone, without texts
    per = settle(keyed.groupBy(bucket).agg(F.count(F.lit(1)).alias("mix_rows")), "mix_counts")
    order = [key, id_col, "copy", tie]
    keyed = keyed.withColumn(tie, row_hash(copies))
    if (per.agg(F.max("mix_rows")).first()[0] or 0) <= HOT * EACH:
        before = with_offsets(per, bucket, {"mix_before": F.col("mix_rows")})
        ranked = keyed.withColumn("position", F.row_number().over(Window.partitionBy(bucket).orderBy(*order)) - 1)
        ranked = ranked.join(sent(before, buckets), bucket)
        return ranked.withColumn("position", (F.col("position") + F.col("mix_before")).cast("long")).drop(key, bucket, tie, "mix_before")
    parts = max(int(copies.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // (HOT * EACH)))
    sort = [*order, fresh(copies, "mix_row")]
    sorted_ = keyed.withColumn(sort[-1], F.monotonically_increasing_id()).repartitionByRange(parts, *sort).sortWithinPartitions(*sort)
    # a settled row keeps the number of its partition and its place in it
    kept = settle(sorted_.withColumn(bucket, F.spark_partition_id()).withColumn("position", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).drop(key, tie, sort[-1]), "mix_sorted")
    before = with_offsets(kept, bucket, {"mix_before": F.lit(1)})
    return kept.join(sent(before, parts), bucket).withColumn("position", (F.col("position") + F.col("mix_before")).cast("long")).drop(bucket, "mix_before")

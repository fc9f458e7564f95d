"""Mixing sources to target weights by Poisson replication, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlife.functions.staging_area import stage

ALPHA = 0.5
SEED = 17
BLOCK_DIGITS = 3
BROADCAST_STEPS = 1 << 20  # numbers of all sources' distributions that may be sent to every task (8 MB)


def uniform(*key: Column, seed: int = SEED) -> Column:
    """A number in (0, 1) from the first 52 bits of the key's md5, the same in any engine."""
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *key)), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def last_step(rate: Column) -> Column:
    """Where a Poisson distribution function is cut: the rest is below 2**-60, far beneath the spacing of the uniform
    numbers, so nothing is capped."""
    return F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")


def cumulative(rates: DataFrame) -> DataFrame:
    """(steps_of, steps) from (source, rate): the Poisson distribution function at 0, 1, ... as an array.

    Terms are exp(k ln(rate) - rate - ln k!), so large rates do not underflow. They are summed over rows, one for each k,
    so a source costs as much as its array is long.
    """
    along = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    rows = rates.select("source", "rate", F.explode(F.sequence(F.lit(0), last_step(F.col("rate")))).alias("k"))
    k = F.col("k").cast("double")
    rows = rows.withColumn("log_factorial", F.sum(F.when(F.col("k") > 0, F.log(k)).otherwise(0.0)).over(along))
    mass = F.when(F.col("k") == 0, F.exp(-F.col("rate"))).otherwise(
        F.exp(k * F.log("rate") - F.col("rate") - F.col("log_factorial")))
    rows = rows.select("source", "k", F.sum(mass).over(along).alias("reached"))
    whole = rows.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("k", "reached"))).alias("steps"))
    return whole.select(F.col("source").alias("steps_of"), F.transform("steps", lambda s: s["reached"]).alias("steps"))


def repetition_rates(
    docs: DataFrame, source: str = "source", weights: dict[str | None, float] | None = None, alpha: float = ALPHA,
    epochs: float = 1.0,
) -> DataFrame:
    """(source, rate): how often a document of each source is wanted on average.

    The mix has ``epochs`` times the rows of ``docs``. Source shares follow ``weights``, which are scaled to the sources
    present (a source without a weight gets none of the mix); without weights they follow count ** ``alpha``.
    """
    counts = docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        weight = F.pow("n", F.lit(alpha))
    else:
        weight = F.lit(0.0)
        for name, value in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(value))).otherwise(weight)
    weighted = counts.withColumn("weight", weight)
    all_n, all_weight = weighted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    return weighted.where("weight > 0").select(
        "source", (F.lit(epochs) * F.lit(all_n) * F.col("weight") / F.lit(all_weight) / F.col("n")).alias("rate"))


def drawn_rows(docs: DataFrame, columns: list[str], doc: str, text: str, source: str) -> DataFrame:
    """(row, id, source, own): every row of ``docs`` as a struct of ``columns``, and what it draws its numbers by.

    That is the id where no other row has it. Rows that share an id, or have none, draw by the digest of their text too, and
    equal ones of them by their occurrence, counted before any of them are moved.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(doc).cast("string").alias("id"),
                       F.col(source).alias("source"), F.col(text).cast("string").alias("text"))
    shared = stage(rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 or id is null").select(
        F.col("id").alias("shared")), "shared-ids")
    same = F.col("id").eqNullSafe(F.col("shared"))
    alone = rows.join(shared, same, "left_anti").select("row", "source", F.col("id").alias("own"))
    if shared.isEmpty():
        return alone
    again = rows.join(shared, same, "left_semi").withColumn("digest", F.md5(F.coalesce("text", F.lit(""))))
    counted = again.groupBy("id", "digest", F.to_json("row").alias("content")).agg(
        F.count("*").alias("n"), F.first("row").alias("row"), F.first("source").alias("source"))
    earlier = Window.partitionBy("id", "digest").orderBy("content").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    each = before.withColumn("occurrence", F.explode(F.sequence(F.col("before") + 1, F.col("before") + F.col("n"))))
    own = F.concat_ws("|", F.coalesce("id", F.lit("")), "digest", F.col("occurrence").cast("string"))
    return alone.unionByName(each.select("row", "source", own.alias("own")))


def mix(
    docs: DataFrame, doc: str = "doc_id", source: str = "source", weights: dict[str | None, float] | None = None,
    alpha: float = ALPHA, epochs: float = 1.0, seed: int = SEED, text: str = "text",
) -> DataFrame:
    """All columns of ``docs`` plus ``mix_copy`` (from 1) and ``mix_position`` (from 0): a globally shuffled mix.

    A document appears as often as the Poisson quantile of its own seeded uniform number says, with its source's rate as
    mean, so a run repeats exactly and a document's count does not depend on other rows of the same counts. Positions
    follow the md5 of seed, id and copy; each block of equal leading digits is ordered by itself, so no task orders the
    whole mix. A null source is a source of its own. Rows that share an id, or have none, draw separately (by text and
    occurrence), so they neither vanish together nor meet in one block; of these, rows equal in id and text are taken in
    the order of their other columns. Columns of ``docs`` that are called as the two new ones are replaced; others may
    have any name. An empty table gives no rows.
    """
    rates = stage(repetition_rates(docs, source, weights, alpha, epochs), "rates")
    steps = cumulative(rates)
    kept = [c for c in docs.columns if c not in ("mix_copy", "mix_position")]
    length = rates.agg(F.sum(last_step(F.col("rate")).cast("bigint") + 1)).first()[0] or 0
    # Short distributions go to every task. Otherwise a shuffle join, whose hot sources adaptive execution splits.
    rated = drawn_rows(docs, kept, doc, text, source).join(
        F.broadcast(steps) if length <= BROADCAST_STEPS else steps, F.col("source").eqNullSafe(F.col("steps_of")))
    draw = uniform(F.lit("count"), F.col("own"), seed=seed)
    times = F.size(F.filter("steps", lambda s: draw >= s))
    copies = rated.withColumn("times", times).where("times > 0").select(
        "row", "own", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"))
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("order"), "own", F.col("copy").cast("string")))
    keyed = copies.withColumn("order", order).withColumn("block", F.substring("order", 1, BLOCK_DIGITS))
    sizes = keyed.groupBy("block").agg(F.count("*").alias("n"))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("block").orderBy("order", "own", "copy")) - 1
    shuffled = keyed.withColumn("inside", inside).join(F.broadcast(offsets), "block")  # 4,096 blocks at most
    return shuffled.select("row.*", F.col("copy").alias("mix_copy"), (F.col("before") + F.col("inside")).cast("bigint").alias("mix_position"))


def mix_sql(documents: str = "documents", alpha: float = ALPHA, seed: int = SEED) -> str:
    """The same mix of ``documents`` in DuckDB's SQL; rows equal in id and text have to be equal in all columns."""
    hashed = f"cast(('0x' || substr(md5('{seed}|count|' || own), 1, 13)) as bigint)"
    return f"""
with rates as (
  select source, n, sum(n) over () * pow(n, {alpha}) / sum(pow(n, {alpha})) over () / n as rate
  from (select source, count(*) as n from {documents} group by source)),
terms as (
  select source, k, case when k = 0 then exp(-rate) else exp(k * ln(rate) - rate - lgamma(k + 1)) end as mass
  from rates, lateral (select unnest(range(0, cast(ceil(rate + 12 * sqrt(rate) + 40) as bigint) + 1)) as k)),
steps as (select source, k, sum(mass) over (partition by source order by k) as reached from terms),
owned as (
  select *, case when doc_id is not null and count(*) over (partition by doc_id) = 1 then cast(doc_id as varchar)
    else coalesce(cast(doc_id as varchar), '') || '|' || md5(coalesce(text, '')) || '|'
      || row_number() over (partition by doc_id, coalesce(text, '')) end as own
  from {documents}),
drawn as (select *, ({hashed} + 0.5) / {float(1 << 52)!r} as draw from owned),
copies as (
  select d.*, s.k + 1 as mix_copy from drawn d join steps s on d.source is not distinct from s.source and d.draw >= s.reached)
select doc_id, source, lang, n_chars, text, cast(mix_copy as int) as mix_copy,
  row_number() over (order by md5('{seed}|order|' || own || '|' || mix_copy), own, mix_copy) - 1 as mix_position
from copies"""

"""Training rows: filter, weight, dedupe, repeat, chat messages, history and token limits, weighted draw."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracecheck.sources.shared import checkpoint

from .verdicts import TOLERANCE


def drop_reason(text: Column, skipped: Column, cover_ok: Column, asserts: Column, kill_rate: Column, min_kill: float = 0.25, require_cover: bool = True) -> Column:
    """Why a row is dropped, by the first rule that fits, or null. Unknown values never drop a row."""
    ladder = F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "empty").when(F.coalesce(skipped, F.lit(0)) > 0, "skipped-statements")
    if require_cover:
        ladder = ladder.when(cover_ok.eqNullSafe(F.lit(False)), "cover-fail")
    return ladder.when(asserts.eqNullSafe(F.lit(0)), "no-asserts").when(F.coalesce(kill_rate + TOLERANCE < min_kill, F.lit(False)), "below-min-kill")


def weight(kill_rate: Column, floor: float = 0.25, unscored: float = 0.5) -> Column:
    return F.when(kill_rate.isNull(), F.lit(unscored)).otherwise(F.greatest(F.lit(floor), kill_rate))


def dedupe_best(rows: DataFrame, by: list[str], value: Column, seq: str) -> DataFrame:
    """The row of greatest value in each group, the first of equals; by partial aggregation, not by sorting."""
    best = rows.groupBy(*by).agg(F.min_by(F.struct(*rows.columns), F.struct((-value).alias("v"), F.col(seq).alias("s"))).alias("__best"))
    return best.select("__best.*")


def copies(weight_: Column, times: int) -> Column:
    """How often a row is written: half to even, once at least."""
    return F.greatest(F.lit(1), F.bround(weight_ * times, 0).cast("int")) if times > 0 else F.lit(1)


def repeat(rows: DataFrame, weight_: Column, times: int) -> DataFrame:
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), copies(weight_, times))))


def messages(system: Column, prompt: Column, answer: Column) -> Column:
    """Chat messages; no system message where there is no system text."""
    make = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    both = F.array(make("user", prompt), make("assistant", F.concat(F.trim(answer), F.lit("\n"))))
    return F.when(F.coalesce(system, F.lit("")) != "", F.concat(F.array(make("system", system)), both)).otherwise(both)


def chat_messages(turns: DataFrame, by: list[str], order: str) -> DataFrame:
    """One row a conversation: its turns as an array of role and content, in order."""
    turn = F.struct(order, "role", F.col("text").alias("content"))
    listed = F.array_sort(F.collect_list(turn))
    return turns.groupBy(*by).agg(F.transform(listed, lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def trim_history(messages_: Column, pairs: int) -> Column:
    """The first two messages and the last `pairs` pairs after them."""
    head, tail = F.slice(messages_, 1, 2), F.slice(messages_, F.lit(3), F.greatest(F.size(messages_) - 2, F.lit(0)))
    last = F.slice(tail, F.greatest(F.size(tail) - 2 * pairs, F.lit(0)) + 1, F.lit(2 * pairs)) if pairs > 0 else F.slice(tail, 1, 0)
    return F.when(F.size(messages_) <= 2 + 2 * pairs, messages_).otherwise(F.concat(head, last))


def estimate_tokens(chars: Column, per_token: float = 2.5) -> Column:
    return F.floor(chars / per_token).cast("long")


def fit_tokens(chars: Column, fixed: Column, limit: int, factor: float = 0.7, least: float = 0.15) -> Column:
    """The share of a text that is kept: shrunk by `factor` until the whole fits, down to `least`."""
    steps = [1.0]
    while steps[-1] * factor > least:
        steps.append(steps[-1] * factor)
    options = F.array(*[F.lit(s) for s in steps])
    return F.coalesce(F.try_element_at(F.filter(options, lambda s: estimate_tokens(F.floor(chars * s) + fixed) <= limit), F.lit(1)), F.lit(steps[-1]))


def shuffle_key(seed: int, *keys: str) -> Column:
    """A seeded order, the same for the same keys wherever it is computed."""
    return F.xxhash64(F.lit(seed), *keys)


def weighted_draw(rows: DataFrame, key: str, weight_: Column, draws: int | None, seed: int, floor: float = 1e-3) -> DataFrame:
    """`draws` rows with replacement (None: as many as there are rows), each with chance in proportion to max(weight, floor).

    Rows are put on a line, each as long as its weight, and draws are points on it; both lie in one ordered stream, in
    which each point takes the row before it. Ranges of the stream are numbered first, so running sums stay within a
    range and only one total a range is brought together; no row meets a draw that isn't its own.
    """
    spark = rows.sparkSession
    w = F.greatest(F.coalesce(weight_, F.lit(0.0)), F.lit(floor)).cast("double")
    dealt = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.col(f"`{key}`").alias("__key"), w.alias("__w")).repartitionByRange("__key").sortWithinPartitions("__key")
    placed = checkpoint(dealt.withColumn("__part", F.spark_partition_id()).withColumn("__nth", F.monotonically_increasing_id()))
    inside = Window.partitionBy("__part").orderBy("__nth").rowsBetween(Window.unboundedPreceding, 0)
    totals = placed.groupBy("__part").agg(F.sum("__w").alias("t"), F.count("*").alias("n")).orderBy("__part").collect()  # a row a partition
    if not totals:
        return rows.withColumn("draw", F.lit(0).cast("bigint")).select("draw", *rows.columns)
    whole, before, at = float(sum(r["t"] for r in totals)), [], 0.0
    for r in totals:
        before.append((r["__part"], at))
        at += float(r["t"])
    base = F.broadcast(spark.createDataFrame(before, "__part int, __before double"))  # a row a partition, too
    own = placed.join(base, "__part").select((F.col("__before") + F.sum("__w").over(inside) - F.col("__w")).alias("__at"), F.lit(None).cast("bigint").alias("draw"), "row")
    unit = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 52)).cast("double") / float(1 << 52)
    points = spark.range(sum(r["n"] for r in totals) if draws is None else draws).select((unit * whole).alias("__at"), F.col("id").alias("draw"), F.lit(None).cast(own.schema["row"].dataType).alias("row"))
    line = checkpoint(own.unionAll(points).repartitionByRange("__at", F.col("draw").isNotNull()).sortWithinPartitions("__at", F.col("draw").isNotNull()).withColumn("__part", F.spark_partition_id()))
    order = Window.partitionBy("__part").orderBy("__at", F.col("draw").isNotNull())
    filled = line.withColumn("row", F.last("row", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("draw is not null")
    # A range that begins with draws takes the last row of the ranges before it: one row a range is carried on in order.
    last = line.groupBy("__part").agg(F.max_by("row", F.when(F.col("draw").isNull(), F.col("__at"))).alias("last"))
    before_it = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = last.select("__part", F.last("last", ignorenulls=True).over(before_it).alias("carried"))
    both = filled.join(ranges, "__part").select("draw", F.coalesce("row", "carried").alias("row"))
    return both.select("draw", "row.*")

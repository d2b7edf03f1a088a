"""Running values over ordered rows, without bringing a trace to one task.

Rows are dealt out by ranges of (trace, order), so a trace of any length lies in as many pieces as it needs. Each piece
is worked on by itself; of each piece only a summary (its number of rows, last values, highest values, sums) goes
through the trace in order, and what it carries to the next piece is joined back.

Defined results: null trace keys are a trace of their own; orders have to be unique within a trace, or equal rows come
in any order. An empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracecheck.sources.shared import checkpoint


def scan(rows: DataFrame, by: list[str], order: list[str], to: dict[str, tuple[str, str | None]]) -> DataFrame:
    """rows with new columns; to: name -> (what, column).

    what: count (rows before this one in its trace), last (the last value that isn't null, so far), previous (the value of
    the row before), highest and sum (so far). The sum counts nulls as 0.
    """
    dealt = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    placed = checkpoint(dealt.withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id()))
    piece = Window.partitionBy(*by, "__part").orderBy("__row")
    so_far = piece.rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*by).orderBy("__part")
    before = earlier.rowsBetween(Window.unboundedPreceding, -1)
    inside, summary, carried, made = {}, [F.min("__row").alias("__first")], {}, {}
    for k, (name, (what, column)) in enumerate(to.items()):
        own, sent, got = f"__own{k}", f"__sent{k}", f"__got{k}"
        value = F.col(column) if column else None
        if what == "count":
            summary.append(F.count("*").alias(sent))
            carried[got] = F.coalesce(F.sum(sent).over(before), F.lit(0))
            made[name] = F.col("__row") - F.col("__first") + F.col(got)  # numbers of a piece's rows are without gaps
        elif what == "last":
            inside[own] = F.last(value, ignorenulls=True).over(so_far)
            summary.append(F.max_by(value, F.when(value.isNotNull(), F.col("__row"))).alias(sent))
            carried[got] = F.last(sent, ignorenulls=True).over(before)
            made[name] = F.coalesce(own, got)
        elif what == "previous":
            inside[own] = F.lag(value).over(piece)
            summary.append(F.max_by(value, "__row").alias(sent))
            carried[got] = F.lag(sent).over(earlier)
            made[name] = F.when(F.col("__row") == F.col("__first"), F.col(got)).otherwise(F.col(own))
        elif what == "highest":
            inside[own] = F.max(value).over(so_far)
            summary.append(F.max(value).alias(sent))
            carried[got] = F.max(sent).over(before)
            made[name] = F.greatest(own, got)
        elif what == "sum":
            inside[own] = F.sum(F.coalesce(value, F.lit(0))).over(so_far)
            summary.append(F.sum(F.coalesce(value, F.lit(0))).alias(sent))
            carried[got] = F.coalesce(F.sum(sent).over(before), F.lit(0))
            made[name] = F.col(own) + F.col(got)
        else:
            raise ValueError(f"no running value {what}")
    pieces = placed.groupBy(*by, "__part").agg(*summary).withColumns(carried)
    named = pieces.select(*[F.col(c).alias(f"__t{i}") for i, c in enumerate(by)], F.col("__part").alias("__p"), "__first", *carried)
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__t{i}")) for i, c in enumerate(by)], F.col("__part") == F.col("__p"))
    return placed.withColumns(inside).join(named, same).withColumns(made).select(*rows.columns, *to)

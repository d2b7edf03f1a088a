"""Checks of a plan over a table of traces.

Rows of a trace are numbered in order; all checks read the same window, so a block costs one shuffle and one sort,
whatever the number of its checks. Verdicts speak of the recorded rows only: HOLDS (live at least once, never
violated), VIOLATED, VACUOUS (never live though there were rows enough), UNCHECKED (too few rows).

If the plan names a clock and rows have a column of that name, rows are first sampled: those at which the clock is 1 after
a row at which it wasn't (or at a trace's first row). Otherwise each row is a cycle.

A trace of up to ALONE rows is one window partition. Longer ones, of which one could be a long task, are numbered by
ranges and checked in chunks; each chunk also gets the last rows of the chunk before, as many as the plan looks back, so
all checks see the same history. `split` is the number of rows in a chunk: 0 for none, and None to count first whether
there is a longer trace. Results are the same.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracecheck.operators.scan import scan

from .properties import Check, Plan

CYCLE = "__cycle"
#: Chunks are longer than any plan looks back.
LEAST_SPLIT = 1024
#: Rows of a trace that one task takes.
ALONE = 1 << 20


def _sql(text: str, trace: list[str], order: list[str]) -> str:
    by = ", ".join(f"`{c}`" for c in trace)
    return text.replace("OVER w", f"OVER (PARTITION BY {by} ORDER BY {', '.join(f'`{c}`' for c in order)})")


def number_rows(rows: DataFrame, trace: list[str], order: list[str]) -> DataFrame:
    """rows with their place in their trace, without bringing a trace to one task."""
    return scan(rows, trace, order, {CYCLE: ("count", None)}).withColumn(CYCLE, F.col(CYCLE).cast("int"))


def chunk_size(rows: DataFrame, trace: list[str], split: int | None) -> int:
    """Rows of a chunk, or 0 if each trace goes to a task as a whole."""
    if split is not None:
        return split
    most = rows.groupBy(*trace).count().agg(F.max("count")).first()[0] or 0
    return ALONE if most > ALONE else 0


def sampled(rows: DataFrame, clock: str | None, trace: list[str], order: list[str], split: int = 0) -> DataFrame:
    """The rows at rising edges of the clock; all rows if there is no such column."""
    if clock is None or clock not in rows.columns:
        return rows
    marked = rows.withColumn("__high", F.coalesce(F.col(f"`{clock}`").cast("string").isin("1", "true", "1.0"), F.lit(False)))
    if split:
        marked = scan(marked, trace, order, {"__before": ("previous", "__high")})
    else:
        marked = marked.withColumn("__before", F.lag("__high").over(Window.partitionBy(*trace).orderBy(*order)))
    return marked.where("__high and not coalesce(__before, false)").drop("__high", "__before")


def _chunks(rows: DataFrame, plan: Plan, trace: list[str], order: list[str], split: int) -> DataFrame:
    """Numbered rows with their chunk; rows at a chunk's end also go to the next, marked as history."""
    size, back = max(split, LEAST_SPLIT), max(1, plan.reach)
    own = F.floor(F.col(CYCLE) / size).cast("int")
    near = F.col(CYCLE) % size >= size - back
    copy = F.when(near, F.array(F.struct(own.alias("c"), F.lit(False).alias("h")), F.struct((own + 1).alias("c"), F.lit(True).alias("h")))).otherwise(F.array(F.struct(own.alias("c"), F.lit(False).alias("h"))))
    return number_rows(rows, trace, order).withColumn("__x", F.explode(copy)).select("*", F.col("__x.c").alias("__chunk"), F.col("__x.h").alias("__history")).drop("__x")


def with_checks(rows: DataFrame, plan: Plan, trace: list[str], order: list[str], split: int | None = None) -> DataFrame:
    """rows with their cycle, and for each check `__live<k>` and `__bad<k>` (for a cover: reached)."""
    split = chunk_size(rows, trace, split)
    rows = sampled(rows, plan.clock, trace, order, split)
    if not split:
        by, at = trace, order
        numbered = rows.withColumn(CYCLE, F.row_number().over(Window.partitionBy(*by).orderBy(*at)) - 1)
    else:
        by, at = [*trace, "__chunk"], [CYCLE]
        numbered = _chunks(rows, plan, trace, order, split)
    # Running counts come in two steps, for what they count may look back itself; all windows share one shuffle and sort.
    so_far = Window.partitionBy(*by).orderBy(*at).rowsBetween(Window.unboundedPreceding, 0)
    hits = plan.hits
    numbered = numbered.withColumns({name: F.coalesce(F.expr(_sql(sql, by, at)), F.lit(False)).cast("int") for name, sql in hits.items()})
    numbered = numbered.withColumns({name: F.sum(name).over(so_far) for name in hits})
    made: dict[str, Column] = {}
    for k, c in enumerate(plan.checks):
        gate = (F.col(CYCLE) >= c.depth) & F.expr(_sql(c.gate, by, at))
        held = F.coalesce(F.expr(_sql(c.condition, by, at)), F.lit(False)) if c.condition is not None else F.lit(True)
        body = F.coalesce(F.expr(_sql(c.body, by, at)), F.lit(False))
        made[f"__live{k}"] = gate & held
        made[f"__bad{k}"] = gate & held & (body if c.kind == "cover" else ~body)
    checked = numbered.withColumns(made).drop(*hits)
    return checked.where("not __history").drop("__chunk", "__history") if split else checked


def violations(rows: DataFrame, plan: Plan, trace: list[str], order: list[str], split: int | None = None) -> DataFrame:
    """(trace, label, cycle) of each violated check."""
    checked = with_checks(rows, plan, trace, order, split)
    at = [(k, c) for k, c in enumerate(plan.checks) if c.kind != "cover"]
    each = F.array(*[F.when(F.col(f"__bad{k}"), F.lit(c.label)) for k, c in at])
    bad = reduce(lambda a, b: a | b, [F.col(f"__bad{k}") for k, _ in at])
    return checked.where(bad).select(*trace, F.explode(F.filter(each, lambda x: x.isNotNull())).alias("label"), F.col(CYCLE).alias("cycle"))


def tally(rows: DataFrame, plan: Plan, trace: list[str], order: list[str], split: int | None = None) -> DataFrame:
    """(trace, label, kind, n_rows, n_live, n_hit, first_hit): a row for each trace and check.

    n_hit counts violations of an assert, and reached rows of a cover.
    """
    checked = with_checks(rows, plan, trace, order, split)
    sums = [F.count("*").alias("n_rows")]
    for k in range(len(plan.checks)):
        sums += [F.count_if(f"__live{k}").alias(f"n{k}"), F.count_if(f"__bad{k}").alias(f"b{k}"), F.min(F.when(F.col(f"__bad{k}"), F.col(CYCLE))).alias(f"f{k}")]
    per_trace = checked.groupBy(*trace).agg(*sums)
    each = F.array(*[F.struct(F.lit(c.label).alias("label"), F.lit(c.kind).alias("kind"), F.lit(c.depth).alias("depth"), F.col(f"n{k}").alias("n_live"), F.col(f"b{k}").alias("n_hit"), F.col(f"f{k}").alias("first_hit")) for k, c in enumerate(plan.checks)])
    return per_trace.select(*trace, "n_rows", F.explode(each).alias("c")).select(*trace, "n_rows", "c.*")


def verdicts(rows: DataFrame, plan: Plan, trace: list[str], order: list[str], split: int | None = None) -> DataFrame:
    """tally with a verdict: for covers REACHED, UNREACHED or UNCHECKED."""
    return tally(rows, plan, trace, order, split).withColumn(
        "verdict",
        F.when(F.col("n_rows") <= F.col("depth"), "UNCHECKED")
        .when(F.col("kind") == "cover", F.when(F.col("n_hit") > 0, "REACHED").otherwise("UNREACHED"))
        .when(F.col("n_hit") > 0, "VIOLATED")
        .when(F.col("n_live") == 0, "VACUOUS")
        .otherwise("HOLDS"),
    )


def report(rows: DataFrame, plan: Plan, trace: list[str], order: list[str], split: int | None = None) -> DataFrame:
    """(trace, item, verdict, reason): verdicts, and each item that the plan skipped as UNCHECKED with its reason, for every trace."""
    checked = verdicts(rows, plan, trace, order, split).select(*trace, F.col("label").alias("item"), "verdict", F.lit(None).cast("string").alias("reason"))
    if not plan.skipped:
        return checked
    items = F.array(*[F.struct(F.lit(item).alias("item"), F.lit("UNCHECKED").alias("verdict"), F.lit(reason).alias("reason")) for item, reason in plan.skipped])
    return checked.unionByName(rows.select(*trace).distinct().select(*trace, F.explode(items).alias("x")).select(*trace, "x.*"))


def suite(rows: DataFrame, plan: Plan, trace: list[str], order: list[str], split: int | None = None) -> DataFrame:
    """One verdict a trace: the worst of its asserts, with the violated labels and the first violation."""
    per_check = verdicts(rows, plan, trace, order, split).where("kind <> 'cover'")
    return per_check.groupBy(*trace).agg(
        F.max("n_rows").alias("n_rows"),
        F.count("*").alias("n_checks"),
        F.count_if(F.col("verdict") == "HOLDS").alias("n_holds"),
        F.count_if(F.col("verdict") == "VIOLATED").alias("n_violated"),
        F.count_if(F.col("verdict") == "VACUOUS").alias("n_vacuous"),
        F.count_if(F.col("verdict") == "UNCHECKED").alias("n_unchecked"),
        F.min(F.when(F.col("verdict") == "VIOLATED", F.col("first_hit"))).alias("first_violation"),
        F.when(F.count_if(F.col("verdict") == "VIOLATED") > 0, "VIOLATED")
        .when(F.count_if(F.col("verdict") == "UNCHECKED") > 0, "UNCHECKED")
        .when(F.count_if(F.col("verdict") == "VACUOUS") > 0, "VACUOUS")
        .otherwise("HOLDS")
        .alias("verdict"),
    )


def reset_held(rows: DataFrame, trace: list[str], order: list[str], active: str, cycles: int, split: int | None = None, clock: str | None = None) -> DataFrame:
    """Rows of the traces whose first `cycles` rows (of those sampled by a clock) all have the reset active (an SQL condition).

    Checks that assume a reset are made on these, with min_depth=cycles; other traces tell nothing about them.
    """
    split = chunk_size(rows, trace, split)
    own = sampled(rows, clock, trace, order, split)
    if not split:
        marked = own.withColumn(CYCLE, F.row_number().over(Window.partitionBy(*trace).orderBy(*order)) - 1)
    else:
        marked = number_rows(own, trace, order)
    off = (F.col(CYCLE) < cycles) & ~F.coalesce(F.expr(active), F.lit(False))
    if not split:
        broken = F.max(off.cast("int")).over(Window.partitionBy(*trace))
        return marked.withColumn("__broken", broken).where("__broken = 0").drop(CYCLE, "__broken")
    bad = marked.where(off).select(*[F.col(c).alias(f"__t{i}") for i, c in enumerate(trace)]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__t{i}")) for i, c in enumerate(trace)])
    return marked.drop(CYCLE).join(bad, same, "left_anti")


def assumptions(plan: Plan) -> tuple[Plan, Plan]:
    """The plan's assumptions, and the rest of it."""
    return tuple(Plan([c for c in plan.checks if (c.kind == "assume") == own], clock=plan.clock) for own in (True, False))


def assumed(rows: DataFrame, plan: Plan, trace: list[str], order: list[str], split: int | None = None) -> DataFrame:
    """Rows of each trace before the first that violates one of the plan's assumptions; what follows tells nothing.

    The running maximum reads the same window as the checks, so there is one shuffle and one sort. With a clock, sampled
    rows are returned.
    """
    own = assumptions(plan)[0]
    if not own.checks:
        return rows
    split = chunk_size(rows, trace, split)
    checked = with_checks(rows, own, trace, order, split)
    bad = reduce(lambda a, b: a | b, [F.col(f"__bad{k}") for k in range(len(own.checks))])
    if split:
        first = checked.where(bad).groupBy(*[F.col(c).alias(f"__t{i}") for i, c in enumerate(trace)]).agg(F.min(CYCLE).alias("__end"))
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__t{i}")) for i, c in enumerate(trace)])
        return checked.join(first, same, "left").where(F.col("__end").isNull() | (F.col(CYCLE) < F.col("__end"))).select(*rows.columns)
    so_far = Window.partitionBy(*trace).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return checked.withColumn("__broken", F.max(bad).over(so_far)).where("not __broken").select(*rows.columns)


def check_labels(plan: Plan) -> list[tuple[str, str, str, int]]:
    """(label, base label, kind, depth) of each check, for a table beside the verdicts."""
    return [(c.label, c.base, c.kind, c.depth) for c in plan.checks]


def nothing_to_check(plan: Plan, n_rows: int) -> str | None:
    """Why a plan checks nothing on traces of n_rows rows, or None."""
    asserts: list[Check] = [c for c in plan.checks if c.kind == "assert"]
    if not plan.checks:
        return "no check"
    if not asserts and not any(c.kind == "cover" for c in plan.checks):
        return "no assert"
    if all(c.depth >= n_rows for c in plan.checks):
        return f"every check needs over {n_rows} rows"
    return None

"""Traces: change records to intervals, steps, rendered values and counterexample windows.

A signal is a run of intervals [start, stop) of indices, one for each change, so tables grow with the changes and not with
times by signals; what is asked at some indices (steps, samples) is found by counting these between the intervals' ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import scan

UNKNOWN = "x"


def last_change(changes: DataFrame) -> DataFrame:
    """Of several changes of one signal at one index, the last (trace_id, ti, code, seq, raw)."""
    return changes.groupBy("trace_id", "ti", "code").agg(F.max_by("raw", "seq").alias("raw"))


def intervals(changes: DataFrame, times: DataFrame, signals: DataFrame, split: bool = False) -> DataFrame:
    """(trace_id, code, start, stop, raw): where each signal has which value, from index 0 to the trace's last; 'x' before its
    first change.

    changes: trace_id, ti, seq, code, raw (ti -1: before the first time); times: trace_id, ti, t; signals: trace_id, code.
    split: changes of one signal don't fit one task.
    """
    whole = times.groupBy("trace_id").agg((F.max("ti") + 1).alias("n"))
    never = signals.select("trace_id", F.lit(-2).alias("ti"), "code", F.lit(UNKNOWN).alias("raw")).distinct()
    starts = last_change(changes).select("trace_id", F.col("ti").cast("int").alias("ti"), "code", "raw").unionByName(never.withColumn("ti", F.col("ti").cast("int")))
    if split:
        back = scan(starts.withColumn("__back", -F.col("ti")), ["trace_id", "code"], ["__back"], {"__next": ("previous", "ti")})
    else:
        back = starts.withColumn("__next", F.lead("ti").over(Window.partitionBy("trace_id", "code").orderBy("ti")))
    start, stop = F.greatest("ti", F.lit(0)), F.coalesce("__next", "n")
    ends = back.join(whole, "trace_id").select("trace_id", "code", start.alias("start"), stop.cast("int").alias("stop"), "raw")
    return ends.where("start < stop")


def dense(spans: DataFrame, times: DataFrame) -> DataFrame:
    """(trace_id, ti, t, code, raw): each interval's value at each of its indices."""
    each = spans.select("trace_id", "code", "raw", F.explode(F.sequence(F.col("start"), F.col("stop") - 1)).alias("ti"))
    return each.join(times.select("trace_id", "ti", "t"), ["trace_id", "ti"]).select("trace_id", "ti", "t", "code", "raw")


def wide(changes: DataFrame, times: DataFrame, columns: dict[str, str], split: bool = False) -> DataFrame:
    """(trace_id, ti, t, and a column for each name of `columns`): the values of a few signals (name -> code) at each index.

    A row an index, with one shuffle by trace; changes are put side by side before values are carried forward.
    """
    last = last_change(changes.where(F.col("code").isin(*columns.values())))
    beside = last.groupBy("trace_id", "ti").agg(*[F.max(F.when(F.col("code") == code, F.col("raw"))).alias(name) for name, code in columns.items()])
    rows = times.select("trace_id", "ti", "t").join(beside, ["trace_id", "ti"], "full")
    if split:
        filled = scan(rows.withColumnsRenamed({n: f"__{n}" for n in columns}), ["trace_id"], ["ti"], {n: ("last", f"__{n}") for n in columns})
    else:
        w = Window.partitionBy("trace_id").orderBy("ti").rowsBetween(Window.unboundedPreceding, 0)
        filled = rows.withColumns({n: F.last(n, ignorenulls=True).over(w) for n in columns})
    return filled.where("t is not null").select("trace_id", "ti", "t", *[F.coalesce(n, F.lit(UNKNOWN)).alias(n) for n in columns])


def forward_fill(rows: DataFrame, by: list[str], order: list[str], value: str, to: str, default: str = UNKNOWN) -> DataFrame:
    """Adds the last value that is not null, or the default."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(to, F.coalesce(F.last(value, ignorenulls=True).over(w), F.lit(default)))


def steps_by_change(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Rows at which value changes (the first row always), numbered from 0 in `step`."""
    w = Window.partitionBy(*by).orderBy(*order)
    marked = rows.withColumn("__first", F.row_number().over(w) == 1).withColumn("__before", F.lag(value).over(w))
    return _numbered(marked.where(F.col("__first") | ~F.col(value).eqNullSafe(F.col("__before"))), by, order)


def steps_by_edge(rows: DataFrame, by: list[str], order: list[str], high: Column) -> DataFrame:
    """Rows at which `high` becomes true, numbered from 0 in `step`."""
    w = Window.partitionBy(*by).orderBy(*order)
    marked = rows.withColumn("__high", F.coalesce(high, F.lit(False))).withColumn("__before", F.coalesce(F.lag("__high").over(w), F.lit(False)))
    return _numbered(marked.where("__high and not __before"), by, order).drop("__high")


def _numbered(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("step", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).drop("__first", "__before")


def steps(spans: DataFrame, times: DataFrame, signals: DataFrame, clock: str | None = None) -> DataFrame:
    """(trace_id, ti, step): step marks change, else the clock rises, else each index; per trace, as far as there are any.

    Only the intervals of the marking signals are read; where there are none, the indices.
    """
    names = signals.select("trace_id", "ord", "code", "name", F.concat_ws(".", F.concat("scope", F.array("name"))).alias("full"))

    def first(name: str) -> DataFrame:
        hit = names.where((F.col("name") == name) | (F.col("full") == name))
        return spans.join(hit.groupBy("trace_id").agg(F.min_by("code", "ord").alias("code")), ["trace_id", "code"]).withColumnRenamed("start", "ti")

    by, order = ["trace_id"], ["ti"]
    how = steps_by_change(first("smt_step"), by, order, "raw").select("trace_id", "ti", "step", F.lit(0).alias("how"))
    if clock is not None:
        edges = steps_by_edge(first(clock), by, order, F.col("raw") == "1")
        how = how.unionByName(edges.select("trace_id", "ti", "step", F.lit(1).alias("how")))
    marked = how.withColumn("__best", F.min("how").over(Window.partitionBy("trace_id"))).where("how = __best").select("trace_id", "ti", "step")
    unmarked = times.join(how.select("trace_id").distinct(), "trace_id", "left_anti").select("trace_id", F.col("ti").cast("int").alias("ti"))
    return marked.unionByName(_numbered(unmarked, by, order))


def visible(signals: DataFrame, top: str | None = None, include_internal: bool = False, only: list[str] | None = None) -> DataFrame:
    """The signals that a report shows: those of the top module or of no scope, in any depth.

    Step marks and events never; solver-made ones (witness scopes, names in _EN) only with include_internal, the
    latter also if they are asked for by name.
    """
    name, full = F.col("name"), F.concat_ws(".", F.concat("scope", F.array("name")))
    shown = (name != "smt_step") & (F.col("kind") != "event")
    if not include_internal:
        shown &= ~F.exists("scope", lambda x: x == "_witness_")
        if only is None:
            shown &= ~name.endswith("_EN")
    if top is not None:
        shown &= (F.size("scope") == 0) | F.coalesce(F.try_element_at("scope", F.lit(1)) == top, F.lit(False))
    if only is not None:
        shown &= name.isin(only) | full.isin(only)
    return signals.where(shown)


def _padded(raw: Column, width: Column) -> Column:
    return F.lpad(raw, F.greatest(width, F.length(raw)), F.lit("0"))


def format_value(raw: Column, width: Column) -> Column:
    """A sample as text: a real without its r, a bit as it is, clean bits as hex of the width's digits, else b and bits.

    Hex is built a nibble at a time, so any width goes.
    """
    bits = _padded(raw, width)
    digits = F.floor((F.length(bits) + 3) / 4).cast("int")
    even = F.lpad(bits, digits * 4, F.lit("0"))
    nibbles = F.transform(F.sequence(F.lit(0), digits - 1), lambda i: F.lower(F.conv(F.substring(even, i * 4 + 1, F.lit(4)), 2, 16)))
    least = F.floor((width + 3) / 4).cast("int")
    hexed = F.concat_ws("", nibbles)
    bare = F.when(F.length(hexed) > least, F.regexp_replace(hexed, "^0+", "")).otherwise(hexed)
    hexed = F.when(F.length(bare) < least, F.lpad(bare, least, F.lit("0"))).otherwise(bare)
    return F.when(raw.startswith("r"), F.substring(raw, F.lit(2), F.length(raw))).when(width == 1, raw).when(raw.rlike("^[01]+$"), F.concat(F.lit("0x"), hexed)).otherwise(F.concat(F.lit("b"), raw))


def counted_steps(spans: DataFrame, steps_: DataFrame, split: bool = False) -> DataFrame:
    """spans with `first` and `n`: the first step in each interval and how many are there; those without a step are left out.

    Steps and intervals' ends lie in one ordered stream, in which each end counts the steps before it.
    """
    points = spans.select("trace_id", F.explode(F.array("start", "stop")).alias("ti")).distinct().select("trace_id", "ti", F.lit(0).alias("is_step"))
    line = points.unionByName(steps_.select("trace_id", F.col("ti").cast("int").alias("ti"), F.lit(1).alias("is_step")))
    if split:
        counted = scan(line, ["trace_id"], ["ti", "is_step"], {"before": ("sum", "is_step")})
    else:
        w = Window.partitionBy("trace_id").orderBy("ti", "is_step").rowsBetween(Window.unboundedPreceding, 0)
        counted = line.withColumn("before", F.sum("is_step").over(w))
    ends = counted.where("is_step = 0").select("trace_id", "ti", F.col("before").cast("int").alias("before"))
    at = lambda end, to: ends.select("trace_id", F.col("ti").alias(end), F.col("before").alias(to))
    found = spans.join(at("start", "first"), ["trace_id", "start"]).join(at("stop", "__after"), ["trace_id", "stop"])
    return found.withColumn("n", F.col("__after") - F.col("first")).where("n > 0").drop("__after")


def traces(spans: DataFrame, steps_: DataFrame, signals: DataFrame) -> DataFrame:
    """(trace_id, name, width, values): each signal's rendered values by step. Each interval is rendered once.

    In a report, traces go by `trace_order` of their names.
    """
    shown = signals.select("trace_id", "code", "name", "scope", "width")
    at = counted_steps(spans.join(shown.select("trace_id", "code").distinct(), ["trace_id", "code"], "left_semi"), steps_).join(shown, ["trace_id", "code"])
    full = F.when(F.size("scope") > 1, F.concat_ws(".", F.concat(F.slice("scope", 2, F.size("scope")), F.array("name")))).otherwise(F.col("name"))
    run = F.struct("first", "n", format_value(F.col("raw"), F.col("width")).alias("v"))
    values = F.flatten(F.transform(F.array_sort(F.collect_list(run)), lambda x: F.array_repeat(x["v"], x["n"])))
    return at.groupBy("trace_id", full.alias("name"), "width").agg(values.alias("values"))


def trace_order(name: Column) -> Column:
    """A report's order of traces: those of fewer scopes first, then by name."""
    return F.struct(F.size(F.split(name, r"\.")).alias("depth"), name.alias("name"))


def counterexample(rows: DataFrame, failing: DataFrame, by: list[str], cycle: str, window: int = 4) -> DataFrame:
    """Rows of failing traces from `window` cycles before the failing one to it; failing: by..., failing_cycle.

    A trace that ends before its failing cycle is shown to its last row.
    """
    last = rows.groupBy(*by).agg(F.max(cycle).alias("__last"))
    bound = failing.join(last, by).select(*by, F.least(F.coalesce("failing_cycle", "__last"), "__last").alias("at"))
    return rows.join(bound, by).where((F.col(cycle) <= F.col("at")) & (F.col(cycle) >= F.greatest(F.lit(0), F.col("at") - window)))


def changed_at(values: DataFrame, failing: DataFrame, by: list[str], cycle: str, signals: list[str]) -> DataFrame:
    """(by..., at, changed): which signal columns differ from the row before at the failing cycle (none at cycle 0)."""
    w = Window.partitionBy(*by).orderBy(cycle)
    moved = F.filter(F.array(*[F.when(~F.col(s).eqNullSafe(F.lag(s).over(w)), F.lit(s)) for s in signals]), lambda x: x.isNotNull())
    marked = values.withColumn("__moved", moved)
    last = values.groupBy(*by).agg(F.max(cycle).alias("__last"))
    bound = failing.join(last, by).select(*by, F.least(F.coalesce("failing_cycle", "__last"), "__last").alias("at"))
    empty = F.array().cast("array<string>")
    return marked.join(bound, by).where(F.col(cycle) == F.col("at")).select(*by, "at", F.when(F.col("at") >= 1, F.col("__moved")).otherwise(empty).alias("changed"))


def render(values: Column, name: Column, changed: Column, width: int = 8) -> Column:
    """A line of a counterexample table: the name, its values, a star if it changed."""
    cells = F.concat_ws(" ", F.transform(values, lambda v: F.lpad(v, width, " ")))
    return F.concat(F.rpad(name, 20, " "), F.lit(" | "), cells, F.when(changed, " *").otherwise(""))

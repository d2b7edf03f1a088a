"""Statuses, kill reports and the gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Statuses by exit code, and rewards by status.
STATUS_BY_EXIT = {0: "PASS", 2: "FAIL", 4: "UNKNOWN", 8: "TIMEOUT", 16: "ERROR"}
REWARDS = {"PASS": 1.0, "FAIL": 0.0, "TIMEOUT": 0.0, "UNKNOWN": 0.0, "ERROR": -1.0}
TOLERANCE = 1e-12


def status(exit_code: Column, timed_out: Column | None = None, undeclared: Column | None = None) -> Column:
    """The status of a run: a timeout outweighs the exit code; undeclared signals make a verdict an error."""
    out = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in STATUS_BY_EXIT.items() for x in pair]), exit_code), F.lit("ERROR"))
    if timed_out is not None:
        out = F.when(timed_out, "TIMEOUT").otherwise(out)
    if undeclared is not None:
        out = F.when(undeclared & out.isin("PASS", "FAIL", "UNKNOWN"), "ERROR").otherwise(out)
    return out


def reward(status_: Column) -> Column:
    return F.when(status_ == "PASS", 1.0).when(status_ == "ERROR", -1.0).otherwise(0.0)


def valid(status_: Column) -> Column:
    """A mutant that ran to a verdict."""
    return F.coalesce(status_.isin("PASS", "FAIL"), F.lit(False))


def killed(status_: Column) -> Column:
    return F.coalesce(status_ == "FAIL", F.lit(False))


def kill_rate(n_killed: Column, n_valid: Column, empty: float | None = 0.0) -> Column:
    """killed / valid; `empty` (0.0, or null) without a valid mutant."""
    return F.when(n_valid > 0, n_killed / n_valid).otherwise(F.lit(empty).cast("double"))


def kill_report(outcomes: DataFrame, by: list[str], name: str, status_: str = "status") -> DataFrame:
    """Per block: mutants, valid, killed, kill rate, and the survivors' names in order."""
    s = F.col(status_)
    counted = outcomes.groupBy(*by).agg(
        F.count("*").alias("mutants"),
        F.count_if(valid(s)).alias("valid_mutants"),
        F.count_if(killed(s)).alias("killed"),
        F.array_sort(F.collect_list(F.when(s == "PASS", F.col(name)))).alias("survivors"),
    )
    return counted.withColumn("kill_rate", kill_rate(F.col("killed"), F.col("valid_mutants")))


def scored(prove: Column, cover: Column) -> Column:
    """Whether mutants are run at all: a proof, and covers that passed or weren't run."""
    return F.coalesce(prove == "PASS", F.lit(False)) & (cover.isNull() | (cover == "PASS"))


def vacuity_ok(cover: Column, n_vacuous: Column) -> Column:
    """Null if covers weren't run."""
    return F.when(cover.isNull(), F.lit(None).cast("boolean")).otherwise((cover == "PASS") & (n_vacuous == 0))


def gate_passed(prove: Column, vacuity: Column) -> Column:
    return F.coalesce(prove == "PASS", F.lit(False)) & ~vacuity.eqNullSafe(F.lit(False))


def gate_fails(passed: Column, rate: Column, min_kill: float) -> Column:
    """The suite's bar; it has no tolerance."""
    return ~passed | (rate < min_kill)


def meets_kill(min_kill: Column, proven: Column, attempted: Column, n_valid: Column, n_killed: Column) -> Column:
    """No bar; not proven; nothing to score; nothing valid; else the rate against the bar, with a tolerance."""
    rate = kill_rate(n_killed, n_valid)
    return F.when(min_kill <= 0, True).when(~proven, False).when(attempted == 0, True).when(n_valid == 0, False).otherwise(rate + TOLERANCE >= min_kill)


def cone_overlap(design: Column, block: Column) -> tuple[Column, Column]:
    """The design's signals that the block names, in order, and their share (1.0 for a design without signals)."""
    overlap = F.array_sort(F.array_intersect(design, block))
    return overlap, F.when(F.size(design) == 0, 1.0).otherwise(F.size(overlap) / F.size(F.array_distinct(design)))


def base_label(label: Column) -> Column:
    """As plans.properties.base_label."""
    return F.regexp_replace(F.element_at(F.split(label, r"\."), -1), r"(__k\d+)?(__c\d+|__cov)?$", "")


# Lines of a checker's log, and endings of lines that say ERROR without being one.
FAILED_AT = r"(?i)failed assertion\s+(\S+)\s+at\s+\S+\s+step\s+(\d+)"
FAILED_IN = r"Assert failed in\s+\S+:\s+(\S+)"
ERROR_LINE = r"(?:ERROR|error):\s*(.+)"
NOT_REACHED = r"Unreached cover statement at\s+\S+:\s*(\S+)"
REACHED = r"Reached cover statement in step\s+\d+\s+at\s+\S+:\s*(\S+)"
NO_ERROR = ("returned ERROR", "DONE (ERROR")


def parse_log(text: Column) -> dict[str, Column]:
    """What a checker's log says: failed base labels and their first step, errors, covers reached and not reached."""

    def each(pattern: str, group: int = 1) -> Column:
        return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    named, plain = each(FAILED_AT), each(FAILED_IN)
    errors = F.filter(F.split(text, "\n"), lambda x: x.rlike(ERROR_LINE) & ~x.contains(NO_ERROR[0]) & ~x.contains(NO_ERROR[1]))
    last = lambda x: F.element_at(F.split(x, r"\."), -1)
    return {
        "failed": F.array_distinct(F.transform(F.when(F.size(named) > 0, named).otherwise(plain), base_label)),
        "failing_step": F.array_min(F.transform(each(FAILED_AT, 2), lambda x: x.cast("int"))),
        "errors": F.array_distinct(F.transform(errors, lambda x: F.btrim(F.regexp_extract(x, ERROR_LINE, 1)))),
        "unreached": F.array_distinct(F.transform(each(NOT_REACHED), last)),
        "reached": F.array_distinct(F.transform(each(REACHED), last)),
    }


def report_json(columns: list[str]) -> Column:
    """A gate row as JSON; nulls are written, as in the reports that are read back."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def markdown_row(cells: list[Column]) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(c.cast("string"), F.lit("-")) for c in cells]), F.lit(" |"))

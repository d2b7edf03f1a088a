"""Catalogs of designs, and keyed lookups with defaults."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def skip_reason(n_hdl: Column, n_vhdl: Column, has_spec: Column, dual_edge: Column) -> Column:
    """Why a design can't be used, by the first rule that fits, or null."""
    return (
        F.when((n_hdl == 0) & (n_vhdl == 0), "no HDL")
        .when(n_hdl + n_vhdl > 1, "multiple HDL files")
        .when(n_vhdl > 0, "VHDL")
        .when(~has_spec, "missing spec")
        .when(dual_edge, "both clock edges")
    )


def matches(key: Column, name: Column, wanted: list[str]) -> Column:
    """A key or name that is wanted, or a key whose last part is."""
    if not wanted:
        return F.lit(True)
    return key.isin(wanted) | name.isin(wanted) | reduce(lambda a, b: a | b, [key.endswith("/" + w) for w in wanted])


def select(designs: DataFrame, wanted: list[str], open_only: bool = True) -> DataFrame:
    chosen = designs.where(matches(F.col("key"), F.col("name"), wanted))
    return chosen.where("skip_reason is null") if open_only else chosen


def totals(designs: DataFrame, by: list[str] | None = None) -> DataFrame:
    counted = [F.count("*").alias("designs"), F.count_if(F.col("skip_reason").isNull()).alias("open_ok"), F.count_if(F.col("mutants") > 0).alias("with_mutants")]
    return designs.groupBy(*by).agg(*counted) if by else designs.agg(*counted)


def with_defaults(left: DataFrame, right: DataFrame, on: list[str], defaults: dict[str, object]) -> DataFrame:
    """left outer join; missing values of right get defaults."""
    joined = left.join(right, on, "left")
    return joined.select(*[F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in joined.columns])


def first_by(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group; by partial minima."""
    best = rows.groupBy(*by).agg(F.min_by(F.struct(*rows.columns), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).alias("__best"))
    return best.select("__best.*")


def drop_duplicates_against(rows: DataFrame, kept: DataFrame, name: str, refs: str | None = None) -> DataFrame:
    """Rows whose name kept doesn't have, case aside; and, with refs, that don't refer to a dropped row."""
    known = kept.select(F.lower(name).alias("__n")).distinct()
    left = rows.join(known, F.lower(F.col(name)) == F.col("__n"), "left_anti")
    if refs is None:
        return left
    gone = rows.join(known, F.lower(F.col(name)) == F.col("__n"), "left_semi").select(F.col(name).alias("__r")).distinct()
    return left.join(gone, F.col(refs) == F.col("__r"), "left_anti")


def orphans(declared: DataFrame, name: str, used: DataFrame, ref: str) -> DataFrame:
    """Declared rows that nothing refers to."""
    return declared.join(used.select(F.col(ref).alias("__r")).distinct(), F.col(name) == F.col("__r"), "left_anti")


def slug(text: Column) -> Column:
    """Lower case, runs of other than a-z and 0-9 as one underscore, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(F.btrim(text)), "[^a-z0-9]+", "_"), F.lit("_"))


def one_per_operator_first(rows: DataFrame, by: list[str], operator: str, rank: Column) -> DataFrame:
    """Adds `pos`: rows in order of rank, but the first of each operator before all others."""
    nth = F.row_number().over(Window.partitionBy(*by, operator).orderBy(rank))
    ranked = rows.withColumn("__rank", rank).withColumn("__later", (nth > 1).cast("int"))
    pos = F.row_number().over(Window.partitionBy(*by).orderBy("__later", "__rank")) - 1
    return ranked.withColumn("pos", pos).drop("__rank", "__later")


def vote(counts: DataFrame, by: list[str], name: str, count: str, order: str) -> DataFrame:
    """The name with the highest count, the earliest of equals."""
    return counts.groupBy(*by).agg(F.max_by(name, F.struct(F.col(count), (-F.col(order)).alias("o"))).alias(name))

"""Macros over tables of texts: definitions and uses as rows.

Definitions are closed first: those whose values use other macros are joined with the definitions again and again, the
changed ones only, until none changes (seven times at most). Then each text meets the closed definitions once; together
that is what eight passes over the text would give. Only texts with a use take part; a use without a definition stays.

Defined results: of several definitions of a name the last one counts; one without a value, or with arguments, is none. A
macro that uses itself ends after eight passes, and is left over. Null texts stay null, empty ones empty. Definitions are
looked up within the rows of equal `by`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracecheck.functions.scan import DIRECTIVES, PASSES
from tracecheck.sources.shared import checkpoint

from . import source

_DEFINE = r"(?m)^[ \t]*`define[ \t]+([A-Za-z_]\w*(?![\w(]))[ \t]*([^\n]*?)[ \t]*$"
_PIECE = r"`[A-Za-z_]\w*|[^`]+|`"


def definitions(texts: DataFrame, by: list[str], code: str, order: str) -> DataFrame:
    """(by, name, value): what texts define; of several texts of a group the last by `order` counts."""
    blank = source.blank_comments(F.col(code))
    found = lambda k: F.regexp_extract_all(blank, F.lit(_DEFINE), F.lit(k))
    rows = texts.select(*by, F.col(order).alias("__text"), F.posexplode(F.arrays_zip(found(1).alias("n"), found(2).alias("v"))).alias("__pos", "__d"))
    rows = rows.select(*by, "__text", "__pos", F.col("__d.n").alias("name"), F.col("__d.v").alias("value")).where("value <> ''")
    return rows.groupBy(*by, "name").agg(F.max_by("value", F.struct("__text", "__pos")).alias("value"))


def substituted(rows: DataFrame, ids: list[str], by: list[str], text: str, known: DataFrame) -> DataFrame:
    """(ids, by, text): rows with a use, each known use replaced by its value, once. ids tell rows apart."""
    pieces = rows.where(F.col(text).rlike(r"`[A-Za-z_]")).select(*dict.fromkeys([*ids, *by]), F.posexplode(F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0))).alias("__pos", "__piece"))
    named = pieces.withColumn("__name", F.when(F.col("__piece").rlike("^`[A-Za-z_]"), F.substring("__piece", F.lit(2), F.length("__piece"))))
    values = known.select(*by, F.col("name").alias("__name"), F.col("value").alias("__value")).where(~F.col("__name").isin(*sorted(DIRECTIVES)))
    joined = named.join(values, [*by, "__name"], "left").withColumn("__new", F.coalesce("__value", "__piece"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("__pos", "__new"))), lambda x: x["__new"])
    return joined.groupBy(*dict.fromkeys([*ids, *by])).agg(F.array_join(parts, "").alias(text))


def closed(known: DataFrame, by: list[str]) -> DataFrame:
    """The definitions with the macros in their values replaced."""
    first = checkpoint(known)
    done, open_ = None, first
    for _ in range(PASSES - 1):
        new = substituted(open_, [*by, "name"], by, "value", first)
        both = open_.join(new.withColumnRenamed("value", "__new"), [*by, "name"], "left")
        still = (F.col("__new") != F.col("value")) & F.col("__new").isNotNull()
        stepped = checkpoint(both.select(*by, "name", F.coalesce("__new", "value").alias("value"), F.coalesce(still, F.lit(False)).alias("__still")))
        settled = stepped.where("not __still").drop("__still")
        done = settled if done is None else done.unionByName(settled)
        open_ = stepped.where("__still").drop("__still")
        if open_.isEmpty():
            return done
    return open_ if done is None else done.unionByName(open_)


def expanded(texts: DataFrame, key: str, by: list[str], code: str, known: DataFrame) -> DataFrame:
    """texts with the macros of their group replaced in `code`. key tells texts apart and isn't null."""
    own = list(dict.fromkeys([key, *by, code]))
    new = substituted(texts.select(*own), [key], by, code, closed(known, by)).select(F.col(key), F.col(code).alias("__code"))
    return texts.join(new, key, "left").withColumn(code, F.coalesce("__code", code)).drop("__code")


def plain_labels(text: Column) -> Column:
    """A stray tick in front of a label goes."""
    return F.regexp_replace(text, rf"`(?!(?:{'|'.join(sorted(DIRECTIVES))})\b)([A-Za-z_]\w*\s*:)", "$1")


def left_over(text: Column) -> Column:
    """Macros that are still used outside comments and strings, as first seen."""
    used = F.regexp_extract_all(source.mask(text), F.lit(r"`([A-Za-z_]\w*)"), F.lit(1))
    return F.filter(F.array_distinct(used), lambda x: ~x.isin(*sorted(DIRECTIVES)))

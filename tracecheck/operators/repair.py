"""The repair loop: sampling, scoring and mending of many blocks at once, in rounds over those that are still open.

A round is a handful of jobs over all open blocks: messages are made as columns, answers and scores come from injected
functions (from frames to frames, so whatever they call runs on the executors), and what the round finds is written
before the next one starts. A lost executor repeats part of a round, never an earlier one. There are as many rounds as a
block has turns, whatever the number of blocks; a block leaves once its best answer passes as a whole.

Defined results: a block without an answer in a round gets an attempt with status ERROR and an empty text. Answers with
equal ranks go by their number. A null or empty first message is an empty one. An empty table of jobs gives none.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tracecheck.sources.shared import checkpoint

from . import attempts, curate, source
from .verdicts import meets_kill

#: generate(frame of job, turn, messages) -> frame of job, sample, answer (null: none).
Generate = Callable[[DataFrame], DataFrame]
#: score(frame of job, turn, sample, sva) -> those columns and SCORE's.
Score = Callable[[DataFrame], DataFrame]
#: status: PASS, FAIL, ERROR, TIMEOUT or UNKNOWN; failed, skipped, vacuous: labels; step: of the first failure; asserts: how many
#: are proven by a pass; attempted, valid, killed: of the mutants.
SCORE = "status string, failed array<string>, skipped array<string>, vacuous array<string>, step int, asserts long, attempted long, valid long, killed long"
ATTEMPT = ["job", "ord", "turn", "sample", "sva", *[x.split()[0] for x in SCORE.split(", ")], "proven", "from_survivors", "repeated"]
_NO_LABELS = "array<string>"


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def listed(labels: Column) -> Column:
    return F.array_join(labels, ", ")


def repair_message(kept: Column, bar: float) -> Column:
    """What the model is asked for next, by what became of its last answer. The frame has an attempt's columns."""
    status, failed, skipped, vacuous = (F.col(c) for c in ("status", "failed", "skipped", "vacuous"))
    keep = F.when(kept == "", "").otherwise(F.concat(F.lit("These properties stay; don't repeat them:\n"), kept, F.lit("\n")))
    again = F.when(F.col("repeated"), F.lit("The same labels failed before: think of another property, not of another wording.\n")).otherwise("")
    unchecked = F.when(F.size(skipped) > 0, F.concat(F.lit("Not checked, since the language doesn't have it: "), listed(skipped), F.lit("\n"))).otherwise("")
    passed = (
        F.when(F.size(vacuous) > 0, F.concat(F.lit("These never apply in any run: "), listed(vacuous), F.lit(". Write properties whose conditions occur.\n")))
        .when(~F.col("proven"), F.lit("The block proves nothing. Add assertions beside the covers.\n"))
        .when((F.col("valid") == 0) & F.lit(bar > 0), F.concat(F.lit("None of "), F.col("attempted").cast("string"), F.lit(" faulty designs could be run against the block. Write properties of other signals.\n")))
        .when(~met(bar), F.concat(F.lit("The block finds "), F.col("killed").cast("string"), F.lit(" of "), F.col("valid").cast("string"), F.lit(" faulty designs. Add properties that find more.\n")))
        .otherwise(F.lit("Write the properties that weren't checked in another way, or leave them out.\n"))
    )
    broken = F.when(F.size(failed) > 0, F.concat(F.lit("These failed and are gone: "), listed(failed), F.lit(". Write better ones in their place.\n"))).otherwise(
        F.concat(F.lit("The block ended with "), status, F.lit(" and no verdict on its properties. Write it anew.\n"))
    )
    return F.concat(unchecked, F.when(status == "PASS", passed).otherwise(F.concat(again, broken)), keep)


def met(bar: float) -> Column:
    return meets_kill(F.lit(bar), *[F.col(c) for c in ("proven", "attempted", "valid", "killed")])


def without_known(kept: Column, fresh: Column) -> Column:
    """A block without what another one declares already: its labels, its properties, and statements over these."""
    names = lambda items, prop: F.transform(F.filter(items, lambda x: (x["kind"] == "property") == F.lit(prop)), lambda x: F.lower(F.coalesce(x["name"], F.lit(""))))
    known = F.struct(names(source.items(kept), True).alias("props"), names(source.items(kept), False).alias("labels"), names(source.items(fresh), True).alias("own"))

    def stays(x: Column, k: Column) -> Column:
        name, ref = F.lower(F.coalesce(x["name"], F.lit(""))), F.lower(F.coalesce(x["ref"], F.lit("")))
        again = F.array_contains(F.array_intersect(k["props"], k["own"]), ref)
        return ~F.when(x["kind"] == "property", F.array_contains(k["props"], name)).otherwise((F.array_contains(k["labels"], name) & (name != "")) | again)

    return F.transform(F.array(known), lambda k: source.rest(fresh, lambda x: stays(x, k)))[0]


def run_suite(jobs: DataFrame, generate: Generate, score: Score, turns: int = 4, min_kill: float = 0.0, on_round: Callable[[int, dict], None] | None = None) -> DataFrame:
    """All attempts (ATTEMPT's columns) of jobs (job, system, user). on_round gets each turn's counts of attempts, passes and
    failures, which are observed while the round is written."""
    first = F.array(_message("system", F.coalesce("system", F.lit(""))), _message("user", F.coalesce("user", F.lit(""))))
    open_ = checkpoint(jobs.select("job", first.alias("messages"), F.lit("").alias("kept"), F.lit(None).cast(_NO_LABELS).alias("before")))
    found: list[DataFrame] = []
    for turn in range(1, turns + 1):
        asked = open_.select("job", F.lit(turn).alias("turn"), curate.trim_history(F.col("messages"), 1).alias("messages"))
        answers = generate(asked).where("answer is not null").select("job", "sample", "answer").join(open_.select("job", "kept"), "job")
        sva = F.when(source.unwrap(F.col("kept")) == "", F.col("answer")).otherwise(source.merge(F.col("kept"), without_known(F.col("kept"), F.col("answer"))))
        scored = checkpoint(score(answers.select("job", F.lit(turn).alias("turn"), "sample", sva.alias("sva"))).withColumn("ord", F.col("sample")))
        rank = attempts.candidate_rank(F.col("status"), F.size("skipped"), F.size("failed"), F.col("step"))
        best = attempts.best_of_n(scored, ["job"], rank, (F.col("status") == "PASS") & (F.size("skipped") == 0)).drop("turn", "ord")
        empty = {c: F.coalesce(c, F.array().cast(_NO_LABELS)) for c in ("failed", "skipped", "vacuous")} | {c: F.coalesce(c, F.lit(0)) for c in ("asserts", "attempted", "valid", "killed")}
        graded = open_.join(best, "job", "left").withColumns(empty | {"status": F.coalesce("status", F.lit("ERROR")), "sva": F.coalesce("sva", F.lit("")), "turn": F.lit(turn), "from_survivors": F.lit(False)})
        graded = graded.withColumn("proven", attempts.proven(F.col("status"), F.size("vacuous"), F.col("asserts") > 0))
        graded = graded.withColumn("repeated", F.coalesce((F.size("failed") > 0) & (F.array_sort("failed") == F.array_sort("before")), F.lit(False))).withColumn("ord", F.lit(2 * turn))
        seen = Observation(f"turn {turn}")
        counts = (F.count("*").alias("attempts"), F.count_if(F.col("status") == "PASS").alias("passed"), F.count_if(F.col("status") == "FAIL").alias("failed"), F.count_if("proven").alias("proven"))
        graded = checkpoint(graded.observe(seen, *counts))
        if on_round is not None:
            on_round(turn, seen.get)
        found.append(graded.select(*ATTEMPT))
        # A block that is stuck, or out of turns, is also graded without what failed.
        stuck = graded.where((F.col("status") != "PASS") & (F.size("failed") > 0) & (F.col("repeated") | F.lit(turn == turns)))
        rest = stuck.select("job", "turn", F.lit(-1).alias("sample"), source.without_labels(F.col("sva"), F.transform("failed", F.lower)).alias("sva"))
        rest = score(rest.where(source.has_kind(F.col("sva"), "assert", "assume"))).where("status = 'PASS'")
        rest = rest.withColumn("proven", attempts.proven(F.col("status"), F.size("vacuous"), F.col("asserts") > 0))
        found.append(checkpoint(rest.withColumns({"from_survivors": F.lit(True), "repeated": F.lit(False), "ord": F.lit(2 * turn + 1)}).select(*ATTEMPT)))
        done = (F.col("status") == "PASS") & F.col("proven") & (F.size("skipped") == 0) & met(min_kill)
        left = graded.where(~done)
        if turn == turns or left.isEmpty():
            break
        gone = F.transform(F.concat(F.when(F.col("status") == "PASS", F.col("vacuous")).otherwise(F.col("failed")), "skipped"), F.lower)
        cleaned = source.strip_truncated(source.without_labels(F.col("sva"), gone))
        kept = F.when((F.col("status") == "PASS") | (F.size("failed") > 0), F.when(F.size(gone) > 0, cleaned).otherwise(F.col("sva"))).otherwise("")
        left = left.withColumn("kept", kept)
        more = F.array(_message("assistant", F.col("sva")), _message("user", repair_message(F.col("kept"), min_kill)))
        open_ = checkpoint(left.select("job", F.concat("messages", more).alias("messages"), "kept", F.col("failed").alias("before")))
    return reduce(DataFrame.unionByName, found)

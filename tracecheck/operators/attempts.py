"""Attempts and trajectories: the winner, rates, repair rows and training rows.

Attempts are rows (trajectory, ord, turn, status, proven, ...); `ord` is their order, which ties go by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .verdicts import kill_rate


def proven(status: Column, n_vacuous: Column, proves_something: Column) -> Column:
    return F.coalesce(status == "PASS", F.lit(False)) & (n_vacuous == 0) & proves_something


def winner_key(status: Column, proven_: Column, killed: Column, n_skipped: Column, n_valid: Column, n_vacuous: Column, n_failed: Column, turn: Column) -> Column:
    """Lower is better: proofs by kills, then passes that prove nothing, then failures with few labels, then the rest."""
    key = lambda *x: F.struct(*[(F.lit(v) if isinstance(v, int) else v).cast("long").alias(f"k{i}") for i, v in enumerate(x)])
    return (
        F.when(proven_, key(0, -killed, n_skipped, -n_valid, turn))
        .when(status == "PASS", key(1, n_vacuous, n_skipped, 0, turn))
        .when(status == "FAIL", key(2, n_failed, turn, 0, turn))
        .otherwise(key(3, 99, 0, 0, turn))
    )


def candidate_rank(status: Column, n_skipped: Column, n_failed: Column, step: Column) -> Column:
    """The order of samples within a turn. Other than in winner_key, undecided runs come before failures."""
    key = lambda *x: F.struct(*[(F.lit(v) if isinstance(v, int) else v).cast("long").alias(f"k{i}") for i, v in enumerate(x)])
    return F.when(status == "PASS", key(0, n_skipped, 0)).when(status == "ERROR", key(3, 99, 0)).otherwise(key(1, n_failed, F.coalesce(step, F.lit(99))))


def winners(attempts: DataFrame, by: list[str], key: Column) -> DataFrame:
    """The best attempt of each trajectory; the first of equals. Partial minima are merged, so nothing is sorted."""
    row = F.struct(*attempts.columns)
    best = attempts.groupBy(*by).agg(F.min_by(row, F.struct(key.alias("k"), F.col("ord").alias("o"))).alias("__best"))
    return best.select("__best.*")


def best_of_n(samples: DataFrame, by: list[str], rank: Column, clean: Column) -> DataFrame:
    """The best sample of each turn among those up to the first clean pass; samples after it were never run."""
    w = Window.partitionBy(*by)
    first = F.min(F.when(clean, F.col("ord"))).over(w)
    run = samples.withColumn("__first", first).where(F.col("__first").isNull() | (F.col("ord") <= F.col("__first"))).drop("__first")
    return winners(run, by, rank)


def trajectories(attempts: DataFrame, by: list[str], key: Column) -> DataFrame:
    """Per trajectory: turns, first status, first pass, winner's turn, status, ok, healed, kill rate.

    attempts needs ord, turn, status, proven, from_survivors, killed, valid_mutants.
    """
    a = attempts.withColumn("__key", F.struct(key.alias("k"), F.col("ord").alias("o")))
    rate = kill_rate(F.col("killed"), F.col("valid_mutants"), None)
    per = a.groupBy(*by).agg(
        F.count("*").alias("n_attempts"),
        F.count_if(~F.col("from_survivors")).alias("turns"),
        F.min_by("status", "ord").alias("first_status"),
        F.min_by(F.col("proven") & ~F.col("from_survivors"), F.col("ord")).alias("first_pass"),
        F.min_by("turn", "__key").alias("winner_turn"),
        F.min_by("status", "__key").alias("__status"),
        F.min_by("proven", "__key").alias("ok"),
        F.max_by(rate, F.when(F.col("valid_mutants") > 0, F.col("ord"))).alias("kill_rate"),
    )
    status = F.when((F.col("__status") == "PASS") & ~F.col("ok"), "VACUOUS").otherwise(F.col("__status"))
    return per.withColumn("status", status).withColumn("healed", F.col("ok") & ~F.col("first_pass")).drop("__status")


def suite(trajectories_: DataFrame) -> DataFrame:
    """Rates over all trajectories; 0.0 where there is nothing to take a share of."""
    share = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    failed_first = (F.col("n_attempts") > 0) & ~F.col("first_pass")
    return trajectories_.agg(
        F.count("*").alias("blocks"),
        share(F.col("first_status") != "ERROR").alias("syntactic_rate"),
        share(F.col("first_pass")).alias("first_pass_rate"),
        share(F.col("ok")).alias("cegar_rate"),
        F.coalesce(F.avg(F.when(failed_first, F.col("healed").cast("double"))), F.lit(0.0)).alias("heal_rate"),
    )


def heal_rows(attempts: DataFrame, trajectories_: DataFrame, by: list[str], fixed: DataFrame) -> DataFrame:
    """Of healed trajectories, each attempt that didn't pass, but for the last one, beside the winner's text.

    fixed: by..., fixed_attempt.
    """
    last = F.max("ord").over(Window.partitionBy(*by))
    faulty = attempts.withColumn("__last", last).where((F.col("ord") < F.col("__last")) & (F.col("status") != "PASS")).drop("__last")
    healed = trajectories_.where("healed").select(*by, "turns")
    return faulty.join(healed, by).join(fixed, by).select(*by, "ord", F.lit("heal").alias("type"), F.col("sva").alias("faulty_attempt"), "fixed_attempt", F.col("status").alias("fault_status"), "turns")


def sft_rows(winners_: DataFrame, first_pass: Column) -> DataFrame:
    """Training rows of winners that are proofs; kill_rate is null where no mutant was valid."""
    rate = kill_rate(F.col("killed"), F.col("valid_mutants"), None)
    return winners_.where("proven").select(F.lit("sft").alias("type"), *[c for c in winners_.columns if c not in ("type", "kill_rate", "first_pass")], rate.alias("kill_rate"), first_pass.alias("first_pass"))


def repeated_failure(attempts: DataFrame, by: list[str]) -> DataFrame:
    """Adds `repeated`: the failed labels equal those of the sampled turn before, whatever their order."""
    w = Window.partitionBy(*by).orderBy("ord")
    mine = F.array_sort(F.col("failed"))
    sampled = attempts.where(~F.col("from_survivors")).withColumn("__mine", mine)
    return sampled.withColumn("repeated", F.coalesce((F.lag("__mine").over(w) == F.col("__mine")) & (F.size("__mine") > 0), F.lit(False))).drop("__mine")

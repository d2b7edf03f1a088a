"""Verdicts and kill reports over orders and their lines: an order is a block, a line a mutant (R FAIL, N PASS, A ERROR)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracecheck.operators import catalog, verdicts

MIN_KILL = 0.5


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    status = F.when(F.col("l_returnflag") == "R", "FAIL").when(F.col("l_returnflag") == "N", "PASS").otherwise("ERROR")
    operator = F.concat(F.lit("op"), (F.col("l_partkey") % 5).cast("string"))
    return lines.select(F.col("l_orderkey").alias("block"), F.concat(F.lit("m"), F.col("l_linenumber").cast("string")).alias("mutant"), operator.alias("operator"), status.alias("status"), F.col("l_linenumber").alias("ord"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prove by order status; cover by priority, null where it wasn't run."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    prove = F.when(F.col("o_orderstatus") == "F", "PASS").when(F.col("o_orderstatus") == "O", "FAIL").otherwise("UNKNOWN")
    p = F.substring("o_orderpriority", 1, 1)
    cover = F.when(p == "1", F.lit(None).cast("string")).when(p == "2", "TIMEOUT").otherwise("PASS")
    return o.select(F.col("o_orderkey").alias("block"), prove.alias("prove"), cover.alias("cover"), F.when(p == "3", 1).otherwise(0).alias("n_vacuous"))


def kill_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.kill_report(outcomes(spark, sf_dir), ["block"], "mutant").withColumn("survivors", F.array_join("survivors", ","))


def kill_by_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.kill_report(outcomes(spark, sf_dir), ["operator"], "mutant").drop("survivors")


def kill_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes(spark, sf_dir).where("status = 'PASS'").select("block", "mutant", "operator")


def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a block; mutants count only where they would have been run."""
    b = blocks(spark, sf_dir).withColumn("run", verdicts.scored(F.col("prove"), F.col("cover")))
    ran = outcomes(spark, sf_dir).join(b.where("run").select("block"), "block", "left_semi")
    kills = verdicts.kill_report(ran, ["block"], "mutant").drop("survivors")
    joined = catalog.with_defaults(b, kills, ["block"], {"mutants": 0, "valid_mutants": 0, "killed": 0, "kill_rate": 0.0})
    vac = verdicts.vacuity_ok(F.col("cover"), F.col("n_vacuous"))
    return joined.withColumn("vacuity_ok", vac).withColumn("passed", verdicts.gate_passed(F.col("prove"), F.col("vacuity_ok")))


def gate_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    fails = verdicts.gate_fails(F.col("passed"), F.col("kill_rate"), MIN_KILL)
    return gates(spark, sf_dir).withColumn("fails", fails).select("block", "prove", "cover", "vacuity_ok", "passed", "mutants", "valid_mutants", "killed", "kill_rate", "fails")


def gate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = gate_verdict(spark, sf_dir)
    return g.groupBy("prove", "cover").agg(F.count("*").alias("blocks"), F.count_if("passed").alias("passed"), F.count_if("fails").alias("failed"), F.sum("killed").alias("killed"))


def gate_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates(spark, sf_dir).select("block", verdicts.report_json(["block", "passed", "prove", "cover", "vacuity_ok", "mutants", "valid_mutants", "killed", "kill_rate"]).alias("report"))


def gate_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates(spark, sf_dir).select("block", verdicts.markdown_row([F.col(c) for c in ("block", "prove", "cover", "killed", "valid_mutants")]).alias("line"))


def meets_kill(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = verdicts.kill_report(outcomes(spark, sf_dir), ["block"], "mutant").join(blocks(spark, sf_dir), "block")
    bar = (F.col("block") % 4) / 4.0
    attempted = F.when(F.col("block") % 7 == 0, 0).otherwise(F.col("mutants"))
    ok = verdicts.meets_kill(bar, F.col("prove") == "PASS", attempted, F.col("valid_mutants"), F.col("killed"))
    return k.select("block", ok.alias("meets"))


def reward_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = outcomes(spark, sf_dir)
    return o.groupBy("operator").agg(F.sum(verdicts.reward(F.col("status"))).alias("reward"), F.count("*").alias("n"))


def status_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exit codes from line numbers and suppliers, with timeouts and undeclared signals."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    code = F.expr("shiftleft(1, cast(l_linenumber % 6 as int))") - F.when(F.col("l_linenumber") % 6 == 0, 1).otherwise(0)
    s = verdicts.status(code, F.col("l_suppkey") % 11 == 0, F.col("l_suppkey") % 13 == 0)
    return lines.select(s.alias("status")).groupBy("status").agg(F.count("*").alias("n"))


def mutant_one_per_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = catalog.one_per_operator_first(outcomes(spark, sf_dir), ["block"], "operator", F.struct("ord", "operator"))
    return o.where("pos < 4").select("block", "mutant", "operator", F.col("pos"), F.concat_ws("_", "operator", F.col("pos").cast("string")).alias("name"))


def vacuous_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unreached covers __cov mapped to their asserts by base label."""
    o = outcomes(spark, sf_dir)
    label = F.concat(F.lit("top.a_"), F.col("mutant"), F.when(F.col("ord") % 2 == 0, "__k1__cov").when(F.col("ord") % 3 == 0, "__c12").otherwise("__cov"))
    hit = o.where("status = 'ERROR'").select("block", verdicts.base_label(label).alias("label"))
    return hit.distinct()


def solver_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs made of order lines, parsed again."""
    o = outcomes(spark, sf_dir)
    line = (
        F.when(F.col("status") == "FAIL", F.concat(F.lit("summary: failed assertion top."), "mutant", F.lit("__c1 at x.sv:1.2-3.4 step "), (F.col("ord") + 2).cast("string")))
        .when(F.col("status") == "PASS", F.concat(F.lit("Reached cover statement in step 1 at top: c_"), "mutant"))
        .otherwise(F.concat(F.lit("Unreached cover statement at top: c_"), "mutant"))
    )
    logs = o.groupBy("block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    p = verdicts.parse_log(F.col("text"))
    return logs.select("block", F.array_join(F.array_sort(p["failed"]), ",").alias("failed"), p["failing_step"].alias("failing_step"), F.array_join(F.array_sort(p["reached"]), ",").alias("reached"), F.array_join(F.array_sort(p["unreached"]), ",").alias("unreached"), F.size(p["errors"]).alias("n_errors"))


QUERIES = {
    f.__name__: f
    for f in (kill_report, kill_by_operator, kill_survivors, gate_verdict, gate_summary, gate_json, gate_markdown, meets_kill, reward_sum, status_map, mutant_one_per_operator, vacuous_labels, solver_logs)
}

_O = """WITH o AS (SELECT l_orderkey AS block, 'm' || l_linenumber AS mutant, 'op' || (l_partkey % 5) AS operator, l_linenumber AS ord,
  CASE l_returnflag WHEN 'R' THEN 'FAIL' WHEN 'N' THEN 'PASS' ELSE 'ERROR' END AS status FROM lineitem)"""
_B = """, b AS (SELECT o_orderkey AS block, CASE o_orderstatus WHEN 'F' THEN 'PASS' WHEN 'O' THEN 'FAIL' ELSE 'UNKNOWN' END AS prove,
  CASE left(o_orderpriority, 1) WHEN '1' THEN NULL WHEN '2' THEN 'TIMEOUT' ELSE 'PASS' END AS cover, left(o_orderpriority, 1) = '3' AS vacuous FROM orders)"""
_K = """SELECT {by}, count(*) AS mutants, count(*) FILTER (status IN ('PASS', 'FAIL')) AS valid_mutants, count(*) FILTER (status = 'FAIL') AS killed,
  CASE WHEN count(*) FILTER (status <> 'ERROR') = 0 THEN 0.0 ELSE count(*) FILTER (status = 'FAIL')::DOUBLE / count(*) FILTER (status <> 'ERROR') END AS kill_rate"""
_G = f"""{_O}{_B}, k AS ({_K.format(by="block")} FROM o GROUP BY block), g AS (
  SELECT block, prove, cover, CASE WHEN cover IS NULL THEN NULL ELSE cover = 'PASS' AND NOT vacuous END AS vacuity_ok, prove = 'PASS' AND (cover IS NULL OR (cover = 'PASS' AND NOT vacuous)) AS passed,
    CASE WHEN run THEN coalesce(mutants, 0) ELSE 0 END AS mutants, CASE WHEN run THEN coalesce(valid_mutants, 0) ELSE 0 END AS valid_mutants,
    CASE WHEN run THEN coalesce(killed, 0) ELSE 0 END AS killed, CASE WHEN run THEN coalesce(kill_rate, 0.0) ELSE 0.0 END AS kill_rate
  FROM (SELECT *, prove = 'PASS' AND (cover IS NULL OR cover = 'PASS') AS run FROM b) LEFT JOIN k USING (block))"""

ORACLES = {
    "kill_report": f"{_O} {_K.format(by='block')}, coalesce(string_agg(mutant, ',' ORDER BY mutant) FILTER (status = 'PASS'), '') AS survivors FROM o GROUP BY block",
    "kill_by_operator": f"{_O} {_K.format(by='operator')} FROM o GROUP BY operator",
    "kill_survivors": f"{_O} SELECT block, mutant, operator FROM o WHERE status = 'PASS'",
    "gate_verdict": f"{_G} SELECT *, NOT passed OR kill_rate < {MIN_KILL} AS fails FROM g",
    "gate_summary": f"{_G} SELECT prove, cover, count(*) AS blocks, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed OR kill_rate < {MIN_KILL}) AS failed, sum(killed)::BIGINT AS killed FROM g GROUP BY ALL",
    "gate_json": f"""{_G} SELECT block, '{{"block":' || block || ',"passed":' || passed || ',"prove":"' || prove || '","cover":' || coalesce('"' || cover || '"', 'null') || ',"vacuity_ok":' || coalesce(vacuity_ok::VARCHAR, 'null')
      || ',"mutants":' || mutants || ',"valid_mutants":' || valid_mutants || ',"killed":' || killed || ',"kill_rate":' || kill_rate::VARCHAR || '}}' AS report FROM g""",
    "gate_markdown": f"{_G} SELECT block, '| ' || block || ' | ' || prove || ' | ' || coalesce(cover, '-') || ' | ' || killed || ' | ' || valid_mutants || ' |' AS line FROM g",
    "meets_kill": f"""{_O}{_B}, k AS ({_K.format(by="block")} FROM o GROUP BY block) SELECT block, CASE WHEN block % 4 = 0 THEN true WHEN prove <> 'PASS' THEN false WHEN block % 7 = 0 THEN true
      WHEN valid_mutants = 0 THEN false ELSE kill_rate + 1e-12 >= (block % 4) / 4.0 END AS meets FROM k JOIN b USING (block)""",
    "reward_sum": f"{_O} SELECT operator, sum(CASE status WHEN 'PASS' THEN 1.0 WHEN 'ERROR' THEN -1.0 ELSE 0.0 END)::DOUBLE AS reward, count(*) AS n FROM o GROUP BY operator",
    "status_map": """WITH r AS (SELECT CASE l_linenumber % 6 WHEN 0 THEN 'PASS' WHEN 1 THEN 'FAIL' WHEN 2 THEN 'UNKNOWN' WHEN 3 THEN 'TIMEOUT' WHEN 4 THEN 'ERROR' ELSE 'ERROR' END AS by_code, l_suppkey AS s FROM lineitem),
      t AS (SELECT CASE WHEN s % 11 = 0 THEN 'TIMEOUT' ELSE by_code END AS st, s FROM r)
      SELECT CASE WHEN s % 13 = 0 AND st IN ('PASS', 'FAIL', 'UNKNOWN') THEN 'ERROR' ELSE st END AS status, count(*) AS n FROM t GROUP BY 1""",
    "mutant_one_per_operator": f"""{_O}, r AS (SELECT *, row_number() OVER (PARTITION BY block, operator ORDER BY ord, operator) > 1 AS later FROM o),
      p AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY later, ord, operator) - 1 AS pos FROM r) SELECT block, mutant, operator, pos, operator || '_' || pos AS name FROM p WHERE pos < 4""",
    "vacuous_labels": f"{_O} SELECT DISTINCT block, 'a_' || mutant AS label FROM o WHERE status = 'ERROR'",
    "solver_logs": f"""{_O} SELECT block, coalesce(string_agg(DISTINCT mutant, ',' ORDER BY mutant) FILTER (status = 'FAIL'), '') AS failed, min(ord + 2) FILTER (status = 'FAIL') AS failing_step,
      coalesce(string_agg(DISTINCT 'c_' || mutant, ',' ORDER BY 'c_' || mutant) FILTER (status = 'PASS'), '') AS reached, coalesce(string_agg(DISTINCT 'c_' || mutant, ',' ORDER BY 'c_' || mutant) FILTER (status = 'ERROR'), '') AS unreached,
      0 AS n_errors FROM o GROUP BY block""",
}

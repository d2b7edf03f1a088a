"""Attempts over conversations: a conversation is a trajectory, a turn an attempt; verdicts come from the text's length."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracecheck.operators import attempts, curate, repair
from tracecheck.sources import logs

BY = ["traj_id"]


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    n = F.length("text")
    status = F.element_at(F.array(*[F.lit(s) for s in ("PASS", "FAIL", "ERROR", "TIMEOUT", "FAIL")]), (n % 5 + 1).cast("int"))
    a = c.select(
        F.col("conv_id").alias("traj_id"),
        F.col("turn").alias("ord"),
        F.col("turn"),
        F.col("text").alias("sva"),
        status.alias("status"),
        (n % 3).cast("long").alias("n_skipped"),
        F.when(n % 7 == 0, 1).otherwise(0).cast("long").alias("n_vacuous"),
        (n % 11 % 4).cast("long").alias("n_failed"),
        F.transform(F.sequence(F.lit(0), (n % 4).cast("int")), lambda i: F.concat(F.lit("a"), (3 - i).cast("string"))).alias("failed"),
        (n % 8).cast("long").alias("valid_mutants"),
        F.floor((n % 8) * (n % 3) / 2).cast("long").alias("killed"),
        (F.col("turn") % 4 == 3).alias("from_survivors"),
    )
    return a.withColumn("proven", attempts.proven(F.col("status"), F.col("n_vacuous"), F.col("n_failed") < 3))


def _key():
    return attempts.winner_key(*[F.col(c) for c in ("status", "proven", "killed", "n_skipped", "valid_mutants", "n_vacuous", "n_failed", "turn")])


def winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attempts.winners(rows(spark, sf_dir), BY, _key()).select("traj_id", F.col("ord").alias("winner"), "status", "proven", "killed")


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attempts.trajectories(rows(spark, sf_dir), BY, _key()).select("traj_id", "n_attempts", "turns", "first_status", "first_pass", "winner_turn", "ok", "kill_rate", "status", "healed")


def suite_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attempts.suite(attempts.trajectories(rows(spark, sf_dir), BY, _key()))


def suite_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line a trajectory, as the console shows it."""
    t = trajectories(spark, sf_dir)
    line = F.concat(F.rpad(F.col("traj_id").cast("string"), 20, " "), F.lit(" "), F.lpad(F.col("turns").cast("string"), 5, " "), F.lit("  "), F.rpad("first_status", 7, " "), F.lit("  "), "status")
    return t.select("traj_id", line.alias("line"))


def heal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = rows(spark, sf_dir)
    fixed = attempts.winners(a, BY, _key()).select("traj_id", F.col("sva").alias("fixed_attempt"))
    healed = attempts.heal_rows(a, attempts.trajectories(a, BY, _key()), BY, fixed)
    return healed.select("traj_id", "ord", "type", F.md5("faulty_attempt").alias("faulty"), F.md5("fixed_attempt").alias("fixed"), "fault_status", "turns")


def sft_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = rows(spark, sf_dir)
    first = attempts.trajectories(a, BY, _key()).select("traj_id", F.col("first_pass").alias("first"))
    w = attempts.winners(a, BY, _key()).join(first, BY)
    return attempts.sft_rows(w, F.col("first")).select("traj_id", "type", "turn", "killed", "valid_mutants", "kill_rate", "first_pass")


def repeated_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attempts.repeated_failure(rows(spark, sf_dir), BY).select("traj_id", "ord", "repeated")


def best_of_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = rows(spark, sf_dir)
    rank = attempts.candidate_rank(F.col("status"), F.col("n_skipped"), F.col("n_failed"), F.when(F.col("n_failed") > 1, F.col("turn")))
    best = attempts.best_of_n(a, BY, rank, (F.col("status") == "PASS") & (F.col("n_skipped") == 0))
    return best.select("traj_id", F.col("ord").alias("best"), "status")


def log_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All row types of a run's log in one frame, counted."""
    both = logs.all_kinds(heal_rows(spark, sf_dir), sft_rows(spark, sf_dir), trajectories(spark, sf_dir).withColumn("type", F.lit("trajectory")), suite_rates(spark, sf_dir).withColumn("type", F.lit("suite_summary")))
    return both.groupBy("type").agg(F.count("*").alias("n"), F.count("kill_rate").alias("scored"), F.count("turns").alias("with_turns"))


def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows appended to a log and read again by type."""
    from tracecheck.sources.shared import folder

    place = folder(spark)
    s = sft_rows(spark, sf_dir).withColumn("block", F.col("traj_id").cast("string")).drop("traj_id")
    logs.append_log(s, place)
    logs.append_log(s.limit(0), place)
    return logs.read_log(spark, [place]).select("block", "turn", "killed", "valid_mutants", "kill_rate", "first_pass")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.chat_messages(spark.read.parquet(f"{sf_dir}/conversations.parquet"), ["conv_id"], "turn")


def _flat(messages):
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n")


def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("conv_id", F.size("messages").alias("n"), F.md5(_flat("messages")).alias("digest"))


def history_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("conv_id", F.md5(_flat(curate.trim_history(F.col("messages"), 1))).alias("digest"))


def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = F.aggregate(F.transform("messages", lambda m: F.length(m["content"])), F.lit(0), lambda a, x: a + x)
    t = _turns(spark, sf_dir).select("conv_id", chars.alias("chars"))
    share = curate.fit_tokens(F.col("chars"), F.lit(100), 600)
    return t.select("conv_id", curate.estimate_tokens(F.col("chars")).alias("tokens"), F.round(share, 6).alias("share"))


def turn_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("conv_id").agg(F.count_if(F.col("role") == "assistant").alias("answers"), F.count("*").alias("turns"))


def _asked(frame: DataFrame) -> DataFrame:
    """Two answers to each request, as a model could give them: the second one can't be read. Some first requests get none."""
    n = F.col("turn").cast("string")
    text = F.concat(F.lit("property p_"), n, F.lit("; q > "), n, F.lit("; endproperty\na_1: assert property (p_"), n, F.lit(");\na_2: assert property (y);\nc_1: cover property (y);"))
    answer = F.when((F.col("job") % 4 == 3) & (F.col("turn") == 1), None).otherwise(text)
    return frame.select("job", F.explode(F.array(F.lit(0), F.lit(1))).alias("sample"), answer.alias("answer"))


def _scored(frame: DataFrame) -> DataFrame:
    """Verdicts by a conversation's number: good at once, mended, never good, without a property that applies."""
    kind, turn, whole = F.col("job") % 4, F.col("turn"), F.col("sample") >= 0
    fails = whole & ((kind == 2) | ((kind == 1) & (turn == 1)))
    labels = lambda c, *x: F.when(c, F.array(*[F.lit(v) for v in x])).otherwise(F.array().cast("array<string>"))
    status = F.when(F.col("sample") == 1, "ERROR").when(fails, "FAIL").otherwise("PASS")
    return frame.select(
        "job", "turn", "sample", "sva", status.alias("status"), labels(fails, "a_1").alias("failed"), labels(F.lit(False)).alias("skipped"), labels((kind == 3) & (turn == 2), "a_2").alias("vacuous"),
        F.when(fails, 3).alias("step"), F.lit(2).cast("long").alias("asserts"), F.lit(4).cast("long").alias("attempted"), F.lit(4).cast("long").alias("valid"), F.lit(2).cast("long").alias("killed"),
    )


def repair_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as blocks that are mended in four rounds at most."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    jobs = c.groupBy(F.col("conv_id").alias("job")).agg(F.lit("You write properties.").alias("system"), F.min_by("text", "turn").alias("user"))
    found = repair.run_suite(jobs, _asked, _scored, turns=4, min_kill=0.5)
    return found.select("job", "ord", "turn", "status", "proven", "from_survivors", "repeated", F.md5("sva").alias("digest"))


QUERIES = {
    f.__name__: f
    for f in (winner, trajectories, suite_rates, suite_report, heal_rows, sft_rows, repeated_failure, best_of_n, log_types, jsonl_round_trip, chat_messages, history_trim, token_estimate, turn_count, repair_loop)
}

_A = """WITH r AS (SELECT conv_id AS traj_id, turn AS ord, turn, text AS sva, length(text) AS n FROM conversations),
a AS (SELECT *, ['PASS', 'FAIL', 'ERROR', 'TIMEOUT', 'FAIL'][(n % 5 + 1)::INT] AS status, n % 3 AS n_skipped, (n % 7 = 0)::INT AS n_vacuous, n % 11 % 4 AS n_failed,
  n % 8 AS valid_mutants, floor((n % 8) * (n % 3) / 2)::BIGINT AS killed, turn % 4 = 3 AS from_survivors FROM r),
p AS (SELECT *, status = 'PASS' AND n_vacuous = 0 AND n_failed < 3 AS proven FROM a),
k AS (SELECT *, row_number() OVER (PARTITION BY traj_id ORDER BY
    CASE WHEN proven THEN 0 WHEN status = 'PASS' THEN 1 WHEN status = 'FAIL' THEN 2 ELSE 3 END,
    CASE WHEN proven THEN -killed WHEN status = 'PASS' THEN n_vacuous WHEN status = 'FAIL' THEN n_failed ELSE 99 END,
    CASE WHEN status = 'PASS' THEN n_skipped WHEN status = 'FAIL' THEN turn ELSE 0 END,
    CASE WHEN proven THEN -valid_mutants ELSE 0 END, turn, ord) AS place,
  row_number() OVER (PARTITION BY traj_id ORDER BY ord) AS nth, row_number() OVER (PARTITION BY traj_id ORDER BY ord DESC) AS from_end FROM p),
w AS (SELECT * FROM k WHERE place = 1),
s AS (SELECT traj_id, arg_max(CASE WHEN valid_mutants > 0 THEN killed::DOUBLE / valid_mutants END, ord) FILTER (valid_mutants > 0) AS kill_rate FROM k GROUP BY traj_id),
t AS (SELECT k.traj_id, count(*) AS n_attempts, count(*) FILTER (NOT from_survivors) AS turns, max(status) FILTER (nth = 1) AS first_status, bool_or(nth = 1 AND proven AND NOT from_survivors) AS first_pass FROM k GROUP BY k.traj_id),
tr AS (SELECT t.*, w.turn AS winner_turn, w.proven AS ok, s.kill_rate, CASE WHEN w.status = 'PASS' AND NOT w.proven THEN 'VACUOUS' ELSE w.status END AS status, w.proven AND NOT first_pass AS healed
  FROM t JOIN w USING (traj_id) JOIN s USING (traj_id)),
h AS (SELECT k.traj_id, k.ord, 'heal' AS type, md5(k.sva) AS faulty, md5(w.sva) AS fixed, k.status AS fault_status, tr.turns FROM k JOIN w USING (traj_id) JOIN tr USING (traj_id) WHERE tr.healed AND k.from_end > 1 AND k.status <> 'PASS'),
sft AS (SELECT traj_id, 'sft' AS type, w.turn, w.killed, w.valid_mutants, CASE WHEN w.valid_mutants > 0 THEN w.killed::DOUBLE / w.valid_mutants END AS kill_rate, first_pass FROM w JOIN t USING (traj_id) WHERE proven),
su AS (SELECT count(*) AS blocks, coalesce(avg((first_status <> 'ERROR')::INT), 0.0) AS syntactic_rate, coalesce(avg(first_pass::INT), 0.0) AS first_pass_rate, coalesce(avg(ok::INT), 0.0) AS cegar_rate,
  coalesce(avg(healed::INT) FILTER (NOT first_pass), 0.0) AS heal_rate FROM tr)"""
_M = "WITH m AS (SELECT conv_id, turn, role || ':' || text AS t, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations)"

ORACLES = {
    "winner": f"{_A} SELECT traj_id, ord AS winner, status, proven, killed FROM w",
    "trajectories": f"{_A} SELECT * FROM tr",
    "suite_rates": f"{_A} SELECT * FROM su",
    "suite_report": f"{_A} SELECT traj_id, rpad(traj_id::VARCHAR, 20, ' ') || ' ' || lpad(turns::VARCHAR, 5, ' ') || '  ' || rpad(first_status, 7, ' ') || '  ' || status AS line FROM tr",
    "heal_rows": f"{_A} SELECT * FROM h",
    "sft_rows": f"{_A} SELECT * FROM sft",
    "repeated_failure": f"""{_A}, f AS (SELECT *, n % 4 AS size, lag(n % 4) OVER (PARTITION BY traj_id ORDER BY ord) AS before FROM p WHERE NOT from_survivors)
      SELECT traj_id, ord, coalesce(before = size, false) AS repeated FROM f""",
    "best_of_n": f"""{_A}, c AS (SELECT *, min(ord) FILTER (status = 'PASS' AND n_skipped = 0) OVER (PARTITION BY traj_id) AS clean FROM p),
      q AS (SELECT *, row_number() OVER (PARTITION BY traj_id ORDER BY CASE status WHEN 'PASS' THEN 0 WHEN 'ERROR' THEN 3 ELSE 1 END,
        CASE status WHEN 'PASS' THEN n_skipped WHEN 'ERROR' THEN 99 ELSE n_failed END, CASE WHEN status IN ('PASS', 'ERROR') THEN 0 WHEN n_failed > 1 THEN turn ELSE 99 END, ord) AS place
        FROM c WHERE clean IS NULL OR ord <= clean) SELECT traj_id, ord AS best, status FROM q WHERE place = 1""",
    "log_types": f"""{_A} SELECT 'heal' AS type, count(*) AS n, 0 AS scored, count(turns) AS with_turns FROM h UNION ALL SELECT 'sft', count(*), count(kill_rate), 0 FROM sft
      UNION ALL SELECT 'trajectory', count(*), count(kill_rate), count(turns) FROM tr UNION ALL SELECT 'suite_summary', 1, 0, 0""",
    "jsonl_round_trip": f"{_A} SELECT traj_id::VARCHAR AS block, turn, killed, valid_mutants, kill_rate, first_pass FROM sft",
    "chat_messages": f"{_M} SELECT conv_id, count(*) AS n, md5(string_agg(t, chr(10) ORDER BY i)) AS digest FROM m GROUP BY conv_id",
    "history_trim": f"{_M} SELECT conv_id, md5(string_agg(t, chr(10) ORDER BY i)) AS digest FROM m WHERE i <= 2 OR i > total - 2 GROUP BY conv_id",
    "token_estimate": f"""{_M}, c AS (SELECT conv_id, sum(n)::BIGINT AS chars FROM m GROUP BY conv_id), o AS (SELECT unnest(range(0, 6)) AS e),
      f AS (SELECT conv_id, min(e) AS e FROM c, o WHERE floor((floor(chars * pow(0.7, e)) + 100) / 2.5) <= 600 GROUP BY conv_id)
      SELECT c.conv_id, floor(chars / 2.5)::BIGINT AS tokens, round(pow(0.7, coalesce(e, 5)), 6) AS share FROM c LEFT JOIN f USING (conv_id)""",
    "turn_count": "SELECT conv_id, count(*) FILTER (role = 'assistant') AS answers, count(*) AS turns FROM conversations GROUP BY conv_id",
    "repair_loop": """WITH j AS (SELECT DISTINCT conv_id AS job FROM conversations), t AS (SELECT unnest([1, 2, 3, 4]) AS turn),
      x AS (SELECT job, turn, job % 4 AS kind, 'property p_' || turn || '; q > ' || turn || '; endproperty' AS p, 'a_1: assert property (p_' || turn || ');' AS a1, 'a_2: assert property (y);' AS a2,
        'c_1: cover property (y);' AS c1, chr(10) AS nl, '`ifdef FORMAL' || chr(10) AS o, chr(10) || '`endif' || chr(10) AS e FROM j, t WHERE turn <= CASE job % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 3 THEN 3 ELSE 4 END),
      r AS (SELECT job, turn, CASE WHEN kind = 2 OR kind = 1 AND turn = 1 THEN 'FAIL' WHEN kind = 3 AND turn = 1 THEN 'ERROR' ELSE 'PASS' END AS status,
        kind IN (0, 1) AND NOT (kind = 1 AND turn = 1) OR kind = 3 AND turn = 3 AS proven, kind = 2 AND turn > 1 AS repeated, kind, o || a2 || nl || c1 || e AS rest,
        CASE WHEN kind = 3 AND turn = 1 THEN '' WHEN turn = 1 OR kind = 3 AND turn = 2 THEN p || nl || a1 || nl || a2 || nl || c1
          WHEN kind = 3 THEN o || replace(p, turn::VARCHAR, '2') || nl || replace(a1, 'p_3', 'p_2') || nl || c1 || nl || nl || p || nl || a2 || e
          ELSE o || a2 || nl || c1 || nl || nl || p || nl || a1 || e END AS sva FROM x)
      SELECT job, 2 * turn AS ord, turn, status, proven, false AS from_survivors, repeated, md5(sva) AS digest FROM r
      UNION ALL SELECT job, 2 * turn + 1, turn, 'PASS', true, true, false, md5(rest) FROM r WHERE kind = 2 AND turn > 1""",
}

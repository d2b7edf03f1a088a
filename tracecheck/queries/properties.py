"""Property checks over events: a user's events are a trace, in order of (ts, event_id)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracecheck.operators import trace
from tracecheck.plans import monitor
from tracecheck.plans.properties import Plan, parse_block
from tracecheck.streaming import monitor as streaming

BY, ORDER = ["user_id"], ["ts", "event_id"]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.col("event_type")
    return e.select("user_id", "ts", "event_id", "event_type", F.col("value").alias("val"), F.floor("value").cast("long").alias("num"), *[(kind == k).alias(s) for k, s in (("view", "vw"), ("click", "clk"), ("purchase", "buy"), ("signup", "sgn"), ("error", "err"))])


#: The blocks, by query.
BLOCKS = {
    "prop_overlap": "a_o: assert property (vw |-> val > 10);",
    "prop_nonoverlap": "a_n: assert property (vw |=> buy);",
    "prop_fixed_delay": "a_d: assert property (vw |-> ##2 clk);",
    "prop_range": "a_r: assert property (vw |-> ##[1:3] buy);",
    "prop_sequence_ante": "a_s: assert property (vw ##1 clk |=> buy);",
    "prop_multi_consequent": "a_m: assert property (vw |=> clk ##1 buy);",
    "prop_conjunction": "a_c: assert property ((vw |-> val > 5) and (clk |=> buy));",
    "prop_disable_iff": "property p; disable iff (err) vw |=> ##1 buy; endproperty a_x: assert property (p);",
    "prop_rose_fell": "a_f: assert property ($rose(vw) |=> !$fell(clk));",
    "prop_stable_changed": "a_t: assert property ($changed(vw) |-> $stable(clk));",
    "prop_past_arith": "a_p: assert property (vw |=> val > $past(val) - 20);",
    "prop_cover": "c_s: cover property (vw ##1 clk ##1 buy);",
    "prop_vacuity": "a_v: assert property (vw && clk |-> buy);",
    "prop_invariant": "a_i: assert property (val >= 0 && !(vw && clk));",
    "prop_guard_unchecked": "a_u: assert property (vw |-> ##70 buy);",
    "prop_bit_select": "a_b: assert property (num[0] |=> num[2:1] != 2'd3 || $past(num[3]));",
    "prop_concat": "a_k: assert property (vw |=> {$past(vw), buy, num[1:0]} != 4'b1000);",
    "prop_onehot": "a_h: assert property ($onehot(num[3:0]) |=> $countones(num[3:0]) > 1 || $onehot0({vw, clk, num[4]}));",
    "prop_choice": "a_q: assert property (vw |=> (buy ? num[0] : ^num[1:0]));",
    "prop_bitwise": "a_w: assert property (1'b1 |=> (num[3:0] & ~$past(num[3:0])) != 4'd0 || (num >> 2 | 1) == num[5:2] + !num[2]);",
    "prop_declared": """
      default clocking cb @(posedge clock); endclocking
      default disable iff (err);
      localparam LIMIT = 10;
      wire low = val < LIMIT;
      property p_low; low |=> !low || buy; endproperty
      a_l: assert property (p_low) else $error("low");
    """,
}
#: Queries whose plan also has the covers of the antecedents.
WITH_COVERS = {"prop_vacuity"}
SUITE = "a_n: assert property (vw |=> !err); a_r: assert property (clk |-> ##[1:12] buy); a_v: assert property (sgn && clk |-> buy);"


def _plan(name: str) -> Plan:
    plan = parse_block(BLOCKS[name], auto_cover=name in WITH_COVERS)
    if plan.skipped:
        raise ValueError(f"{name}: {plan.skipped}")
    return plan


def _checked(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return monitor.verdicts(events(spark, sf_dir), _plan(name), BY, ORDER)

    query.__name__ = name
    return query


def prop_suite_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.suite(events(spark, sf_dir), parse_block(SUITE, auto_cover=False), BY, ORDER)


def prop_reset_assumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces that start without an error in their first two rows, checked from the third row on."""
    rows = monitor.reset_held(events(spark, sf_dir), BY, ORDER, "NOT err", 2)
    return monitor.verdicts(rows, parse_block(BLOCKS["prop_nonoverlap"], min_depth=2, auto_cover=False), BY, ORDER)


def prop_split_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one trace a month's parity, checked in chunks: traces that one task shouldn't take."""
    rows = events(spark, sf_dir).withColumn("half", F.month("ts") % 2)
    plan = parse_block("a_l: assert property (vw ##1 clk |=> ##[0:5] buy); a_p: assert property (vw |=> val > $past(val) - 20);", auto_cover=False)
    return monitor.verdicts(rows, plan, ["half"], ORDER, split=2048)


def prop_assume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks over the rows before a trace's first row that breaks an assumption."""
    plan = parse_block("m_a: assume property (vw |=> !sgn); a_n: assert property (vw |=> buy);", auto_cover=False, strict=False)
    rows = monitor.assumed(events(spark, sf_dir), plan, BY, ORDER)
    return monitor.verdicts(rows, monitor.assumptions(plan)[1], BY, ORDER)


def prop_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.violations(events(spark, sf_dir), _plan("prop_disable_iff"), BY, ORDER)


def _first_failures(rows: DataFrame) -> DataFrame:
    bad = monitor.violations(rows, _plan("prop_past_arith"), BY, ORDER)
    return bad.groupBy("user_id").agg(F.min("cycle").alias("failing_cycle"))


def _numbered(rows: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    return rows.withColumn("cycle", F.row_number().over(Window.partitionBy(*BY).orderBy(*ORDER)) - 1)


def prop_first_fail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _first_failures(events(spark, sf_dir))


def cex_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    shown = trace.counterexample(_numbered(rows).select("user_id", "cycle", "event_id", "event_type", "val"), _first_failures(rows), BY, "cycle")
    return shown.select("user_id", "cycle", "event_id", "event_type", "val", F.col("at"))


def changed_at_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    values = _numbered(rows).select("user_id", "cycle", "vw", "clk", "buy", "err")
    found = trace.changed_at(values, _first_failures(rows), BY, "cycle", ["vw", "clk", "buy", "err"])
    return found.select("user_id", F.col("at"), F.array_join("changed", ",").alias("changed"))


def step_by_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.steps_by_change(events(spark, sf_dir), BY, ORDER, "event_type").select("user_id", "event_id", "step")


def step_by_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.steps_by_edge(events(spark, sf_dir), BY, ORDER, F.col("buy")).select("user_id", "event_id", "step")


def dense_forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("seen", F.when(F.col("vw"), F.col("event_id").cast("string")))
    return trace.forward_fill(rows, BY, ORDER, "seen", "last_view").select("user_id", "event_id", "last_view")


def skipped_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of each user's events under a block of which most can't be checked, with the reasons."""
    block = """
      a_ok: assert property (vw |=> buy);
      a_rep: assert property (vw [*3] |-> buy);
      a_inf: assert property (vw |-> ##[1:$] buy);
      a_fun: assert property (sqrt(val) > 2);
      m_one: assume property (vw);
      a_far: assert property (vw |-> ##300 buy);
      r_one: restrict property (vw);
      sequence s_one; vw ##1 buy; endsequence
      a_cut: assert property (vw |-> buy
    """
    return monitor.report(events(spark, sf_dir), parse_block(block, auto_cover=False), BY, ORDER)


def _half(rows: DataFrame) -> DataFrame:
    return rows.withColumn("half", F.month("ts") % 2)


def _ticking(rows: DataFrame) -> DataFrame:
    """With a clock that is high at odd numbers."""
    return rows.withColumn("ck", F.col("num") % 2)


def prop_clocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks on the rows at rising edges of a clock column."""
    plan = parse_block("property p; @(posedge ck) vw |=> val > $past(val); endproperty a_k: assert property (p); a_f: assert property ($rose(vw) |-> buy || num[1]);", auto_cover=False)
    return monitor.verdicts(_ticking(events(spark, sf_dir)), plan, BY, ORDER)


def prop_default_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block's default clock, over long traces that are cut up."""
    plan = parse_block("default clocking cb @(posedge ck); endclocking\na_d: assert property (vw |=> ##[0:2] buy);", auto_cover=False)
    return monitor.verdicts(_half(_ticking(events(spark, sf_dir))), plan, ["half"], ORDER, split=2048)


def prop_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of four and three bits: what wraps at its width, and what doesn't."""
    rows = _numbered(events(spark, sf_dir)).withColumn("cnt", F.col("cycle") % 16).withColumn("ptr", F.col("num") % 8)
    block = """logic [3:0] cnt; wire [2:0] ptr;
      a_w: assert property (1'b1 |=> cnt == $past(cnt) + 4'd1);
      a_n: assert property (1'b1 |=> cnt == $past(cnt) + 1);
      a_s: assert property (ptr - 3'd3 > 3'd4 |=> ptr + $past(ptr) != 3'd7);"""
    return monitor.verdicts(rows, parse_block(block, auto_cover=False), BY, ORDER)


def prop_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value of 72 bits, as a string of bits with unknown ones at times."""
    word = F.when(F.col("err"), F.lit("x")).otherwise(F.concat(F.lpad(F.bin(F.col("num") % 256), 8, "0"), F.repeat(F.lit("01"), 32)))
    block = "a_w: assert property (w[71:64] < 8'd60); a_p: assert property (vw |=> w > $past(w)); a_o: assert property ($countones(w) < 37);"
    return monitor.verdicts(events(spark, sf_dir).withColumn("w", word), parse_block(block, auto_cover=False, widths={"w": 72}), BY, ORDER)


def prop_long_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of 200 rows and a disabling condition over all of them, by running counts."""
    plan = parse_block("a_l: assert property (disable iff (err && val > 85) vw && val > 80 |-> ##[1:200] sgn && val > 90);", auto_cover=False)
    return monitor.verdicts(_half(events(spark, sf_dir)), plan, ["half"], ORDER)


def stream_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prop_nonoverlap on the events as a stream, one file a batch; the sink is read back."""
    from tracecheck.sources.shared import folder

    place = folder(spark)
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    rows = stream.select("user_id", "ts", "event_id", (F.col("event_type") == "view").alias("vw"), (F.col("event_type") == "purchase").alias("buy"))
    plan = parse_block(BLOCKS["prop_nonoverlap"], auto_cover=False)
    query = (
        streaming.violations(rows.withColumn("ts", F.col("ts").cast("string")), plan, "user_id", ORDER, ["vw", "buy"])
        .writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema("user_id bigint, label string, cycle bigint, late bigint").parquet(f"{place}/out").where("late = 0").select("user_id", "label", "cycle")


QUERIES = {n: _checked(n) for n in BLOCKS} | {
    f.__name__: f for f in (prop_suite_verdicts, prop_reset_assumed, prop_split_traces, prop_assume, prop_violations, prop_first_fail, cex_window, changed_at_failure, step_by_change, step_by_edge, dense_forward_fill, skipped_items, prop_clocked, prop_default_clock, prop_wrap, prop_wide, prop_long_range, stream_violations)
}

# --- SQL: looks forward from each antecedent with joins, where the plan looks back with lags ---

_T = """WITH t AS (
  SELECT user_id, event_id, event_type, value AS val, floor(value)::BIGINT AS num, event_type = 'view' AS vw, event_type = 'click' AS clk, event_type = 'purchase' AS buy,
    event_type = 'signup' AS sgn, event_type = 'error' AS err, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS c FROM events
), n AS (SELECT user_id, count(*) AS n_rows FROM t GROUP BY user_id)"""
_AFTER = "FROM t a JOIN t b ON b.user_id = a.user_id AND b.c = a.c + {k} WHERE a.vw"


def _verdicts(*checks: tuple[str, str, int, str]) -> str:
    """checks: label, kind, depth, SELECT user_id, c, bad of each live row."""
    lives = ", ".join(f"l{i} AS ({sql})" for i, (_, _, _, sql) in enumerate(checks))
    each = " UNION ALL ".join(
        f"""SELECT n.user_id, n_rows, '{label}' AS label, '{kind}' AS kind, {depth} AS depth, count(l.c) AS n_live, count(*) FILTER (l.bad) AS n_hit,
          min(l.c) FILTER (l.bad) AS first_hit FROM n LEFT JOIN l{i} l USING (user_id) GROUP BY n.user_id, n_rows"""
        for i, (label, kind, depth, _) in enumerate(checks)
    )
    return f"""{_T}, {lives}, v AS ({each})
    SELECT *, CASE WHEN n_rows <= depth THEN 'UNCHECKED' WHEN kind = 'cover' THEN CASE WHEN n_hit > 0 THEN 'REACHED' ELSE 'UNREACHED' END
      WHEN n_hit > 0 THEN 'VIOLATED' WHEN n_live = 0 THEN 'VACUOUS' ELSE 'HOLDS' END AS verdict FROM v"""


def _delayed(k: int, bad: str, where: str = "") -> str:
    return f"SELECT a.user_id, b.c, {bad} AS bad {_AFTER.format(k=k)} {where}"


def _on_clock(sql: str) -> str:
    """Over the rows at which num is odd after a row at which it isn't."""
    edges = """), t AS (SELECT e.* REPLACE (row_number() OVER (PARTITION BY user_id ORDER BY c) - 1 AS c) FROM (SELECT b.* FROM t0 b LEFT JOIN t0 a ON a.user_id = b.user_id AND a.c = b.c - 1
      WHERE b.num % 2 = 1 AND coalesce(a.num % 2 = 0, true)) e), n AS ("""
    return sql.replace("WITH t AS (", "WITH t0 AS (", 1).replace("), n AS (", edges, 1)


def _by_half(sql: str) -> str:
    """A trace for each parity of the month instead of each user."""
    sql = sql.replace("SELECT user_id, event_id", "SELECT month(ts) % 2 AS user_id, event_id", 1).replace("PARTITION BY user_id", "PARTITION BY month(ts) % 2", 1)
    return sql.replace("SELECT *, CASE WHEN n_rows", "SELECT user_id AS half, * EXCLUDE user_id, CASE WHEN n_rows", 1)


_RANGE = """SELECT a.user_id, b.c, NOT EXISTS (SELECT 1 FROM t x WHERE x.user_id = a.user_id AND x.buy AND x.c BETWEEN a.c + {m} AND a.c + {n}) AS bad
  FROM t a JOIN t b ON b.user_id = a.user_id AND b.c = a.c + {n} WHERE a.{s}"""
_FAIL = f"{_T}, f AS (SELECT b.user_id, min(b.c) AS failing_cycle {_AFTER.format(k=1)} AND NOT (b.val > a.val - 20) GROUP BY b.user_id)"
_DISABLED = "AND NOT EXISTS (SELECT 1 FROM t x WHERE x.user_id = a.user_id AND x.err AND x.c BETWEEN a.c AND a.c + 2)"
_SEQ3 = "FROM t a JOIN t b ON b.user_id = a.user_id AND b.c = a.c + 1 JOIN t d ON d.user_id = a.user_id AND d.c = a.c + 2"
_SUITE_SQL = _verdicts(
    ("a_n", "assert", 1, _delayed(1, "b.err")), ("a_r", "assert", 12, _RANGE.format(m=1, n=12, s="clk")), ("a_v", "assert", 0, "SELECT user_id, c, NOT buy AS bad FROM t WHERE sgn AND clk")
)

ORACLES = {
    "prop_overlap": _verdicts(("a_o", "assert", 0, "SELECT user_id, c, NOT (val > 10) AS bad FROM t WHERE vw")),
    "prop_nonoverlap": _verdicts(("a_n", "assert", 1, _delayed(1, "NOT b.buy"))),
    "prop_fixed_delay": _verdicts(("a_d", "assert", 2, _delayed(2, "NOT b.clk"))),
    "prop_range": _verdicts(("a_r", "assert", 3, _RANGE.format(m=1, n=3, s="vw"))),
    "prop_sequence_ante": _verdicts(("a_s", "assert", 2, f"SELECT a.user_id, d.c, NOT d.buy AS bad {_SEQ3} WHERE a.vw AND b.clk")),
    "prop_multi_consequent": _verdicts(("a_m", "assert", 1, _delayed(1, "NOT b.clk")), ("a_m__c1", "assert", 2, _delayed(2, "NOT b.buy"))),
    "prop_conjunction": _verdicts(
        ("a_c__k1", "assert", 0, "SELECT user_id, c, NOT (val > 5) AS bad FROM t WHERE vw"),
        ("a_c__k2", "assert", 1, "SELECT a.user_id, b.c, NOT b.buy AS bad FROM t a JOIN t b ON b.user_id = a.user_id AND b.c = a.c + 1 WHERE a.clk"),
    ),
    "prop_disable_iff": _verdicts(("a_x", "assert", 2, _delayed(2, "NOT b.buy", _DISABLED))),
    "prop_rose_fell": _verdicts(("a_f", "assert", 2, f"SELECT a.user_id, d.c, b.clk AND NOT d.clk AS bad {_SEQ3} WHERE b.vw AND NOT a.vw")),
    "prop_stable_changed": _verdicts(("a_t", "assert", 1, "SELECT a.user_id, b.c, a.clk <> b.clk AS bad FROM t a JOIN t b ON b.user_id = a.user_id AND b.c = a.c + 1 WHERE a.vw <> b.vw")),
    "prop_past_arith": _verdicts(("a_p", "assert", 1, _delayed(1, "NOT (b.val > a.val - 20)"))),
    "prop_cover": _verdicts(("c_s", "cover", 2, f"SELECT a.user_id, d.c, a.vw AND b.clk AND d.buy AS bad {_SEQ3}")),
    "prop_vacuity": _verdicts(("a_v", "assert", 0, "SELECT user_id, c, NOT buy AS bad FROM t WHERE vw AND clk"), ("a_v__cov", "cover", 0, "SELECT user_id, c, vw AND clk AS bad FROM t")),
    "prop_invariant": _verdicts(("a_i", "assert", 0, "SELECT user_id, c, NOT (val >= 0 AND NOT (vw AND clk)) AS bad FROM t")),
    "prop_guard_unchecked": _verdicts(("a_u", "assert", 70, _delayed(70, "NOT b.buy"))),
    "prop_bit_select": _verdicts(("a_b", "assert", 1, _delayed(1, "NOT ((b.num >> 1) % 4 <> 3 OR (a.num >> 3) % 2 = 1)").replace("a.vw", "a.num % 2 = 1"))),
    "prop_concat": _verdicts(("a_k", "assert", 1, _delayed(1, "NOT b.buy AND b.num % 4 = 0"))),
    "prop_onehot": _verdicts(
        ("a_h", "assert", 1, _delayed(1, "NOT (bit_count((b.num % 16)::INT) > 1 OR b.vw::INT + b.clk::INT + (b.num >> 4) % 2 <= 1)").replace("a.vw", "a.num % 16 IN (1, 2, 4, 8)"))
    ),
    "prop_choice": _verdicts(("a_q", "assert", 1, _delayed(1, "CASE WHEN b.buy THEN b.num % 2 = 0 ELSE b.num % 4 IN (0, 3) END"))),
    "prop_bitwise": _verdicts(
        ("a_w", "assert", 1, _delayed(1, "NOT ((b.num % 16) & (15 - a.num % 16) <> 0 OR ((b.num >> 2) | 1) = (b.num >> 2) % 16 + ((b.num >> 2) % 2 = 0)::INT)").replace("WHERE a.vw", ""))
    ),
    "prop_declared": _verdicts(("a_l", "assert", 1, _delayed(1, "b.val < 10 AND NOT b.buy", "AND NOT a.err AND NOT b.err").replace("a.vw", "a.val < 10"))),
    "prop_assume": _verdicts(("a_n", "assert", 1, _delayed(1, "NOT b.buy")))
    .replace("WITH t AS (", "WITH t0 AS (")
    .replace("), n AS (", "), t AS (SELECT * FROM t0 x WHERE NOT EXISTS (SELECT 1 FROM t0 p JOIN t0 q ON q.user_id = p.user_id AND q.c = p.c + 1 WHERE p.user_id = x.user_id AND q.c <= x.c AND p.vw AND q.sgn)), n AS (", 1),
    "skipped_items": f"""SELECT user_id, label AS item, verdict, NULL::VARCHAR AS reason FROM ({_verdicts(("a_ok", "assert", 1, _delayed(1, "NOT b.buy")))})
      UNION ALL SELECT user_id, item, 'UNCHECKED', reason FROM (SELECT DISTINCT user_id FROM events), (VALUES ('a_rep', 'repetition is not supported'), ('a_inf', 'an unbounded delay is not supported'),
      ('a_fun', 'sqrt(...) is not supported: neither functions nor properties with arguments are'), ('m_one', 'assumptions are not allowed'), ('a_far', 'reaches back over 254 rows'),
      ('r_one', 'the statement is not supported'), ('s_one', 'sequence declarations are not supported'), ('a_cut: assert property', 'the statement is cut off')) AS v(item, reason)""",
    "prop_clocked": _on_clock(_verdicts(
        ("a_k", "assert", 1, _delayed(1, "NOT (b.val > a.val)")),
        ("a_f", "assert", 1, "SELECT a.user_id, b.c, NOT (b.buy OR (b.num >> 1) % 2 = 1) AS bad FROM t a JOIN t b ON b.user_id = a.user_id AND b.c = a.c + 1 WHERE b.vw AND NOT a.vw"),
    )),
    "prop_default_clock": _by_half(_on_clock(_verdicts(("a_d", "assert", 3, _RANGE.format(m=1, n=3, s="vw"))))),
    "prop_long_range": _by_half(_verdicts(("a_l", "assert", 200, _RANGE.replace("x.buy", "x.sgn AND x.val > 90").format(m=1, n=200, s="vw AND a.val > 80")
        + " AND NOT EXISTS (SELECT 1 FROM t x WHERE x.user_id = a.user_id AND x.err AND x.val > 85 AND x.c BETWEEN a.c AND a.c + 200)"))),
    "prop_wrap": _verdicts(
        ("a_w", "assert", 1, "SELECT user_id, c, false AS bad FROM t WHERE c >= 1"),
        ("a_n", "assert", 1, "SELECT user_id, c, c % 16 = 0 AS bad FROM t WHERE c >= 1"),
        ("a_s", "assert", 1, _delayed(1, "(b.num % 8 + a.num % 8) % 8 = 7").replace("a.vw", "(a.num + 5) % 8 > 4")),
    ),
    "prop_wide": _verdicts(
        ("a_w", "assert", 0, "SELECT user_id, c, err OR num % 256 >= 60 AS bad FROM t"),
        ("a_p", "assert", 1, _delayed(1, "a.err OR b.err OR b.num % 256 <= a.num % 256")),
        ("a_o", "assert", 0, "SELECT user_id, c, err OR bit_count((num % 256)::INT) >= 5 AS bad FROM t"),
    ),
    "prop_suite_verdicts": f"""SELECT user_id, max(n_rows) AS n_rows, count(*) AS n_checks, count(*) FILTER (verdict = 'HOLDS') AS n_holds,
      count(*) FILTER (verdict = 'VIOLATED') AS n_violated, count(*) FILTER (verdict = 'VACUOUS') AS n_vacuous, count(*) FILTER (verdict = 'UNCHECKED') AS n_unchecked,
      min(first_hit) FILTER (verdict = 'VIOLATED') AS first_violation,
      CASE WHEN bool_or(verdict = 'VIOLATED') THEN 'VIOLATED' WHEN bool_or(verdict = 'UNCHECKED') THEN 'UNCHECKED' WHEN bool_or(verdict = 'VACUOUS') THEN 'VACUOUS' ELSE 'HOLDS' END AS verdict
      FROM ({_SUITE_SQL}) GROUP BY user_id""",
    "prop_reset_assumed": _verdicts(("a_n", "assert", 2, _delayed(1, "NOT b.buy", "AND b.c >= 2"))).replace(
        "n AS (SELECT user_id, count(*) AS n_rows FROM t GROUP BY user_id)",
        "n AS (SELECT user_id, count(*) AS n_rows FROM t GROUP BY user_id HAVING NOT bool_or(err AND c < 2))",
    ),
    "prop_split_traces": _by_half(_verdicts(
        ("a_l", "assert", 7, """SELECT a.user_id, d.c, NOT EXISTS (SELECT 1 FROM t x WHERE x.user_id = a.user_id AND x.buy AND x.c BETWEEN a.c + 2 AND a.c + 7) AS bad
          FROM t a JOIN t b ON b.user_id = a.user_id AND b.c = a.c + 1 JOIN t d ON d.user_id = a.user_id AND d.c = a.c + 7 WHERE a.vw AND b.clk"""),
        ("a_p", "assert", 1, _delayed(1, "NOT (b.val > a.val - 20)")),
    )),
    "prop_violations": f"{_T} SELECT a.user_id, 'a_x' AS label, b.c AS cycle {_AFTER.format(k=2)} AND NOT b.buy {_DISABLED}",
    "prop_first_fail": f"{_FAIL} SELECT user_id, failing_cycle FROM f",
    "cex_window": f"{_FAIL} SELECT t.user_id, c AS cycle, event_id, event_type, val, failing_cycle AS at FROM t JOIN f USING (user_id) WHERE c BETWEEN failing_cycle - 4 AND failing_cycle",
    "changed_at_failure": f"""{_FAIL} SELECT f.user_id, failing_cycle AS at, concat_ws(',', CASE WHEN a.vw <> b.vw THEN 'vw' END, CASE WHEN a.clk <> b.clk THEN 'clk' END,
      CASE WHEN a.buy <> b.buy THEN 'buy' END, CASE WHEN a.err <> b.err THEN 'err' END) AS changed
      FROM f JOIN t b ON b.user_id = f.user_id AND b.c = failing_cycle JOIN t a ON a.user_id = f.user_id AND a.c = failing_cycle - 1""",
    "step_by_change": f"""{_T}, m AS (SELECT b.*, a.event_type IS DISTINCT FROM b.event_type AS new FROM t b LEFT JOIN t a ON a.user_id = b.user_id AND a.c = b.c - 1)
      SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY c) - 1 AS step FROM m WHERE new""",
    "step_by_edge": f"""{_T}, m AS (SELECT b.*, b.buy AND NOT coalesce(a.buy, false) AS new FROM t b LEFT JOIN t a ON a.user_id = b.user_id AND a.c = b.c - 1)
      SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY c) - 1 AS step FROM m WHERE new""",
    "dense_forward_fill": f"""{_T} SELECT b.user_id, b.event_id, coalesce((SELECT a.event_id::VARCHAR FROM t a WHERE a.user_id = b.user_id AND a.vw AND a.c <= b.c ORDER BY a.c DESC LIMIT 1), 'x') AS last_view FROM t b""",
    "stream_violations": f"{_T} SELECT a.user_id, 'a_n' AS label, b.c AS cycle {_AFTER.format(k=1)} AND NOT b.buy",
}

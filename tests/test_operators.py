"""Verdicts, attempts and curation on hand-made rows."""

from pyspark.sql import functions as F

from tracecheck.operators import attempts, catalog, curate, verdicts


def test_kill_report(spark):
    df = spark.createDataFrame([("b", "m1", "FAIL"), ("b", "m2", "PASS"), ("b", "m3", "ERROR"), ("c", "m1", "ERROR")], "block string, m string, status string")
    got = {r.block: (r.killed, r.valid_mutants, r.kill_rate, r.survivors) for r in verdicts.kill_report(df, ["block"], "m").collect()}
    assert got == {"b": (1, 2, 0.5, ["m2"]), "c": (0, 0, 0.0, [])}


def test_status_and_gate(spark):
    df = spark.createDataFrame([(0,), (2,), (4,), (8,), (16,), (77,), (None,)], "rc int")
    assert [r.s for r in df.select(verdicts.status(F.col("rc")).alias("s")).collect()] == ["PASS", "FAIL", "UNKNOWN", "TIMEOUT", "ERROR", "ERROR", "ERROR"]
    g = spark.createDataFrame([("PASS", None, 0), ("PASS", "PASS", 0), ("PASS", "PASS", 1), ("PASS", "TIMEOUT", 0), ("FAIL", None, 0), (None, None, 0)], "prove string, cover string, v int")
    vac = verdicts.vacuity_ok(F.col("cover"), F.col("v"))
    rows = g.select(verdicts.gate_passed(F.col("prove"), vac).alias("p"), verdicts.scored(F.col("prove"), F.col("cover")).alias("s"), vac.alias("v")).collect()
    assert [(r.p, r.s, r.v) for r in rows] == [(True, True, None), (True, True, True), (False, True, False), (False, False, False), (False, False, None), (False, False, None)]


def test_meets_kill(spark):
    rows = [(0.0, False, 5, 0, 0, True), (0.5, False, 5, 4, 4, False), (0.5, True, 0, 0, 0, True), (0.5, True, 5, 0, 0, False), (0.5, True, 4, 4, 2, True), (0.6, True, 4, 4, 2, False), (1 / 3, True, 3, 3, 1, True)]
    df = spark.createDataFrame(rows, "bar double, proven boolean, att int, n int, k int, want boolean")
    assert all(r.got == r.want for r in df.select("want", verdicts.meets_kill(*[F.col(c) for c in ("bar", "proven", "att", "n", "k")]).alias("got")).collect())


def test_log(spark):
    text = (
        "Reached cover statement in step 1 at counter: c_reach\nUnreached cover statement at counter: a_vac__cov\nUnreached cover statement at counter: c_never\n"
        "Assert failed in counter: a_hold__c1\nsummary:   failed assertion counter.a_hold__c1 at counter.sv:40.9-40.40 step 5\nERROR: no such module\nDONE (ERROR, rc=16)\n"
    )
    p = verdicts.parse_log(F.col("t"))
    r = spark.createDataFrame([(text,)], "t string").select(*[c.alias(k) for k, c in p.items()]).first()
    assert (r.failed, r.failing_step, r.unreached, r.reached, r.errors) == (["a_hold"], 5, ["a_vac__cov", "c_never"], ["c_reach"], ["no such module"])


ATT = "t string, ord int, turn int, status string, proven boolean, killed long, n_skipped long, valid_mutants long, n_vacuous long, n_failed long, from_survivors boolean, sva string"


def _attempts(spark):
    a = lambda t, o, s, p=False, k=0, v=0, f=0, surv=False: (t, o, o, s, p, k, 0, v, 0, f, surv, f"{t}{o}")
    rows = [a("A", 0, "PASS", True, 2, 4), a("B", 0, "FAIL", f=2), a("B", 1, "PASS", True, 1, 4), a("C", 0, "FAIL", f=3), a("C", 1, "FAIL", f=1), a("D", 0, "ERROR"), a("E", 0, "PASS")]
    return spark.createDataFrame(rows, ATT)


def _key():
    return attempts.winner_key(*[F.col(c) for c in ("status", "proven", "killed", "n_skipped", "valid_mutants", "n_vacuous", "n_failed", "turn")])


def test_trajectories_and_suite(spark):
    a = _attempts(spark)
    t = attempts.trajectories(a, ["t"], _key())
    got = {r.t: (r.status, r.ok, r.first_pass, r.healed, r.turns, r.kill_rate) for r in t.collect()}
    assert got == {"A": ("PASS", True, True, False, 1, 0.5), "B": ("PASS", True, False, True, 2, 0.25), "C": ("FAIL", False, False, False, 2, None), "D": ("ERROR", False, False, False, 1, None), "E": ("VACUOUS", False, False, False, 1, None)}
    s = attempts.suite(t.where("t < 'E'")).first()
    assert (s.blocks, s.first_pass_rate, s.cegar_rate, s.heal_rate, s.syntactic_rate) == (4, 0.25, 0.5, 1 / 3, 0.75)
    e = attempts.suite(t.limit(0)).first()
    assert (e.blocks, e.first_pass_rate, e.heal_rate) == (0, 0.0, 0.0)
    w = attempts.winners(a, ["t"], _key())
    assert {r.t: r.ord for r in w.collect()} == {"A": 0, "B": 1, "C": 1, "D": 0, "E": 0}
    fixed = w.select("t", F.col("sva").alias("fixed_attempt"))
    heals = [(r.faulty_attempt, r.fixed_attempt, r.turns) for r in attempts.heal_rows(a, t, ["t"], fixed).collect()]
    assert heals == [("B0", "B1", 2)]
    assert {r.t: r.kill_rate for r in attempts.sft_rows(w, F.lit(True)).collect()} == {"A": 0.5, "B": 0.25}


def test_two_orders_of_undecided_runs(spark):
    """Undecided samples come before failures within a turn, but lose to them as winners."""
    rows = [("T", 0, 0, "TIMEOUT", False, 0, 0, 0, 0, 0, False, "a"), ("T", 1, 1, "FAIL", False, 0, 0, 0, 0, 2, False, "b")]
    df = spark.createDataFrame(rows, ATT)
    assert attempts.winners(df, ["t"], _key()).first().ord == 1
    rank = attempts.candidate_rank(F.col("status"), F.col("n_skipped"), F.col("n_failed"), F.lit(None).cast("int"))
    assert attempts.best_of_n(df, ["t"], rank, F.lit(False)).first().ord == 0


def test_curation(spark):
    rows = [("  ", 0, True, 1, 1.0, "empty"), ("x", 2, True, 1, 1.0, "skipped-statements"), ("x", 0, False, 1, 1.0, "cover-fail"), ("x", 0, None, 0, 1.0, "no-asserts"), ("x", 0, None, None, 0.2, "below-min-kill"), ("x", 0, None, None, None, None), ("x", 0, True, 3, 0.25, None), (None, 0, True, 1, 1.0, "empty")]
    df = spark.createDataFrame(rows, "s string, k int, c boolean, n int, r double, want string")
    assert all(x.got == x.want for x in df.select("want", curate.drop_reason(*[F.col(c) for c in ("s", "k", "c", "n", "r")]).alias("got")).collect())
    w = spark.createDataFrame([(0.75,), (0.5,), (0.25,), (0.625,), (0.1,)], "w double")
    assert [r.n for r in w.select(curate.copies(F.col("w"), 4).alias("n")).collect()] == [3, 2, 1, 2, 1]
    assert curate.repeat(w, F.col("w"), 0).count() == 5
    d = spark.createDataFrame([("b", 0.5, 1), ("b", 0.75, 2), ("b", 0.75, 3)], "b string, w double, s int")
    assert [r.s for r in curate.dedupe_best(d, ["b"], F.col("w"), "s").collect()] == [2]


def test_history_and_tokens(spark):
    m = spark.createDataFrame([([{"role": "r", "content": str(i)} for i in range(n)],) for n in (1, 2, 3, 5, 8)], "m array<struct<role string, content string>>")
    got = [[x["content"] for x in r.t] for r in m.select(curate.trim_history(F.col("m"), 1).alias("t")).collect()]
    assert got == [["0"], ["0", "1"], ["0", "1", "2"], ["0", "1", "3", "4"], ["0", "1", "6", "7"]]
    assert [r.t for r in m.select(curate.estimate_tokens(F.lit(99)).alias("t")).limit(1).collect()] == [39]


def test_weighted_draw_follows_weights(spark):
    rows = spark.createDataFrame([(i, 9.0 if i == 3 else 1.0) for i in range(10)] + [(10, 0.0)], "k long, w double")
    drawn = curate.weighted_draw(rows, "k", F.col("w"), 4000, seed=1)
    counts = {r.k: r["count"] for r in drawn.groupBy("k").count().collect()}
    assert sum(counts.values()) == 4000
    assert abs(counts[3] - 2000) < 200 and counts.get(10, 0) < 10
    again = curate.weighted_draw(rows.repartition(3), "k", F.col("w"), None, seed=1)
    assert again.columns == ["draw", "k", "w"] and sorted(r.draw for r in again.collect()) == list(range(11))
    assert curate.weighted_draw(rows.where("k < 0"), "k", F.col("w"), 5, seed=1).count() == 0


def test_catalog(spark):
    d = spark.createDataFrame([(0, 0, True, False), (2, 0, True, False), (0, 1, True, False), (1, 0, False, False), (1, 0, True, True), (1, 0, True, False)], "h int, v int, s boolean, e boolean")
    got = [r.x for r in d.select(catalog.skip_reason(*[F.col(c) for c in ("h", "v", "s", "e")]).alias("x")).collect()]
    assert got == ["no HDL", "multiple HDL files", "VHDL", "missing spec", "both clock edges", None]
    s = spark.createDataFrame([("  A-b C!",), ("__x__",)], "t string")
    assert [r.x for r in s.select(catalog.slug(F.col("t")).alias("x")).collect()] == ["a_b_c", "x"]

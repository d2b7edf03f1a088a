"""The repair loop: rounds, messages, observed counts, and a plain loop beside it."""

from pyspark.sql import functions as F

from tracecheck.operators import repair
from tracecheck.queries import attempts as Q

JOBS = [(k, "sys", f"block {k}") for k in range(9)] + [(20, None, None)]


def test_rounds_and_messages(spark):
    seen, asked = {}, []

    def generate(frame):
        asked.append({r.job: [(m.role, m.content) for m in r.messages] for r in frame.collect()})
        return Q._asked(frame)

    got = repair.run_suite(spark.createDataFrame(JOBS, "job long, system string, user string"), generate, Q._scored, turns=3, min_kill=0.5, on_round=lambda turn, counts: seen.update({turn: counts})).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.job, r.ord)):
        by.setdefault(r.job % 4, []).append((r.turn, r.status, r.from_survivors, r.repeated))
    want = {0: [(1, "PASS", False, False)], 1: [(1, "FAIL", False, False), (2, "PASS", False, False)], 3: [(1, "ERROR", False, False), (2, "PASS", False, False), (3, "PASS", False, False)],
            2: [(1, "FAIL", False, False), (2, "FAIL", False, True), (2, "PASS", True, False), (3, "FAIL", False, True), (3, "PASS", True, False)]}
    assert {k: v for k, v in by.items()} == {k: v * len([j for j, *_ in JOBS if j % 4 == k]) for k, v in want.items()}
    assert seen == {1: {"attempts": 10, "passed": 4, "failed": 4, "proven": 4}, 2: {"attempts": 6, "passed": 4, "failed": 2, "proven": 2}, 3: {"attempts": 4, "passed": 2, "failed": 2, "proven": 2}}
    assert [set(a) for a in asked] == [set(range(9)) | {20}, {1, 2, 3, 5, 6, 7}, {2, 3, 6, 7}]
    assert asked[0][0] == [("system", "sys"), ("user", "block 0")] and asked[0][20] == [("system", ""), ("user", "")]
    assert all(len(m) == 4 and m[:2] == [("system", "sys"), ("user", f"block {k}")] for a in asked[1:] for k, m in a.items())  # only the last exchange is kept
    second = {k: m[3][1] for k, m in asked[1].items()}
    assert "These failed and are gone: a_1" in second[1] and "a_2: assert property (y);" in second[1] and "a_1: assert" not in second[1]
    assert "ended with ERROR" in second[3] and "These never apply in any run: a_2" in asked[2][3][3][1] and "same labels failed before" in asked[2][2][3][1]


def test_messages_by_outcome(spark):
    rows = [("PASS", [], [], [], True, 4, 4, 1), ("PASS", [], [], [], True, 4, 0, 0), ("PASS", [], [], [], False, 0, 0, 0), ("PASS", [], ["s_1"], [], True, 4, 4, 4), ("TIMEOUT", [], [], [], False, 0, 0, 0)]
    df = spark.createDataFrame(rows, "status string, failed array<string>, skipped array<string>, vacuous array<string>, proven boolean, attempted long, valid long, killed long").withColumn("repeated", F.lit(False))
    said = [r[0] for r in df.select(repair.repair_message(F.lit("k"), 0.5)).collect()]
    for text, part in zip(said, ("finds 1 of 4", "None of 4", "proves nothing", "Not checked, since the language doesn't have it: s_1", "ended with TIMEOUT"), strict=True):
        assert part in text and text.endswith("don't repeat them:\nk\n")


def test_known_declarations_go(spark):
    kept = "property p; x; endproperty\na_1: assert property (p);\nb: cover property (y);"
    fresh = "property P; z; endproperty\nA_1: assert property (q);\na_3: assert property (P);\nproperty r; w; endproperty\na_4: assert property (r); // note\nassert property (v);"
    df = spark.createDataFrame([(kept, fresh), ("", fresh)], "k string, f string")
    got = [r[0] for r in df.select(repair.without_known(F.col("k"), F.col("f"))).collect()]
    assert got[0] == "`ifdef FORMAL\nproperty r; w; endproperty\na_4: assert property (r); // note\nassert property (v);\n`endif\n" and got[1] == f"`ifdef FORMAL\n{fresh}\n`endif\n"


def test_no_jobs(spark):
    assert repair.run_suite(spark.createDataFrame([], "job long, system string, user string"), Q._asked, Q._scored).count() == 0

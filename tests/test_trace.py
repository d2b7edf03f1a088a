"""Waveforms: parsing, samples, steps, rendered values."""

import pytest
from pyspark.sql import functions as F

from tracecheck.operators import trace
from tracecheck.sources import vcd

DUMP = """$date x $end
$scope module top $end
$var wire 1 ! clk $end
$var wire 4 # n [3:0] $end
$var event 1 e tick $end
$scope module _witness_ $end
$var wire 1 w any $end
$upscope $end
$var wire 1 % go_EN $end
$upscope $end
$var integer 32 s smt_step $end
$enddefinitions $end
$dumpvars b0 # $end
0!
#0
b0 s
1!
b0000 #
0%
#5
0!
#10
b1 s
1!
b101 #
1!
r1.5 w
#10
b1 s
"""


def tables(spark, text=DUMP):
    df = spark.createDataFrame([("a", text)], "trace_id string, text string")
    return {t: vcd.parse_column(df, "trace_id", "text", t) for t in vcd.SCHEMAS}


def test_parse(spark):
    t = tables(spark)
    names = [(r.name, r.width, r.scope) for r in t["signals"].orderBy("ord").collect()]
    assert names == [("clk", 1, ["top"]), ("n", 4, ["top"]), ("tick", 1, ["top"]), ("any", 1, ["top", "_witness_"]), ("go_EN", 1, ["top"]), ("smt_step", 32, [])]
    assert [(r.ti, r.t) for r in t["times"].orderBy("ti").collect()] == [(0, 0), (1, 5), (2, 10), (3, 10)]
    assert [r.name for r in trace.visible(t["signals"], "top").orderBy("ord").collect()] == ["clk", "n"]
    assert [r.name for r in trace.visible(t["signals"], "top", only=["top.go_EN"]).collect()] == ["go_EN"]
    assert [r.name for r in trace.visible(t["signals"], "top", include_internal=True).orderBy("ord").collect()] == ["clk", "n", "any", "go_EN"]
    assert trace.visible(t["signals"], "other").count() == 0 and trace.visible(t["signals"]).count() == 2


@pytest.mark.parametrize("bad", ["no end", "$scope module $end $enddefinitions $end", "$var wire x ! a $end $enddefinitions $end"])
def test_malformed(bad):
    with pytest.raises(vcd.VcdError):
        list(vcd.parse(bad))


def test_dense_and_steps(spark):
    t = tables(spark)
    s = trace.intervals(t["changes"], t["times"], t["signals"])
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, trace.intervals(t["changes"], t["times"], t["signals"], split=True).collect()))
    assert s.count() == 12  # one for each change that shows, and what comes before the first
    by = {}
    two = [trace.wide(t["changes"], t["times"], {"clk": "!", "n": "#", "never": "e"}, split=x).orderBy("ti").collect() for x in (False, True)]
    assert two[0] == two[1] and [tuple(r)[3:] for r in two[0]] == [("1", "0000", "x"), ("0", "0000", "x"), ("1", "101", "x"), ("1", "101", "x")]
    for r in trace.dense(s, t["times"]).orderBy("ti").collect():
        by.setdefault(r.code, []).append(r.raw)
    assert by["!"] == ["1", "0", "1", "1"] and by["#"] == ["0000", "0000", "101", "101"] and by["w"] == ["x", "x", "r1.5", "r1.5"] and by["e"] == ["x"] * 4
    assert [(r.ti, r.step) for r in trace.steps(s, t["times"], t["signals"], "clk").orderBy("ti").collect()] == [(0, 0), (2, 1)]
    plain = t["signals"].where("name <> 'smt_step'")
    assert [(r.ti, r.step) for r in trace.steps(s, t["times"], plain, "clk").orderBy("ti").collect()] == [(0, 0), (2, 1)]
    assert [r.ti for r in trace.steps(s, t["times"], plain, "nothing").orderBy("ti").collect()] == [0, 1, 2, 3]
    counted = [sorted(map(str, trace.counted_steps(s, trace.steps(s, t["times"], t["signals"], "clk"), split=x).collect())) for x in (False, True)]
    assert counted[0] == counted[1]
    names = spark.createDataFrame([("b.c",), ("z",), ("a",), ("a.b.c",)], "n string").orderBy(trace.trace_order(F.col("n")))
    assert [r.n for r in names.collect()] == ["a", "z", "b.c", "a.b.c"]
    shown = trace.traces(s, trace.steps(s, t["times"], t["signals"], "clk"), trace.visible(t["signals"], "top"))
    assert {r.name: r["values"] for r in shown.collect()} == {"clk": ["1", "1"], "n": ["0x0", "0x5"]}


def test_data_source(spark, tmp_path):
    (tmp_path / "x.vcd").write_text(DUMP)
    vcd.register(spark)
    rows = spark.read.format("vcd").option("path", str(tmp_path)).option("table", "changes").load()
    assert rows.count() == tables(spark)["changes"].count()
    assert vcd.read_vcd(spark, f"file://{tmp_path}", "signals").count() == 6


def test_a_dump_of_many_ranges(spark, tmp_path):
    """One file of several byte ranges gives the same tables as the whole text."""
    import random

    r = random.Random(2)
    head, first, rest = DUMP.partition("$enddefinitions $end\n")
    body = [line for k in range(400) for line in (f"#{k // 2 * 3}", *(f"{r.choice('01xZ')}!" if r.random() < 0.5 else r.choice([f"b{k:b} #", "R2.5 w", "b1 ", "$comment x $end", "", "  1% "]) for _ in range(r.randint(0, 3))))]
    texts = {"a": head + first + "\n".join(body) + "\n", "b": DUMP, "c": head + "$enddefinitions\n $end 1!\n#3\n0!"}
    for name, text in texts.items():
        (tmp_path / f"{name}.vcd").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        lines = vcd.read_lines(spark, f"file://{tmp_path}")
        assert lines.where("trace_id like '%a.vcd'").select("block").distinct().count() > 5
        got = {t: sorted(map(str, (tuple(x) for x in df.collect()))) for t, df in vcd.split_tables(lines).items()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    whole = spark.createDataFrame([(f"file://{tmp_path}/{name}.vcd", text) for name, text in texts.items()], "trace_id string, text string")
    for t in vcd.SCHEMAS:
        want = sorted(str(tuple(x)) for x in vcd.parse_column(whole, "trace_id", "text", t).collect())
        assert [x.replace("file:///", "file:/") for x in got[t]] == [x.replace("file:///", "file:/") for x in want], t
    (tmp_path / "d.vcd").write_text("#0\n1!\n")
    with pytest.raises(Exception, match="no .enddefinitions"):
        vcd.split_tables(vcd.read_lines(spark, f"file://{tmp_path}"))["times"].collect()


def test_format_value(spark):
    cases = [("1010", 4, "0xa"), ("0", 4, "0x0"), ("1", 1, "1"), ("x", 1, "x"), ("10x", 3, "b10x"), ("r2.5", 64, "2.5"), ("1" * 70, 70, "0x3" + "f" * 17), ("1", 70, "0x" + "0" * 17 + "1"), ("100000000", 8, "0x100")]
    df = spark.createDataFrame([(r, w) for r, w, _ in cases], "raw string, width int").withColumn("o", F.monotonically_increasing_id())
    assert [x.v for x in df.select(trace.format_value(F.col("raw"), F.col("width")).alias("v"), "o").orderBy("o").collect()] == [c[2] for c in cases]


def test_counterexample_window(spark):
    rows = spark.createDataFrame([("a", c, c % 2) for c in range(8)] + [("b", c, 0) for c in range(2)], "t string, c int, v int")
    fails = spark.createDataFrame([("a", 6), ("b", 9)], "t string, failing_cycle int")
    got = [(r.t, r.c) for r in trace.counterexample(rows, fails, ["t"], "c").orderBy("t", "c").collect()]
    assert got == [("a", c) for c in range(2, 7)] + [("b", 0), ("b", 1)]
    assert {r.t: r.changed for r in trace.changed_at(rows, fails, ["t"], "c", ["v"]).collect()} == {"a": ["v"], "b": []}


def test_render(spark):
    df = spark.createDataFrame([("q", ["0x1", "0x2"], True)], "n string, v array<string>, c boolean")
    assert df.select(trace.render(F.col("v"), F.col("n"), F.col("c"), 4).alias("x")).first().x == "q" + " " * 19 + " |  0x1  0x2 *"


def test_keys_with_more_digits_than_their_width(spark, tmp_path):
    import duckdb

    from tracecheck.queries import text

    place = f"{tmp_path}/part.parquet"
    spark.createDataFrame([(k,) for k in (0, 1, 4095, 4096, 4097, 65535, 65536, 65538, 70001, 119999, 1 << 40, (1 << 40) + 1)], "p_partkey bigint").coalesce(1).write.parquet(place)
    sql = text.ORACLES["format_values"].replace("FROM part", f"FROM read_parquet('{place}/*.parquet')")
    assert sorted(map(tuple, text.format_values(spark, str(tmp_path)).collect())) == sorted(duckdb.sql(sql).fetchall())


def test_dumps_share_files(spark, tmp_path, monkeypatch):
    from tracecheck.queries import text

    monkeypatch.setattr(text, "folder", lambda _: str(tmp_path))
    assert text.vcd_split(spark, "/root/testdata/sf0.001").count() > 1
    assert not list(tmp_path.rglob("user=*")) and list(tmp_path.rglob("*.txt"))

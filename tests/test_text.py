"""Source text: scanning, blocks, modules, mutants, contexts, catalogs."""

import random
import re

from pyspark.sql import functions as F

from tracecheck.functions import scan
from tracecheck.operators import macros, source
from tracecheck.operators import mutants as mutation
from tracecheck.sources import designs, generation, logs

MODULE = """module m #(parameter W = 4) (
  input clk, input rst_n, input [W-1:0] a, b,
  output reg [W-1:0] q
);
  localparam S0 = 0;
  reg [1:0] state;
  wire go, stop;
  assign go = (a <= b) && (a != 4'd3); // a == b
  always @(posedge clk or negedge rst_n)
    if (!rst_n) q <= 0;
    else if (go) q <= q + 1;
  always @(posedge clk) begin
    case (state)
      2'd0: q <= a;
      2'd1: q <= b;
      default: q <= 0;
    endcase
  end
endmodule
"""


def test_scanning():
    t = 'a = 1; // x\nb = "// no"; /* c\nd */ e'
    assert scan.strip_comments(t) == 'a = 1; \nb = "// no";   e'
    assert len(scan.blank_comments(t)) == len(t) and scan.blank_comments(t).count("\n") == 2 and '"// no"' in scan.blank_comments(t)
    assert scan.split_top_level("a, (b, c), d[1,2]", ",") == ["a", " (b, c)", " d[1,2]"]
    assert scan.call_arguments("f(a, g(b, c))", 1) == (["a", "g(b, c)"], 13)
    assert scan.strip_parens("((a) + (b))") == "(a) + (b)"
    known = scan.macros("`define A `B + 1\n`define B 2 // two\n`define F(x) x\n`define FLAG\n`define L `L x\n")
    assert known == {"A": "2 + 1", "B": "2", "L": "`L" + " x" * 8} and scan.with_macros("`A `FLAG `else", known) == "2 + 1 `FLAG `else"
    assert scan.unknown_macros("`ifdef X `Y `endif `Y // `Z") == ["Y"] and scan.plain_labels("`a_1 : assert `else: `b") == "a_1 : assert `else: `b"


def each(spark, make, *values):
    """make(column) of one row whose columns c0, c1, ... hold the values."""
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} {'array<string>' if isinstance(v, list) else 'string'}" for i, v in enumerate(values)))
    return df.select(make(*[F.col(c) for c in df.columns]).alias("x")).first().x


def names(found, *kinds):
    return {x["name"] for x in found if x["kind"] in kinds}


def test_comments(spark):
    t = 'a = 1; // x\nb = "// no"; /* c\nd */ e'
    assert each(spark, source.strip_comments, t) == scan.strip_comments(t) == 'a = 1; \nb = "// no";   e'
    assert each(spark, source.blank_comments, t) == scan.blank_comments(t) and each(spark, source.mask, t) == scan.mask_strings(t)
    for odd in ("", '"open', "/* open", "a / b", '"a\\"b" // "c"', "/*/ x */ y", "x" * 50_000 + "// y"):
        assert each(spark, source.strip_comments, odd) == scan.strip_comments(odd) and each(spark, source.blank_comments, odd) == scan.blank_comments(odd)
    assert each(spark, source.strip_comments, None) is None


def test_block_edits(spark):
    block = "`ifdef FORMAL\nproperty p; a |-> b; endproperty\nproperty o; c; endproperty\nx: assert property (p);\n// y: assert property (q);\nz: cover property (c);\n`endif\n"
    got = each(spark, source.items, block)
    assert [(x.kind, x.name, x.ref, x.complete) for x in got] == [("property", "p", None, True), ("property", "o", None, True), ("assert", "x", "p", True), ("cover", "z", "c", True)]
    left = each(spark, lambda b: source.written(source.strip_labels(source.items(b), F.array(F.lit("x")))), block)
    assert left == "`ifdef FORMAL\nz: cover property (c);\n`endif\n"
    rows = source.statements(spark.createDataFrame([(1, block)], "k int, b string"), ["k"], "b")
    kept = source.statements(spark.createDataFrame([(1, "property P; d; endproperty\nz: cover property (d);")], "k int, b string"), ["k"], "b")
    fresh, gone = source.drop_duplicates(rows, kept, ["k"])
    assert [r.name for r in fresh.collect()] == ["o"] and {r.name for r in gone.collect()} == {"x", "z", "p"}
    cut = each(spark, source.items, "a: assert property (x);\nproperty q; y |->")
    assert [(x.name, x.complete) for x in cut] == [("a", True), ("q", False)]
    assert each(spark, lambda b: source.has_kind(b, "assert", "assume"), "// a: assert property (x);") is False
    assert each(spark, source.items, "") == []


def test_extraction(spark):
    get = lambda t: each(spark, source.extract_block, t)
    answer = "<think>a: assert property (wrong);</think>Sure!\n```systemverilog\nHere is prose.\nproperty p;\n  a |-> b;\nendproperty\na_p: assert property (p);\n```\nBye"
    got = get(answer)
    found = each(spark, source.items, got)
    assert "prose" not in got and names(found, "property") == {"p"} and names(found, "assert") == {"a_p"}
    assert names(each(spark, source.items, get("`ifdef FORMAL\nc: cover property (x);\n`endif")), "cover") == {"c"}
    assert names(each(spark, source.items, get("```verilog\nc: cover property (x);")), "cover") == {"c"}
    assert "a: assert" in get("<think>a: assert property (only);</think>none") and "`define A 1" in get("```\n`define A 1\na: assert property (x);\n```")
    assert get("I can write: cover property of this. No.") is None and get(None) is None


def test_modules(spark):
    assert each(spark, source.module_names, MODULE + "// module no\nmodule two; endmodule") == ["m", "two"]
    once = each(spark, source.inject, MODULE, "a: assert property (q >= 0);", "m")
    assert once.index("assert") < once.index("endmodule") and "`ifdef FORMAL" in once
    strip = lambda t: each(spark, source.strip_formal, t)
    assert "".join(strip(once).split()) == "".join(MODULE.split())
    nested = "a\n`ifdef FORMAL\nx\n`ifdef Y\ny\n`endif\n`else\nkept\n`endif\nb\n`ifdef Z\nz\n`endif\n"
    assert strip(nested) == "a\nkept\nb\n`ifdef Z\nz\n`endif\n"
    assert strip("`ifdef FORMAL\nx\n`elsif Q\nq\n`else\nr\n`endif\n") == "`ifdef Q\nq\n`else\nr\n`endif\n"
    for bad in (("module x; ", "a: b;", "m"), (MODULE, "a: b;", "none"), (MODULE, "// nothing", "m")):
        assert each(spark, source.inject, *bad) is None


def test_context(spark):
    df = source.with_context(spark.createDataFrame([(MODULE, "m"), (MODULE, "none"), (None, "m")], "code string, top string"), "code", "top")
    c, none, null = df.collect()
    assert [p.name for p in c.ports] == ["clk", "rst_n", "a", "b", "q"] and [i.name for i in c.internals] == ["state", "go", "stop"]
    assert (c.ports[2].width, c.ports[2].direction, c.internals[0].width) == ("[W-1:0]", "input", "[1:0]")
    assert (c.clock, c.reset, c.active_low) == ("clk", "rst_n", True) and c.constants == ["S0"]
    assert none.ports == [] and none.clock is None and null.ports is None
    assert each(spark, lambda r: source.disable_clause(r, F.lit(None).cast("boolean")), "sys_resetn") == "disable iff (!sys_resetn)"
    assert each(spark, lambda r: source.disable_clause(r, F.lit(None).cast("boolean")), "arst") == "disable iff (arst)"
    for n, want in (("sys_clk", "sys_clk"), ("pclk", "pclk"), ("i_clock", "i_clock"), ("clk_in", "clk_in"), ("click", None)):
        assert each(spark, source.pick_clock, [n], []) == want
    assert each(spark, source.pick_clock, ["x", "y"], ["y", "x", "y"]) == "y"
    assert each(spark, source.dual_edge_clocks, "always @(posedge c) x; always @(negedge c) y;\nposedge d // negedge d") == ["c"]
    low = lambda body: each(spark, source.active_low, "r", [], [], body)
    assert low("if (r) x; if (!r) y; if (!r) z;") is True and low("") is None and low("if (r == 1'b1) x;") is False
    told = df.where("top = 'm' and code is not null").select(source.describe(F.col("top"), *[F.col(x) for x in ("ports", "internals", "constants", "clock", "reset", "active_low")]).alias("x")).first().x
    assert "clock: clk" in told and "disable iff (!rst_n)" in told


def test_mutants(spark):
    df = spark.createDataFrame([(1, MODULE), (2, ""), (3, "module x; assign y = a + b; endmodule"), (4, None)], "k int, code string")
    rows = mutation.mutants(df, "k", "code", limit=100).collect()
    found = [r for r in rows if r.k == 1]
    found.sort(key=lambda r: int(r.name.rpartition("_")[2]))
    operators = [r.operator for r in found]
    assert len({r.text for r in found}) == len(found) and all(r.text != MODULE for r in found)
    assert {"le_ge", "le_lt", "ne_eq", "and_or", "add_sub", "const_flip", "if_not", "case_swap"} <= set(operators)
    assert operators.count("case_swap") == 1 and not any("q >= a" in r.text or "q >= 0" in r.text for r in found)
    kinds = list(dict.fromkeys(operators))
    assert operators[: len(kinds)] == kinds  # one of each first
    (swap,) = [r for r in found if r.operator == "case_swap"]
    assert "2'd1: q <= a;" in swap.text and "2'd0: q <= b;" in swap.text
    (negated,) = [r for r in found if r.operator == "if_not"]
    assert "else if (!go) q" in negated.text and negated.hunk == "@@ -10,3 +10,3 @@\n     if (!rst_n) q <= 0;\n-    else if (go) q <= q + 1;\n+    else if (!go) q <= q + 1;\n   always @(posedge clk) begin"
    few = mutation.mutants(df, "k", "code", limit=8).where("k = 1").collect()
    assert {r.text for r in few} == {r.text for r in found[:8]} and mutation.mutants(df, "k", "code", limit=0).count() == 0
    assert [(r.operator, r.text) for r in rows if r.k == 3] == [("add_sub", "module x; assign y = a - b; endmodule")]
    assert {r.k for r in rows} == {1, 3}
    flips = [each(spark, mutation.flip_literal, x) for x in ("4'd0", "1'b1", "8'hFF", "8'hfe", "1'd3", "4'b9", "8'b0000_0001")]
    assert flips == ["4'd1", "1'b0", "8'hFE", "8'hff", None, None, "8'b00000000"]


def test_clip(spark):
    text = "# Intro\n" + "i" * 50 + "\n# Ports\n" + "p" * 30 + "\n# More\n" + "m" * 50
    got = each(spark, lambda t: source.clip(t, 60, "Ports"), text)
    assert got.startswith("# Ports\npppp") and "[cut to fit]" in got and each(spark, lambda t: source.clip(t, 9, "z"), "x") == "x"


def test_job_files(spark):
    why = lambda *p: each(spark, source.parameter_errors, list(p))
    assert why("A=1", "B=8'hFF", 'C="x"', "D=-1.5") is None and why("A=1", "A=2") == "a name is set twice"
    assert all(why(x).startswith("not NAME=VALUE") for x in ("A", "1A=2", "A=x y"))
    job = lambda top, files, mode="bmc", depth=20: each(spark, lambda t, f: source.job_errors(t, f, F.lit(mode), F.lit(depth)), top, files)
    assert job("m", ["m.sv"]) is None and job("1m", ["f"]) == "not a top module" and job("m", []) == "no file"
    assert (job("m", ["a/b"]), job("m", ["f"], "x"), job("m", ["f"], "bmc", 0)) == ("files need bare names", "not a mode", "no depth")
    text = each(spark, lambda t, f, p: source.job_file(t, f, p, F.lit("bmc"), F.lit(20)), "m", ["m.sv"], ["W=4"])
    assert text.splitlines()[:3] == ["[options]", "mode bmc", "depth 20"] and "chparam -set W 4 m\nprep -top m" in text


def test_design_tree(spark, tmp_path):
    def put(path, text):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)

    put("LIB/box one/box.sv", "module box(input clk); endmodule")
    put("LIB/box one/spec.md", "s")
    put("LIB/box one/include/deep/h.svh", "")
    put("LIB/box one/mutations/mutants/M_0/box.sv", "m0")
    put("LIB/box one/mutations/mutants/M_1/other.v", "m1")
    put("LIB/box one/mutations/mutants/M_2/readme.txt", "")
    put("LIB/box one/mutations/mutation_summary.json", '{"mutants": [{"mutant_id": "M_0", "log": "Mutation applied. LOR(Plus->Minus) at 3"}]}')
    put("LIB/vh/a.vhd", "entity")
    put("OTHER/two/a.v", "module q; always @(posedge c) x; always @(negedge c) y; endmodule")
    put("OTHER/two/spec.md", "s")
    put("OTHER/bad/mutations/mutation_summary.json", "{broken")
    put("OTHER/many/a.v", "x")
    put("OTHER/many/b.v", "x")
    got = {r.name: (r.key, r.top, r.language, r.mutants, r.skip_reason) for r in designs.discover(spark, f"file://{tmp_path}").collect()}
    assert got == {
        "box one": ("designs/lib/box_one", "box", "verilog", 2, None),
        "vh": ("designs/lib/vh", "a", "vhdl", 0, "VHDL"),
        "two": ("designs/other/two", "q", "verilog", 0, "both clock edges"),
        "bad": ("designs/other/bad", "bad", "unknown", 0, "no HDL"),
        "many": ("designs/other/many", "many", "unknown", 0, "multiple HDL files"),
    }
    f = designs.files(spark, f"file://{tmp_path}")
    assert designs.load_mutants(designs.mutants(f), 1).select("mutant_id").collect()[0][0] == "M_0"
    assert designs.golden_blocks(f).count() == 0
    lines = [r.line for r in designs.index(designs.discover(spark, f"file://{tmp_path}")).orderBy("ord").collect()]
    assert lines[0] == '{"designs":5,"open_ok":1,"with_mutants":1}' and len(lines) == 6
    m = {r.mutant_id: (r.operator, r.text) for r in designs.mutants(designs.files(spark, f"file://{tmp_path}")).collect()}
    assert m == {"M_0": ("LOR(Plus->Minus)", "m0"), "M_1": ("shipped", "m1")}


def test_generation(spark):
    def send(request):
        if "bad" in request["prompt"] or (request["max_tokens"] > 300 and "long" in request["prompt"]) or (request.get("grammar") and "plain" in request["prompt"]):
            raise OSError("refused")
        return f"{request['prompt']}-{request['seed']}-{request['max_tokens']}"

    jobs_ = spark.createDataFrame([(1, "ok"), (2, "bad"), (3, "long"), (4, "plain")], "job int, prompt string")
    answers = generation.samples(jobs_, send, 2, 512)
    got = {(r.job, r.sample): r.answer for r in answers.collect()}
    assert got == {(1, 0): "ok-0-512", (1, 1): "ok-1-512", (2, 0): None, (2, 1): None, (3, 0): "long-0-256", (3, 1): "long-1-256", (4, 0): "plain-0-256", (4, 1): "plain-1-256"}
    assert [r.job for r in generation.failed_jobs(answers).collect()] == [2]


def test_requests(spark):
    body = logs.messages_request([{"role": "user", "content": "x"}], "m", 5, 0.2)
    assert body["max_tokens"] == 5 and body["messages"][0]["content"] == "x"
    df = spark.createDataFrame([('{"choices": [{"message": {"content": "hi"}}]}',), ("{}",)], "r string")
    assert [r[0] for r in df.select(logs.reply_content("r")).collect()] == ["hi", None]


BLOCK = """`ifdef FORMAL
default clocking cb @(posedge clk); endclocking
// why p
// and more
property p; a |-> b; endproperty
  a_1: assert property (x) else $error("a; b: assert property (n);");
a_2: assert property (p) else begin $error("q; end"); if (x) begin $fatal; end end
assert property (q); // note ; here
/* c: cover property (z); */ c_1: cover property (w)
;
logic z;
`endif
"""


def test_statements_end_where_they_end(spark):
    got = each(spark, source.items, BLOCK)
    assert [(x.kind, x.name, x.ref, x.complete) for x in got] == [("property", "p", None, True), ("assert", "a_1", "x", True), ("assert", "a_2", "p", True), ("assert", None, "q", True), ("cover", "c_1", "w", True)]
    assert got[1].text.endswith('n);");') and got[2].text.endswith("end end")
    whole = each(spark, lambda b: F.array_join(F.transform(source.pieces(b), lambda x: x["raw"]), ""), BLOCK)
    assert whole == each(spark, source.unwrap, BLOCK)
    left = each(spark, lambda b: source.without_labels(b, F.array(F.lit("a_2"), F.lit("c_1"))), BLOCK)
    assert "a_2" not in left and "property p;" not in left and "c_1" not in left and "logic z;" in left and "assert property (q);" in left and "default clocking" in left
    cut = each(spark, source.strip_truncated, "a: assert property (x);\nlogic q; // b\nc: cover property (y\nd: assert property (z);")
    assert cut == "`ifdef FORMAL\na: assert property (x);\nlogic q; // b\n`endif\n"
    assert each(spark, source.strip_truncated, "") == "" and each(spark, source.strip_truncated, None) is None


def test_merging(spark):
    two = lambda a, b: each(spark, source.merge, a, b)
    assert two("`ifdef FORMAL\na: assert property (x);\n`endif\n", "b: cover property (y);") == "`ifdef FORMAL\na: assert property (x);\n\nb: cover property (y);\n`endif\n"
    assert two("", "b: cover property (y);") == two("b: cover property (y);", " \n") == "`ifdef FORMAL\nb: cover property (y);\n`endif\n" and two("", "") == ""


def test_canonical_text(spark):
    got = each(spark, source.canonical_or_raw, BLOCK)
    assert got.canonical and "// why p\nproperty p;" in got.text and "and more" not in got.text and "note" not in got.text and "c: cover" not in got.text and 'n);");' in got.text
    long = "// " + "w" * 200 + "\na: assert property (x);\n\n\n\n// tail\n"
    assert each(spark, source.canonical_or_raw, long).text == "`ifdef FORMAL\na: assert property (x);\n`endif\n"
    assert each(spark, source.unwrap_answer, "Sure:\n```\na: assert property (x);\n") == "`ifdef FORMAL\na: assert property (x);\n`endif\n"
    for kept in ("a: assert property (x); // as it is", "no block at all"):
        assert each(spark, source.unwrap_answer, kept) == kept
    amid = "Well.\n`ifdef FORMAL\na: assert property (x);\n`endif\nThat is a: fine; thing."
    assert each(spark, source.extract_block, amid) == "`ifdef FORMAL\na: assert property (x);\n`endif\n"


def test_comments_of_whole_documents(spark):
    """Texts with quotes, slashes and stars wherever they are, against the plain scanner."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.concat(F.lit("// "), "text", F.lit('\n"a // b" /* c\nd */ e " f'), "text").alias("t"))
    rows = docs.select("t", source.strip_comments(F.col("t")).alias("s"), source.blank_comments(F.col("t")).alias("b")).collect()
    assert all(r.s == scan.strip_comments(r.t) and r.b == scan.blank_comments(r.t) for r in rows)


def test_sites_that_were_cut(spark):
    """Conditions of any length, literals of any size, comparisons behind a conditional's colon."""
    code = "module x;\n always_comb begin\n if ( ! req[i + (a * 3) - long_name_of_a_thing + 1] ) q = s ? a : b <= 3;\n w = 64'b0000000000000000000000000000000000000001; n = 123456789012345678901234567890; end\n case (s)\n 2'd0: q <= a;\n endcase\nendmodule"
    rows = mutation.mutants(spark.createDataFrame([(1, code)], "k int, code string"), "k", "code", limit=100).collect()
    made = {(r.operator, r.description.partition(" -> ")[2]) for r in rows}
    assert ("if_not", "if (req[i + (a * 3) - long_name_of_a_thing + 1])") in made
    assert ("le_ge", ">=") in made and ("le_lt", "<") in made
    assert ("const_flip", "64'b" + "0" * 40) in made and ("const_flip", "123456789012345678901234567891") in made
    assert not any(">= a;" in r.text for r in rows)  # an assignment behind a label


def test_changes_with_lines_that_come_and_go(spark):
    import difflib
    import random

    r, pairs = random.Random(3), []
    for _ in range(60):
        a = [r.choice("abcdef") * r.randint(1, 3) for _ in range(r.randint(0, 30))]
        b = list(a)
        for _ in range(r.randint(0, 3)):
            at = r.randrange(len(b) + 1)
            b[at : at + r.randint(0, 2)] = ["new"] * r.randint(0, 2)
        pairs.append(("\n".join(a), "\n".join(b)))
    pairs += [(None, "x"), ("x", None), ("", ""), ("\n".join("abcdefgh" * 6), "\n".join("xyzuvwst" * 6))]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, a string, b string")
    got = {x.k: x.h for x in df.select("k", mutation.hunk(F.col("a"), F.col("b")).alias("h")).collect()}
    for k, (a, b) in enumerate(pairs[:60]):
        if len(list(difflib.unified_diff(a.splitlines(), b.splitlines(), n=1))) > 42:
            assert got[k] == ""
            continue
        old, new = a.splitlines(), b.splitlines()
        back, at = [], 0
        if len(got[k].splitlines()) < 12:  # whole: applied to the old lines, it gives the new ones
            for line in got[k].splitlines():
                if line.startswith("@@"):
                    start, _, n = line.split()[1][1:].partition(",")
                    to = int(start) - (n != "0")
                    back += old[at:to]
                    at = to
                elif line[0] != "-":
                    back.append(line[1:])
                    at += line[0] == " "
                else:
                    at += 1
            assert back + old[at:] == new
    assert got[60] is None and got[61] is None and got[62] == "" and got[63] == ""


def test_macros_over_texts(spark):
    """Nested, shared, repeated, looping and missing macros, against the plan-time ones."""
    files = [(1, 0, "`define A `B + `C\n`define B `C * 2 // two\n`define C 3\n`define F(x) x\n`define FLAG"), (1, 1, "`define C 4\n`define L `L x"), (2, 0, "`define C 9"), (3, 0, None)]
    texts = [(1, 1, "`A and `C `FLAG `F(1) `L"), (2, 1, ""), (3, 1, None), (4, 2, "`ifdef C\n`a_1: assert property (`C == `A);\n`endif"), (5, 3, "`C"), (6, None, "`C"), (7, 1, "no use")]
    known = macros.definitions(spark.createDataFrame(files, "g int, ord int, code string"), ["g"], "code", "ord")
    got = {r.k: r for r in macros.expanded(spark.createDataFrame(texts, "k int, g int, code string"), "k", ["g"], "code", known).withColumns({"left": macros.left_over(F.col("code")), "plain": macros.plain_labels(F.col("code"))}).collect()}
    assert len(got) == 7 and got[2].code == "" and got[3].code is None and got[7].code == "no use"
    for k, g, code in texts:
        if code and g:
            own = scan.macros("\n".join(t for x, _, t in files if x == g and t))
            assert got[k].code == scan.with_macros(code, own) and got[k].left == scan.unknown_macros(got[k].code) and got[k].plain == scan.plain_labels(got[k].code)
    assert got[1].code == "4 * 2 + 4 and 4 `FLAG `F(1) `L" + " x" * 8 and got[4].plain == "`ifdef C\na_1: assert property (9 == `A);\n`endif"
    assert macros.expanded(spark.createDataFrame(texts, "k int, g int, code string"), "k", ["g"], "code", known.where("false")).count() == 7


def test_plans_of_mutants(spark, tmp_path):
    """From a file whose size says little of what is made of it: all cores work, and neither texts nor tokens are sent to all."""
    place = str(tmp_path / "texts")
    spark.createDataFrame([(k, MODULE.replace("m #", f"m{k} #")) for k in range(40)], "k int, code string").coalesce(1).write.parquet(place)
    rows = mutation.mutants(spark.read.parquet(place), "k", "code")
    assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()
    assert rows.groupBy("k").count().where("count = 8").count() == 40
    pieces = rows.select("k", F.spark_partition_id().alias("p")).distinct()
    assert pieces.count() == 40 and pieces.select("p").distinct().count() > spark.sparkContext.defaultParallelism


def test_varied_mutants_use_all_cores(spark):
    from tracecheck.queries import text

    rows = text.varied_mutants(spark, "/root/testdata/sf0.001")
    assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()
    assert text.varied(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_duplicates_within_a_row(spark):
    """Against the rows' own joins; no block is shuffled but to put its answer together."""
    from tracecheck.queries import text

    blocks = ["a_2: assert property (x);\nproperty P_4; y; endproperty\nb: cover property (p_4);\nassert property (z);", "c: assume property (q);", "", "property p; x", None]
    kept = "A_2: assert property (k);\nproperty p_4; k; endproperty\nassert property (k);"
    df = spark.createDataFrame(list(enumerate(blocks)), "k int, b string").withColumn("kept", F.lit(kept))
    gone = source.drop_duplicates(source.statements(df, ["k"], "b"), source.statements(df, ["k"], "kept"), ["k"])[1]
    rows = df.select("k", source.items(F.col("b")).alias("f"), source.items(F.col("kept")).alias("h"))
    within = rows.select("k", F.explode(source.duplicates(F.col("f"), F.col("h"))).alias("x")).select("k", "x.text")
    assert sorted(map(tuple, within.collect())) == sorted(map(tuple, gone.select("k", "text").collect())) and within.count() == 3
    plan = text.block_edits(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan and "Scan ExistingRDD" not in plan


def test_rows_of_modules_are_spread(spark):
    """A file of a few rows is one task; the work on their texts isn't."""
    from tracecheck.queries import text

    for query in (text.varied_context, text.module_prompts, text.inject_and_strip, text.canonical_blocks, text.cone_of_blocks, text.design_context, text.format_values):
        assert query(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_a_text_is_worked_out_once_for_a_block_put_in(spark):
    """However long the text, it is stripped and masked once, and the end of its module is looked for once."""
    df = spark.createDataFrame([("`ifdef FORMAL\na\n`endif\nmodule m; // x\nendmodule\n",)], "code string")
    got = df.select(source.inject(source.strip_formal(F.col("code")), F.lit("b: assert property (q);"), F.lit("m")).alias("x"))
    assert got.first().x == "module m; // x\n\n`ifdef FORMAL\nb: assert property (q);\n`endif\nendmodule\n"
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?=\\bendmodule") == 1 and plan.count("aggregate(") == 1


def test_strip_formal_by_lines(spark):
    """Runs of lines between directives give what single lines give: empty lines, carriage returns, no last line break, open guards."""
    lines = ["", "a", "  `ifdef FORMAL", "`ifdef FORMAL\r", "`ifdef X", "`ifndef FORMAL", "`elsif Y", "`else", "`endif // e", "\f`endif", "`define Z", "x `endif", "`endiff", "\r"]
    r = random.Random(5)
    texts = ["\n".join(r.choice(lines) for _ in range(r.randint(0, 14))) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("t", source.strip_formal(F.col("t")).alias("s")).collect()
    for row in rows:
        assert row.s == _stripped_by_lines(row.t), row.t
    assert sum(row.s != row.t for row in rows) > 100


def _stripped_by_lines(text):
    guard = re.compile(r"^[ \t\x0b\f\r\n]*`ifdef[ \t\x0b\f\r]+FORMAL\b", re.M)
    if not guard.search(text):
        return text
    opened, out = [], []
    for line in text.split("\n"):
        word = (re.findall(r"^[ \t\x0b\f\r]*`(ifdef|ifndef|elsif|else|endif)\b", line) or [""])[0]
        shown, top = "f" not in opened, opened[-1] if opened else ""
        around = "f" not in opened[:-1]
        if word in ("ifdef", "ifndef"):
            guards = shown and bool(guard.match(line))
            opened.append("f" if guards else "o")
            keep = shown and not guards
        elif word and top in ("f", "k"):
            keep = word == "elsif" and top == "f" and around
            line = line.replace("`elsif", "`ifdef") if word == "elsif" and top == "f" else line
            opened[-1:] = [] if word == "endif" else [{"else": {"f": "k", "k": "f"}, "elsif": {"f": "o", "k": "f"}}[word][top]]
        else:
            keep = around if word and top == "o" else shown
            if word == "endif":
                opened[-1:] = []
        if keep:
            out.append(line)
    return "\n".join(out)


def test_pieces_of_an_answer_in_one_cut(spark):
    """What an answer's own pieces give is what the written block gives, which is cut again twice; counts are those of the items."""
    bits = ["property p; a |-> b; endproperty\n", "a_1: assert property (p);", 'b: assert property (q) else begin $display("x; end"); end\n', "\n", "  ", "; ", "// c; assert property (\n", '"x', "assert property ", "cover property (", "p)", "wire w;\n", "```verilog\n", "/* d\n", "*/", "endproperty : p", "property q", "\x01", "\x03.", "property (x)", ":"]
    r = random.Random(9)
    texts = [None, "", *("".join(r.choice(bits) for _ in range(r.randint(1, 12))) for _ in range(600))]
    t = F.col("t")
    wanted = source.pieces(source.strip_truncated(source.extract_block(t)))
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    rows = df.select("t", source.extracted_pieces(t).alias("got"), wanted.alias("wanted"), source.count_declared(t).alias("n"), F.size(source.items(t)).alias("n_items"), source.count_labelled(t).alias("m"), F.size(source.labelled(source.items(t))).alias("m_items"), F.array_join(F.transform(source.pieces(t), lambda x: x["raw"]), "").alias("whole"), source.unwrap(t).alias("inner")).collect()
    for x in rows:
        assert x.got == x.wanted and x.whole == x.inner, x.t
        assert x.t is None or (x.n, x.m) == (x.n_items, x.m_items), x.t
    assert sum(bool(x.got) and len(x.got) > 1 for x in rows) > 50


def test_comments_are_never_cut_in_two(spark):
    got = each(spark, source.items, "a: assert property (x); /* one\ntwo; */\nb: cover property (y);")
    assert [(x.name, x.text) for x in got] == [("a", "a: assert property (x); /* one\ntwo; */"), ("b", "b: cover property (y);")]
    answer = "```\na: assert property (x); /* one\ntwo */\nb: cover property (y);\n```"
    assert [x.name for x in each(spark, lambda t: source.items(source.extract_block(t)), answer)] == ["a", "b"]


def test_long_statements_are_cut(spark):
    """Runs are passed at once, so a statement's length is no depth of the pattern's."""
    long = "a: assert property (" + "x || !y && " * 20_000 + "z);\nb: cover property (y);"
    assert [x.name for x in each(spark, source.items, long)] == ["a", "b"]

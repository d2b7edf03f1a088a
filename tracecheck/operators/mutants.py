"""Mutants of modules' texts: one small change each, by rules over token rows.

Texts are cut into token rows with their place, line and bracket depth; sites are rows that a rule fits. What is around a
token comes from windows within its text. A text's sites are ranked by a digest of the text, the rule and
the place, one of each rule first, so the same text gives the same mutants wherever it is computed.
"""

from __future__ import annotations

import difflib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracecheck.sources.shared import spread

from . import source

# Rules by name, what they look for, what they put there.
SWAPS = (
    ("le_ge", "<=", ">="),
    ("ge_le", ">=", "<="),
    ("le_lt", "<=", "<"),
    ("ge_gt", ">=", ">"),
    ("eq_ne", "==", "!="),
    ("ne_eq", "!=", "=="),
    ("and_or", "&&", "||"),
    ("or_and", "||", "&&"),
    ("lt_gt", "<", ">"),
    ("gt_lt", ">", "<"),
    ("lt_le", "<", "<="),
    ("gt_ge", ">", ">="),
    ("add_sub", "+", "-"),
    ("sub_add", "-", "+"),
)
# Words of lines that are left alone, and names that are protected by default.
LEFT_ALONE = ("localparam", "parameter", "posedge", "negedge", "always", "initial", "for", "while", "repeat", "genvar", "generate")
PROTECTED = ("rst_n", "rst", "reset", "reset_n", "resetn", "clk", "clock")

# Lines of a change that are shown, and lines from which on none is.
HUNK_LINES, HUNK_MOST = 12, 40

_TOKEN = r"(?s)\s*(?:\d+'[A-Za-z]+[\w?]*|[A-Za-z_`$][\w$]*|\d+|===|!==|<<|>>|<=|>=|==|!=|&&|\|\||.)"
#: A condition of one name, with a select perhaps, as a piece of its own; what is between is cut at any place outside words.
_CONDITION = r"if\s*\(\s*!?\s*[A-Za-z_]\w*(?:\[[^\[\]]*\])?\s*\)"
_IF = rf"{_CONDITION}|(?:[^A-Za-z_0-9$]*+(?!{_CONDITION})[A-Za-z_0-9$]++){{1,64}}+|[^A-Za-z_0-9$]++"
_BLANK = " \t\n\x0b\f\r"


def tokens(texts: DataFrame, key: str, code: str, protected: tuple[str, ...] = ()) -> DataFrame:
    """(key, tok, start, stop, line, kept, depth, index, case, nth, assigned, prev, next): tokens that aren't blank, by their place.

    kept: the line has no word that is left alone; depth: open brackets of any kind; index: open square ones; case: open case
    statements; nth: the number of the outermost one; assigned: something has been assigned to in the statement before; prev,
    next: the tokens beside. No token is over a line's end, so lines are cut first. All is worked out in one order of a text's
    rows, by the last places at which something was, so they are dealt out and sorted once.
    """
    w = Window.partitionBy(key).orderBy("line", "n")
    before, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    alone = F.array(*[F.lit(x) for x in {*LEFT_ALONE, *PROTECTED, *(p.lower() for p in protected)}])
    t = texts.select(key, F.posexplode(F.split(source.mask(F.col(code)), "\n")).alias("line", "code"))
    t = t.select(key, "line", F.regexp_extract_all("code", F.lit(_TOKEN), F.lit(0)).alias("found"))
    t = t.withColumn("kept", ~F.arrays_overlap(F.transform("found", lambda x: F.lower(F.ltrim(x, F.lit(_BLANK)))), alone))
    t = t.select(key, "line", "kept", F.posexplode("found").alias("n", "raw")).withColumn("tok", F.ltrim("raw", F.lit(_BLANK)))
    opens = lambda a, b: F.when(F.col("tok").isin(*a), 1).when(F.col("tok").isin(*b), -1).otherwise(0)
    word = F.lower("tok")
    begins = word.isin("case", "casex", "casez")
    t = t.withColumns(
        {
            "start": F.coalesce(F.sum(F.length("raw")).over(before), F.lit(0)) + F.col("line") + F.length("raw") - F.length("tok"),
            "depth": F.sum(opens("([{", ")]}")).over(upto),
            "index": F.sum(opens("[", "]")).over(upto),
            "case": F.sum(F.when(begins, 1).when(word == "endcase", -1).otherwise(0)).over(upto),
        }
    ).where("tok <> ''")
    last = lambda c: F.coalesce(F.max(F.when(c, F.col("start"))).over(before), F.lit(-1))
    outside = F.col("depth") == 0
    # A colon ends a label, unless a conditional has begun in its statement.
    hard = F.col("tok").isin(";", "begin", "end", "else", "endcase") & outside
    t = t.withColumns({"hard": hard, "asked": last((F.col("tok") == "?") & outside) > last(hard)})
    ends = F.col("hard") | ((F.col("tok") == ":") & outside & ~F.col("asked"))
    t = t.withColumns(
        {
            "assigned": last(F.col("tok").isin("=", "<=") & outside) > last(ends),
            "nth": F.sum((begins & (F.col("case") == 1)).cast("int")).over(upto),
            "prev": F.lag("tok", 1, "").over(w),
            "next": F.lead("tok", 1, "").over(w),
        }
    )
    return t.select(key, "tok", "start", (F.col("start") + F.length("tok")).alias("stop"), "line", "kept", "depth", "index", "case", "nth", "assigned", "prev", "next")


def _flip_last(digits: Column) -> Column:
    """Digits of any number, in any base of an even size, with the lowest bit flipped: only the last one changes."""
    last = F.translate(F.lower(F.substring(digits, -1, 1)), "0123456789abcdef", "1032547698badcfe")
    return F.concat(F.substring(digits, F.lit(1), F.length(digits) - 1), last)


def _plain(digits: Column) -> Column:
    """Without leading zeros."""
    return F.regexp_replace(digits, "^0+(?=.)", "")


def flip_literal(text: Column) -> Column:
    """A sized literal of any length with its lowest bit flipped; null where it has more bits than its width, or the digits don't fit the base."""
    width = F.regexp_extract(text, r"^(\d+)'", 1)
    mark = F.regexp_extract(text, r"^\d+('[sS]?[bBdDhH])", 1)
    digits = F.replace(F.regexp_extract(text, r"^\d+'[sS]?[bBdDhH]([0-9a-fA-F_]+)$", 1), F.lit("_"), F.lit(""))
    base = F.lower(F.substring(mark, -1, 1))
    fits = F.when(base == "b", digits.rlike("^[01]+$")).when(base == "d", digits.rlike("^[0-9]+$")).otherwise(digits.rlike("^[0-9a-fA-F]+$"))
    new = _flip_last(digits)
    wide = F.when(width.rlike(r"^\d{1,9}$"), width).cast("int")
    plain = _plain(new)
    lead = F.length(F.bin(F.conv(F.substring(plain, 1, 1), 16, 10).cast("bigint")))
    size = F.when(base == "b", F.length(plain)).otherwise((F.length(plain) - 1) * 4 + lead)
    # A decimal number is held to the power of two where both are exact, else to its number of digits.
    exact = (F.length(plain) <= 38) & (wide <= 120)
    in_decimal = F.when(exact, F.when(F.length(plain) <= 38, plain).cast("decimal(38,0)") < F.pow(F.lit(2.0), F.least(wide, F.lit(120))).cast("decimal(38,0)")).otherwise(F.length(plain) <= F.floor(wide * 0.30102999566398) + 1)
    small = (wide == 0) | F.when(base == "d", in_decimal).otherwise((size <= wide) | (plain == "0"))
    shown = F.when(base == "d", plain).when((base == "h") & (digits == F.upper(digits)), F.upper(new)).when(base == "h", F.lower(new)).otherwise(new)
    return F.when(fits & small, F.concat(width, mark, shown))


def sites(texts: DataFrame, key: str, code: str, protected: tuple[str, ...] = ()) -> DataFrame:
    """(key, operator, parts): each change as an array of (start, stop, new), one element or two."""
    t = tokens(texts, key, code, protected)
    tok, prev, free = F.col("tok"), F.col("prev"), F.col("kept")

    def part(new: Column, start: Column | None = None, stop: Column | None = None) -> Column:
        return F.struct((F.col("start") if start is None else start).alias("start"), (F.col("stop") if stop is None else stop).alias("stop"), new.alias("new"))

    site = lambda operator, *parts: F.struct(operator.alias("operator"), F.array(*parts).alias("parts"))
    # <= outside brackets assigns, unless something has been assigned to before it in its statement.
    compares = (tok != "<=") | (F.col("depth") > 0) | F.col("assigned")
    binary = ~tok.isin("+", "-") | ((F.col("index") == 0) & prev.rlike(r"[\w\]]$"))
    rules = {old: [(n, new) for n, o, new in SWAPS if o == old] for _, old, _ in SWAPS}
    swapped = reduce(lambda c, old: c.when(tok == old, F.array(*[site(F.lit(n), part(F.lit(new))) for n, new in rules[old]])), rules, F.when(~(free & compares & binary), None))
    plain = tok.rlike(r"^\d+$") & prev.isin("=", "<=") & (F.col("next") == ";")
    new = F.when(plain, _plain(_flip_last(tok))).when((F.col("index") == 0) & tok.contains("'"), flip_literal(tok))
    flipped = F.when(free & tok.rlike(r"^\d"), F.transform(F.filter(F.array(new), lambda x: x.isNotNull()), lambda x: site(F.lit("const_flip"), part(x))))
    # Labels of outermost case statements: what stands alone before a colon.
    label = (F.col("case") == 1) & (F.col("depth") == 0) & (F.col("next") == ":") & free & tok.rlike(r"^[\w']+$") & (F.lower("tok") != "default") & prev.isin(";", "end", ")", "endcase")
    few = t.select(key, "tok", "start", "stop", "nth", F.coalesce(swapped, flipped).alias("made"), label.alias("label")).where("label or size(made) > 0")
    beside = F.lead(F.struct("tok", "start", "stop")).over(Window.partitionBy(key, "nth", "label").orderBy("start"))
    few = few.withColumn("b", F.when(F.col("label"), beside))
    arms = F.when(F.col("b.tok") != tok, F.array(site(F.lit("case_swap"), part(F.col("b.tok")), part(tok, F.col("b.start"), F.col("b.stop")))))
    none = F.array().cast("array<struct<operator: string, parts: array<struct<start: bigint, stop: bigint, new: string>>>>")
    made = few.select(key, F.explode(F.concat(F.coalesce("made", none), F.coalesce(arms, none))).alias("s")).select(key, "s.operator", "s.parts")
    return made.unionByName(polarity(texts, key, code, protected))


def polarity(texts: DataFrame, key: str, code: str, protected: tuple[str, ...] = ()) -> DataFrame:
    """(key, operator, parts): each `if` over one name or its select, turned round."""
    alone = F.array(*[F.lit(x) for x in {*LEFT_ALONE, *PROTECTED, *(p.lower() for p in protected)}])
    masked = source.mask(F.col(code))
    kept = F.transform(F.split("__masked", "\n"), lambda x: ~F.arrays_overlap(F.transform(F.regexp_extract_all(x, F.lit(r"(?<![\w$`])[\w$]+"), F.lit(0)), F.lower), alone))
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    t = texts.select(key, masked.alias("__masked")).where(F.col("__masked").rlike(_CONDITION))
    t = t.select(key, kept.alias("kept"), F.posexplode(F.regexp_extract_all("__masked", F.lit(_IF), F.lit(0))).alias("pos", "tok"))
    t = t.withColumns({"start": F.coalesce(F.sum(F.length("tok")).over(before), F.lit(0)), "line": F.coalesce(F.sum(F.regexp_count("tok", F.lit("\n"))).over(before), F.lit(0))})
    name = F.regexp_replace(F.regexp_extract("tok", r"(?s)^if\s*\(\s*!?\s*(.*)\)$", 1), r"\s+$", "")
    new = F.concat(F.lit("if ("), F.when(F.col("tok").rlike(r"^if\s*\(\s*!"), "").otherwise("!"), name, F.lit(")"))
    part = F.struct("start", (F.col("start") + F.length("tok")).alias("stop"), new.alias("new"))
    return t.where(F.col("tok").rlike(r"^if\s*\(") & F.element_at("kept", (F.col("line") + 1).cast("int"))).select(key, F.lit("if_not").alias("operator"), F.array(part).alias("parts"))


def changed(text: Column, parts: Column) -> Column:
    """The text with the parts replaced; they come in order."""
    done = F.aggregate(
        parts,
        F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at")),
        lambda s, p: F.struct(F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), (p["start"] - s["at"]).cast("int")), p["new"]).alias("out"), p["stop"].cast("bigint").alias("at")),
    )
    return F.concat(done["out"], F.substring(text, (done["at"] + 1).cast("int"), F.length(text)))


def hunk(before: Column, after: Column) -> Column:
    """What changed between two texts: lines aligned with their common ones, one line of context; at most HUNK_LINES lines
    of at most HUNK_MOST, else nothing."""

    def one(a: str | None, b: str | None) -> str | None:
        if a is None or b is None:
            return None
        old, new = a.splitlines(), b.splitlines()
        at = [i for i, (x, y) in enumerate(zip(old, new, strict=False)) if x != y] if len(old) == len(new) < 200 else []
        if len(at) == 1 and old[at[0]] not in new and new[at[0]] not in old:  # one line for another: it can't be aligned otherwise
            first, last = max(0, at[0] - 1), min(len(old), at[0] + 2)
            place = f"{first + 1},{last - first}" if last - first != 1 else f"{first + 1}"
            return "\n".join([f"@@ -{place} +{place} @@", *(f" {x}" for x in old[first : at[0]]), f"-{old[at[0]]}", f"+{new[at[0]]}", *(f" {x}" for x in old[at[0] + 1 : last])])
        lines = list(difflib.unified_diff(old, new, lineterm="", n=1))[2:]
        return "\n".join(lines[:HUNK_LINES]) if len(lines) <= HUNK_MOST else ""

    def each(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=object)

    return F.pandas_udf(each, T.StringType())(before, after)


def mutants(texts: DataFrame, key: str, code: str, limit: int = 8, protected: tuple[str, ...] = ()) -> DataFrame:
    """(key, name, operator, description, hunk, text): at most `limit` different mutants of each text without formal blocks.

    One of each rule comes first. key: a column that tells the texts apart.
    """
    # Dealt out once by the key: sites, texts and ranks stay where their text is. Texts are never sent to all, whatever their
    # table's size on disk says.
    body = spread(texts.select(key, F.col(code).alias("__body")), key).withColumn("__body", source.strip_formal(F.col("__body")))
    place = F.md5(F.concat_ws(":", F.md5("__body"), "operator", F.col("parts")[0]["start"].cast("string")))
    made = sites(body, key, "__body", protected).join(body.hint("merge"), key).withColumns({"__place": place, "text": changed(F.col("__body"), F.col("parts"))})
    same = F.row_number().over(Window.partitionBy(key, "text").orderBy("__place"))
    made = made.where("text <> __body").withColumn("__same", same).where("__same = 1")
    later = F.row_number().over(Window.partitionBy(key, "operator").orderBy("__place")) > 1
    rank = F.row_number().over(Window.partitionBy(key).orderBy("__later", "__place"))
    ranked = made.withColumn("__later", later).withColumn("__rank", rank).where(F.col("__rank") <= max(0, limit))
    old = F.substring(F.col("__body"), (F.col("parts")[0]["start"] + 1).cast("int"), (F.col("parts")[0]["stop"] - F.col("parts")[0]["start"]).cast("int"))
    return ranked.select(
        key,
        F.concat_ws("_", "operator", (F.col("__rank") - 1).cast("string")).alias("name"),
        "operator",
        F.concat(old, F.lit(" -> "), F.col("parts")[0]["new"]).alias("description"),
        hunk(F.col("__body"), F.col("text")).alias("hunk"),
        "text",
    )

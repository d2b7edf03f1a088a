"""Hardware source text in columns and rows: comments, blocks of properties, modules, prompts and job files.

Everything is built of Spark's own string and array functions, a text at a time inside its row, so nothing is shuffled;
only `drop_duplicates` joins statement rows, for blocks that lie in different rows (`duplicates`: in one).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A string, a line comment, a block comment (which may not end), or other text.
_PIECE = r'"[^"\\\n]*+(?:\\[^\n][^"\\\n]*+)*+"?|//[^\n]*+|/\*(?s:.*?)(?:\*/|\z)|[^"/]++|/'
_NAME = r"[A-Za-z_]\w*"


def _found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _let(value: Column, use) -> Column:
    """use(value), with the value worked out once: a lambda's variable stands for it wherever it is used."""
    return F.transform(F.array(value), use)[0]


def _where(text: Column, pattern: str, use) -> Column:
    """use(text) where the pattern is found; other texts stay as they are."""
    return _let(text, lambda t: F.when(t.rlike(pattern), use(t)).otherwise(t))


def _pieces(text: Column, change) -> Column:
    return F.array_join(F.transform(_found(text, _PIECE), change), "")


def strip_comments(text: Column) -> Column:
    """A line comment goes; a block comment leaves one space; strings are left alone."""
    return _pieces(text, lambda p: F.when(p.startswith("//"), "").when(p.startswith("/*"), " ").otherwise(p))


def blank_comments(text: Column) -> Column:
    """Comments become spaces, so all places and line breaks stay."""
    return _pieces(text, lambda p: F.when(p.startswith("//") | p.startswith("/*"), F.regexp_replace(p, r"[^\n]", " ")).otherwise(p))


def mask(text: Column) -> Column:
    """Comments and strings become spaces."""
    return _where(text, '["/]', lambda t: _pieces(t, lambda p: F.when(p.startswith("//") | p.startswith("/*") | p.startswith('"'), F.regexp_replace(p, r"[^\n]", " ")).otherwise(p)))


def slug(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(F.btrim(text)), "[^a-z0-9]+", "_"), F.lit("_"))


def _trimmed(text: Column) -> Column:
    """text without blanks and line breaks at its ends."""
    return F.regexp_extract(text, r"(?s)\A[ \t\r\n]*+(.*[^ \t\r\n])", 1)


# --- conditional text ---


def strip_formal(text: Column) -> Column:
    """Without what `ifdef FORMAL guards; what its else branch holds stays.

    One pass over directives and the runs of lines between them, with a stack of open directives: o for another one, f while
    FORMAL's own branch is open, k in a branch beside it. A text that guards nothing is left as it is.
    """
    guard = r"^\s*`ifdef\s+FORMAL\b"
    directive = r"[^\S\n]*+`(?:ifdef|ifndef|elsif|else|endif)\b"

    def step(state: Column, line: Column) -> Column:
        opened = state["open"]
        shown = ~F.array_contains(opened, "f")
        out = lambda keep, new: F.when(keep, F.concat(state["out"], F.array(new))).otherwise(state["out"])
        same = F.struct(opened.alias("open"), out(shown, line).alias("out"))

        def directed(x: Column) -> Column:
            word, guards, top, below = x["word"], x["guards"], x["top"], x["below"]
            around = ~F.array_contains(below, "f")
            push = lambda x, stack=opened: F.concat(stack, F.array(F.lit(x)))
            stack = (
                F.when(guards, push("f"))
                .when(word.isin("ifdef", "ifndef"), push("o"))
                .when(word == "endif", below)
                .when((word == "else") & (top == "f"), push("k", below))
                .when((word == "else") & (top == "k"), push("f", below))
                .when((word == "elsif") & (top == "f"), push("o", below))
                .when((word == "elsif") & (top == "k"), push("f", below))
                .otherwise(opened)
            )
            ends = word.isin("endif", "else", "elsif")
            keep = F.when(guards, F.lit(False)).when(ends & top.isin("f", "k"), (word == "elsif") & (top == "f") & around).when(ends & (top == "o"), around).otherwise(shown)
            new = F.when((word == "elsif") & (top == "f"), F.replace(line, F.lit("`elsif"), F.lit("`ifdef"))).otherwise(line)
            return F.struct(stack.alias("open"), out(keep, new).alias("out"))

        known = F.struct(
            F.regexp_extract(line, r"^\s*`(ifdef|ifndef|elsif|else|endif)\b", 1).alias("word"),
            (shown & line.rlike(guard)).alias("guards"),
            F.coalesce(F.try_element_at(opened, F.lit(-1)), F.lit("")).alias("top"),
            F.slice(opened, 1, F.greatest(F.size(opened) - 1, F.lit(0))).alias("below"),
        )
        return F.when(F.ltrim(line, F.lit(" \t\n\x0b\f\r")).startswith("`"), _let(known, directed)).otherwise(same)

    start = F.struct(F.array().cast("array<string>").alias("open"), F.array().cast("array<string>").alias("out"))
    # Each line ends with a line break here, the last one too; that one goes again.
    runs = lambda t: _found(F.concat(t, F.lit("\n")), rf"{directive}[^\n]*+\n|(?:(?!\z|{directive})[^\n]*+\n)++")
    whole = lambda t: F.regexp_replace(F.array_join(F.aggregate(runs(t), start, step, lambda s: s["out"]), ""), r"\n\z", "")
    return _let(text, lambda t: F.when(t.rlike("(?m)" + guard), whole(t)).otherwise(t))


def unwrap(block: Column) -> Column:
    """The inside of `ifdef FORMAL ... `endif, or the text."""
    inside = lambda b: F.regexp_extract(b, r"(?s)(?:^|\n)[ \t]*`ifdef[ \t]+FORMAL\b[^\n]*\n(.*)\n[ \t]*`endif\b", 1)
    return _let(block, lambda b: _let(inside(b), lambda x: _trimmed(F.when(x == "", b).otherwise(x))))


def wrap(body: Column) -> Column:
    whole = lambda t: F.when(t == "", "").when(t.startswith("`ifdef FORMAL"), F.concat(t, F.lit("\n"))).otherwise(F.concat(F.lit("`ifdef FORMAL\n"), t, F.lit("\n`endif\n")))
    return _let(_trimmed(body), whole)


# --- statements of a block ---

# Patterns over text as it stands. A comment or a string counts as a blank and is passed whole, so what is in it ends or starts
# nothing. Runs are passed at once, up to the letters at which something can start or end, and none is given back.
_SKIP = r'(?:"[^"\\\n]*+(?:\\[^\n][^"\\\n]*+)*+"?+|//[^\n]*+|/\*(?:[^*]+|\*(?!/))*+(?:\*/|\z))'
_OTHER = rf"{_SKIP}|/(?![/*])"
_ANY = rf"(?:[ \t\r\n]+|{_SKIP})*+"
_S = rf"(?:\s+|{_SKIP})*+"
_SS = rf"(?:\s+|{_SKIP})++"
_T = rf"(?:[ \t]+|{_SKIP})*+"
_WORD = r"[A-Za-z_](?>\w*)"
_KIND = rf"(?i:assert|assume|cover){_SS}(?i:property)"
_LABEL, _KEYWORD_OF = rf"(?:({_WORD}){_S}:{_S})?", "((?i:assert|assume|cover))"
#: Heads keep their groups: label, keyword, name. `_plain` is for places where nothing is kept.
_HEAD = rf"{_LABEL}\b{_KEYWORD_OF}{_SS}(?i:property){_S}\("
_DECLARED = rf"\b(?i:property){_SS}({_WORD}){_S}[;\(]"
_PROPERTY = rf'{_DECLARED}(?:[^yY"/]+|(?!(?<=\b(?i:endpropert))[yY]\b)[yY]|{_OTHER})*+([yY])(?:{_T}:{_T}\w+)?(?:{_T};)?'
#: else begin ... end, with one more begin ... end inside it at most.
_WORDS = rf'(?:[^bBeE"/]+|(?!\b(?i:begin|end)\b)[bBeE]|{_OTHER})*+'
_BEGIN = rf"\){_S}(?i:else){_SS}(?i:begin)\b{_WORDS}(?:\b(?i:begin)\b{_WORDS}\b(?i:end)\b{_WORDS})*+\b(?i:end)\b"
_UNTIL = rf"(?!{_BEGIN})\)|{_OTHER})*+(;|{_BEGIN}(?:{_T};)?)"


def _plain(pattern: str) -> str:
    """A pattern without groups."""
    return re.sub(r"(?<!\\)\((?!\?)", "(?:", pattern)


# The word property tells of another declaration; most statements don't have it again.
_STATEMENT = rf'{_HEAD}(?:(?={_S}({_WORD}){_S}\))|)(?:(?:[^;)"/yY]+|(?<!(?i:propert))[yY]|{_UNTIL}|(?:[^;)"/aAcCpP]+|(?!\b{_plain(_KIND)}\b|{_plain(_DECLARED)})[aAcCpP]|{_UNTIL})'
_STARTS = rf"(?:{_plain(_HEAD)}|\b(?i:property){_SS}[A-Za-z_])"
_LEAD = rf"(?:(?:(?<=\n)|\A)(?:[ \t]+|{_SKIP})++)?"
_CUT_OFF = rf"(?:{_HEAD}|\b(?i:property){_SS}({_WORD}))(?s:.*)\z"
#: A head without its parenthesis starts nothing, but counts as a statement that isn't complete where a piece begins with it.
_LOOSE = rf"{_ANY}{_LABEL}{_KEYWORD_OF}{_SS}(?i:property)\b(?!{_S}(?:[\(A-Za-z_]|:{_S}{_plain(_KIND)}{_S}\())"
# Where nothing starts with a word, nothing starts inside it.
_CUT = (
    rf"{_LEAD}(?:{_PROPERTY}|{_STATEMENT}|{_CUT_OFF})(?:{_T}\n)?"
    rf"|(?:{_LOOSE}|{_SKIP}|(?s:.))(?:(?<!\w)(?!{_LEAD}{_STARTS})[A-Za-z_]\w*|(?!{_LEAD}{_STARTS})(?:{_SKIP}|(?s:.)))*+"
)
#: What comes before a piece: the keyword of a loose head, a property's name, a statement's label and keyword, what it refers to if
#: its head tells, and twice what ends it, where it is complete.
_MARKS = "\x01$12\x02$1$10\x02$3$8$11\x02$4$9$12\x02$5\x02$2$6\x02$7\x02$0"
ITEM = "struct<kind: string, name: string, ref: string, complete: boolean, text: string>"


def _cut(text: Column) -> Column:
    """A text in pieces: each declaration, with the blanks in front of it and the line break behind it, and what lies between
    them. All pieces together are the text.

    One pass of one pattern writes what it found in front of each piece (_MARKS). Characters of the text that stand for marks are
    written otherwise until `_raw`; what they are written as is neither a word's nor a blank nor an end either.
    """
    away = lambda t: F.replace(F.replace(F.replace(t, F.lit("\x03"), F.lit("\x03,")), F.lit("\x01"), F.lit("\x03.")), F.lit("\x02"), F.lit("\x03-"))
    marked = F.split(F.regexp_replace(_where(text, "[\x01-\x03]", away), _CUT, _MARKS), "\x01")
    return _let(marked, lambda m: F.slice(m, 2, F.size(m)))


def _raw(escaped: Column) -> Column:
    """The last field of a piece of `_cut` as it stands in the text."""
    back = lambda t: F.replace(F.replace(F.replace(t, F.lit("\x03-"), F.lit("\x02")), F.lit("\x03."), F.lit("\x01")), F.lit("\x03,"), F.lit("\x03"))
    return F.when(escaped.contains("\x03"), back(escaped)).otherwise(escaped)


def _text(piece: Column) -> Column:
    return _raw(F.substring_index(piece, "\x02", -1))


def _declares(piece: Column) -> Column:
    return ~piece.startswith("\x02\x02\x02\x02")


def _has_label(piece: Column) -> Column:
    """Whether a piece is a statement with a label."""
    return F.when(piece.startswith("\x02"), piece.startswith("\x02\x02") & ~piece.startswith("\x02\x02\x02")).otherwise(piece.rlike("\\A\\w+\x02\x02\\w"))


def _fields(cut: Column, put=lambda raw, last: raw) -> Column:
    """The pieces of `_cut` as structs, like ITEM with `raw` instead of `text`; put(raw, last): as what a raw is handed on. What is
    asked once is not put by: each step of an array copies it."""
    null = F.lit(None).cast("string")
    about = rf"(?i:property){_S}\({_S}({_WORD}){_S}\)"
    sought = lambda raw: F.regexp_extract(raw, rf'\A(?:[^pP"/]+|(?!{_plain(about)})[pP]|{_OTHER})*+{about}', 1)
    ended = lambda raw: _trimmed(mask(raw)).rlike(r"(?i)\bendproperty\b(?:[ \t]*:[ \t]*\w+)?(?:[ \t]*;)?\z")

    def item(m: Column, inside: Column) -> Column:
        own, label, word, ref, done, more = (m[k] for k in range(1, 7))
        named, statement = own != "", word != ""
        raw = _raw(m[7])
        # What a head doesn't tell may still come, if the word does.
        later = (ref == "") & ((done == "") | F.lower(done).contains("property"))
        return F.struct(
            F.when(named, "property").when(statement, F.lower(word)).alias("kind"),
            F.when(named, own).when(statement & (label != ""), label).otherwise(null).alias("name"),
            F.when(statement, F.nullif(F.when(later, sought(raw)).otherwise(ref), F.lit(""))).alias("ref"),
            F.when(named, inside | (done != "") | ended(raw)).when(statement, inside | (done != "") | (more != "")).otherwise(F.lit(False)).alias("complete"),
            put(raw, ~inside).alias("raw"),
        )

    return _let(F.transform(cut, lambda x: F.split(x, "\x02")), lambda x: F.transform(x, lambda m, i: item(m, i + 1 < F.size(x))))


def pieces(block: Column) -> Column:
    """A block's whole inner text in pieces, in order: its declarations (kind, name, ref, complete as in ITEM) with `raw`, and
    what lies between them (kind null). raw is the piece as it stands."""
    return _fields(_cut(unwrap(block)))


def items(block: Column) -> Column:
    """The declarations of a block, in order, as ITEM: kind (property, assert, assume, cover), name (null without a label),
    the property it refers to, whether it is complete, and its text."""
    return declared(pieces(block))


def declared(parts: Column) -> Column:
    """The declarations among a block's pieces, as ITEM."""
    found = F.filter(parts, lambda x: x["kind"].isNotNull())
    return F.transform(found, lambda x: F.struct(*[x[f].alias(f) for f in ("kind", "name", "ref", "complete")], _trimmed(x["raw"]).alias("text")))


def rest(block: Column, stays) -> Column:
    """The block without the declarations for which stays(item) is false; all other text is left as it is."""
    return rest_of(pieces(block), stays)


def rest_of(parts: Column, stays) -> Column:
    """The same of a block's pieces."""
    return joined(F.filter(parts, lambda x: x["kind"].isNull() | F.coalesce(stays(x), F.lit(True))))


def joined(parts: Column) -> Column:
    """Pieces as a block again."""
    return wrap(F.array_join(F.transform(parts, lambda x: x["raw"]), ""))


def _breaks_off(parts: Column) -> Column:
    return F.exists(parts, lambda x: x["kind"].isNotNull() & ~x["complete"])


def strip_truncated(block: Column) -> Column:
    """The block up to its first declaration that breaks off."""
    # Only the last piece can break off.
    kept = lambda cut: F.when(_breaks_off(_fields(F.slice(cut, -1, 1))), F.slice(cut, 1, F.size(cut) - 1)).otherwise(cut)
    whole = lambda cut: wrap(F.array_join(F.transform(_let(cut, kept), _text), ""))
    return _let(_cut(unwrap(block)), lambda cut: F.when(F.size(cut) > 0, whole(cut)).when(cut.isNotNull(), ""))


def without_labels(block: Column, labels: Column) -> Column:
    """The block without the statements of these labels (in lower case), and without properties that none refers to any more."""
    return _let(pieces(block), lambda p: thinned(p, labels))


def thinned(parts: Column, labels: Column) -> Column:
    """The same of a block's pieces, which are asked more than once."""
    return joined(thinned_parts(parts, labels))


def thinned_parts(parts: Column, labels: Column) -> Column:
    """The pieces that stay then."""
    name = lambda x, field="name": F.lower(F.coalesce(x[field], F.lit("")))
    stays = lambda x: F.coalesce(~F.array_contains(labels, name(x)), F.lit(False))
    used = F.transform(F.filter(parts, lambda x: x["kind"].isNotNull() & (x["kind"] != "property") & stays(x)), lambda x: name(x, "ref"))
    return _let(used, lambda u: F.filter(parts, lambda x: F.when(x["kind"].isNull(), True).when(x["kind"] == "property", F.array_contains(u, name(x))).otherwise(stays(x))))


def merge(kept: Column, fresh: Column) -> Column:
    """Two blocks as one: the first one's text, an empty line, the second one's; an empty block adds nothing."""
    inner = F.filter(F.array(*[F.coalesce(unwrap(x), F.lit("")) for x in (kept, fresh)]), lambda x: x != "")
    return wrap(F.array_join(inner, "\n\n"))


def written(parts: Column) -> Column:
    """Items as a block again."""
    return wrap(F.array_join(F.transform(parts, lambda x: x["text"]), "\n"))


def complete(parts: Column) -> Column:
    """Without what was cut off."""
    return F.filter(parts, lambda x: x["complete"])


def labelled(parts: Column) -> Column:
    """The statements that have a label."""
    return F.filter(parts, lambda x: (x["kind"] != "property") & x["name"].isNotNull())


def count_declared(block: Column) -> Column:
    """How many declarations a block has: the size of its `items`."""
    return F.size(F.filter(_cut(unwrap(block)), _declares))


def count_labelled(block: Column) -> Column:
    """How many statements with a label a block has: the size of `labelled` of its `items`."""
    return F.size(F.filter(_cut(unwrap(block)), _has_label))


def has_kind(block: Column, *kinds: str) -> Column:
    return F.exists(items(block), lambda x: x["kind"].isin(*kinds) & x["name"].isNotNull())


def statements(blocks: DataFrame, by: list[str], block: str) -> DataFrame:
    """A row for each declaration of each block: by, ord, and the fields of ITEM."""
    return blocks.select(*by, F.posexplode(items(F.col(block))).alias("ord", "item")).select(*by, "ord", "item.*")


def drop_duplicates(fresh: DataFrame, kept: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Statement rows of `fresh` whose block doesn't declare them in `kept` already, nor refer to such a property; and the others.

    Names are compared without case, within the rows of equal `by`.
    """
    is_property = F.col("kind") == "property"
    own = fresh.withColumn("__name", F.lower("name")).withColumn("__ref", F.lower("ref")).withColumn("__prop", is_property)
    have = kept.select(*by, F.lower("name").alias("__name"), is_property.alias("__prop"), F.lit(True).alias("__again")).distinct()
    again = own.join(have, [*by, "__name", "__prop"], "left")
    lost = again.where("__again and __prop").select(*by, F.col("__name").alias("__ref"), F.lit(True).alias("__lost")).distinct()
    both = again.join(lost, [*by, "__ref"], "left").withColumn("__gone", F.coalesce("__again", "__lost", F.lit(False)))
    return tuple(both.where("__gone" if gone else "not __gone").select(*fresh.columns) for gone in (False, True))


def duplicates(fresh: Column, kept: Column) -> Column:
    """`drop_duplicates` within a row: the items of `fresh` that `kept` declares already, or that refer to such a property."""
    has = lambda names, name: F.coalesce(F.array_contains(names, name), F.lit(False))
    named = lambda properties: F.transform(F.filter(kept, lambda x: ((x["kind"] == "property") == properties) & x["name"].isNotNull()), lambda x: F.lower(x["name"]))
    again = lambda h, x: has(F.when(x["kind"] == "property", h["properties"]).otherwise(h["others"]), F.lower(x["name"]))
    lost = lambda h: F.transform(F.filter(fresh, lambda x: (x["kind"] == "property") & again(h, x)), lambda x: F.lower(x["name"]))
    have = F.struct(named(True).alias("properties"), named(False).alias("others"))
    return _let(have, lambda h: _let(lost(h), lambda gone: F.filter(fresh, lambda x: again(h, x) | has(gone, F.lower(x["ref"])))))


def strip_labels(parts: Column, labels: Column) -> Column:
    """Items without the statements of these labels (in lower case), and without properties that none refers to any more."""
    left = F.filter(parts, lambda x: (x["kind"] == "property") | ~F.array_contains(labels, F.lower(F.coalesce(x["name"], F.lit("")))))
    used = lambda found: F.transform(found, lambda x: F.lower(F.coalesce(x["ref"], F.lit(""))))
    return _let(left, lambda found: _let(used(found), lambda u: F.filter(found, lambda x: (x["kind"] != "property") | F.array_contains(u, F.lower(x["name"])))))


_HAS_STATEMENT = r"[A-Za-z_](?>\w*\s*):\s*+(?i:assert|assume|cover)\s++(?i:property)\s*+\("
_GUARDED = r"(?is)^[ \t]*`ifdef[ \t]+FORMAL\b.*?^[ \t]*`endif\b[^\n]*"
_CODE_LINE = r"(?i)^\s*(?:default\s+(?:clocking|disable)\b|`(?:define|undef|ifdef|ifndef|elsif|else|endif)\b|(?:localparam|parameter|wire|logic|reg|bit|integer)\b[^;]*;)"


def _extracted(answer: Column, use) -> Column:
    """use(cut) of the pieces of the text in an answer that holds its statements."""
    plain = lambda t: F.regexp_replace(t, r"<(?i:think)>(?:[^<]+|<(?!/(?i:think)>))*+(?:</(?i:think)>|\z)", "")
    thought = lambda t: F.regexp_extract(t, r"(?is)<think>(.*?)(?:</think>|\z)", 1)
    with_statement = lambda found: F.try_element_at(F.filter(found, lambda x: x.rlike(_HAS_STATEMENT)), F.lit(1))
    fenced = lambda t: with_statement(_found(t, r"```[A-Za-z]*[ \t]*\n((?:[^`]+|`(?!``))*+)(?:```|\z)", 1))
    guarded = lambda t: with_statement(_found(t, "(?m)" + _GUARDED))
    inside = lambda t: F.coalesce(fenced(t), guarded(t), F.regexp_replace(t, r"```[A-Za-z]*", ""))
    text = _let(plain(answer), lambda p: F.when(p.rlike(_HAS_STATEMENT), p).otherwise(thought(answer)))
    return _let(text, lambda t: _let(inside(t), lambda i: _let(_cut(unwrap(i)), use)))


def _written_from(cut: Column) -> Column:
    """Lines of code between declarations, and the declarations, a line each at least."""
    between = F.array_join(F.transform(F.filter(cut, lambda x: ~_declares(x)), _text), "")
    other = lambda text: F.filter(F.split(strip_comments(text), "\n"), lambda x: x.rlike(_CODE_LINE))
    # Where all pieces are declarations, nothing is between them.
    around = lambda parts: F.when(F.size(parts) == F.size(cut), "").otherwise(F.array_join(_let(between, other), "\n"))
    body = lambda parts: F.concat_ws("\n", around(parts), F.array_join(F.transform(parts, lambda x: _trimmed(_text(x))), "\n"))
    return wrap(_let(F.filter(cut, _declares), body))


def extract_block(answer: Column) -> Column:
    """The block in a model's answer; null if there is none.

    From the first fence with a statement (one that isn't closed goes to the end), else from the first guarded block amid
    prose, else from bare text. Reasoning is left out unless only it holds statements. Prose around the statements goes.
    """
    return _extracted(answer, lambda cut: F.when(F.exists(cut, _has_label), _written_from(cut)))


def extracted_pieces(answer: Column) -> Column:
    """`pieces` of `strip_truncated` of `extract_block`.

    Where an answer's text is declarations alone, without comments, these are its own pieces, a line each: they are written a line
    each, and nothing of them reads otherwise for it. Other texts are written and cut again.
    """

    # A piece in the way is a line already, or it is made one.
    lined = lambda raw, last: F.when(last, _trimmed(raw)).when(raw.rlike(r"\A\w[^\n]*[\w;]\n\z"), raw).otherwise(F.concat(_trimmed(raw), F.lit("\n")))
    kept = lambda cut: F.when(_breaks_off(_fields(F.slice(cut, -1, 1))), F.slice(cut, 1, F.size(cut) - 1)).otherwise(cut)
    same = lambda cut: _let(kept(cut), lambda x: _fields(x, lined))
    ends = lambda x: ~F.rtrim(_text(x), F.lit(" \t\r\n")).endswith('"')
    plain = lambda cut: F.forall(cut, lambda x: x.startswith("\x02") & _declares(x) & ~x.contains("/")) & F.forall(F.slice(cut, F.greatest(F.size(cut) - 1, F.lit(1)), 2), ends)
    again = lambda cut: pieces(strip_truncated(_written_from(cut)))
    return _extracted(answer, lambda cut: F.when(F.exists(cut, _has_label), F.when(plain(cut), same(cut)).otherwise(again(cut))))


# Fixed value: the longest comment line that is kept above a declaration.
_HEADER = 120


def canonical(block: Column) -> Column:
    """The block without its comments, but for the first line of a short run of comment lines right above code; complete only.

    At most one empty line is left in a row.
    """
    comment = r"^\s*//"
    code = r"(?i)^\s*(?:property\b|[A-Za-z_]\w*\s*:|assert\b|assume\b|cover\b|default\b)"

    def lines(inner: Column) -> Column:
        both = F.arrays_zip(F.split(inner, "\n").alias("a"), F.split(blank_comments(inner), "\n").alias("b"))
        return F.transform(both, lambda x: F.struct(F.rtrim(F.when(x["a"].rlike(comment), x["a"]).otherwise(x["b"])).alias("t"), x["a"].rlike(comment).alias("c")))

    def thinned(found: Column) -> Column:
        # From the end: what is the next line of code below each line.
        start = F.struct(F.array().cast("array<string>").alias("heads"), F.lit("").alias("head"))
        step = lambda x, y: _let(F.when(~y["c"] & (y["t"] != ""), y["t"]).otherwise(x["head"]), lambda h: F.struct(F.concat(F.array(x["head"]), x["heads"]).alias("heads"), h.alias("head")))
        heads = F.aggregate(F.reverse(found), start, step, lambda x: x["heads"])
        leads = lambda x, i, h: (F.length(x["t"]) <= _HEADER) & h[i].rlike(code) & ((i == 0) | ~found[F.greatest(i - 1, F.lit(0))]["c"])
        kept = lambda h: F.filter(found, lambda x, i: ~x["c"] | leads(x, i, h))
        return F.array_join(F.transform(_let(heads, kept), lambda x: x["t"]), "\n")

    return wrap(F.regexp_replace(_let(_let(unwrap(strip_truncated(block)), lines), thinned), r"\n{3,}", "\n\n"))


def canonical_or_raw(block: Column) -> Column:
    """struct(text, canonical): the canonical text, or the block as it was if its declarations wouldn't be the same (blanks and
    comments aside)."""
    declared = lambda x: F.transform(complete(items(strip_comments(x))), lambda y: F.regexp_replace(y["text"], r"\s+", ""))
    same = lambda clean: F.coalesce(declared(clean) == declared(block), F.lit(False))
    return _let(canonical(block), lambda clean: _let(same(clean), lambda ok: F.struct(F.when(ok, clean).otherwise(block).alias("text"), ok.alias("canonical"))))


def unwrap_answer(answer: Column) -> Column:
    """A text that may be a block already, or a model's answer: the block if there is one, else the text as it is."""
    whole = lambda t: F.exists(items(t), lambda x: x["kind"] != "property") & ~t.rlike(r"```|(?i)</?think>")
    return _let(answer, lambda t: F.when(whole(t), t).otherwise(F.coalesce(extract_block(t), t)))


# --- modules ---


def module_names(text: Column) -> Column:
    return _found(mask(text), rf"\bmodule\s+({_NAME})", 1)


def inject(text: Column, block: Column, top: Column) -> Column:
    """The block before the endmodule of `top`; null if the block is empty or the module isn't there or doesn't end."""
    pattern = F.concat(F.lit(r"(?s)^.*?\bmodule\s+"), top, F.lit(r"\b.*?(?=\bendmodule\b)"))
    head = lambda t: F.length(F.call_function("regexp_extract", mask(t), pattern, F.lit(0)))
    there = lambda h: (h > 0) & (F.btrim(strip_comments(block), F.lit(" \t\r\n")) != "")
    before = lambda t, h: F.rtrim(F.substring(t, F.lit(1), h), F.lit("\n"))
    whole = lambda t, h: F.when(there(h), F.concat(before(t, h), F.lit("\n\n"), wrap(block), F.substring(t, h + 1, F.length(t))))
    return _let(text, lambda t: _let(head(t), lambda h: whole(t, h)))


# Names that are taken for a clock, for a reset, and for a reset that is active when low.
CLOCK = r"(?i)^(?:\w*_)?[a-z]{0,2}cl(?:k|ock)(?:_?i|_?in)?$"
RESET = r"(?i)^(?:\w*_)?n?[as]?(?:rst|reset)n?(?:_n|_ni|_n_i|_i|_b)?$"
LOW = r"(?i)^(?:\w*_)?(?:n[as]?(?:rst|reset)|[as]?(?:rst|reset)(?:n|_n|_ni|_n_i|_b))$"

_KEYWORD = r"\b(?:input|output|inout|wire|reg|logic|integer|int|bit|signed|unsigned|var|tri|localparam)\b"


def _names(text: Column) -> Column:
    """Identifiers of a list of declarators, without keywords, ranges and values."""
    return _found(F.regexp_replace(text, rf"\[[^\]]*\]|{_KEYWORD}|=[^,;]*", " "), _NAME)


def _first_of_each(values: Column, name) -> Column:
    first = lambda v, names: F.filter(v, lambda x, i: F.array_position(names, name(x)) == i + 1)
    return _let(values, lambda v: _let(F.transform(v, name), lambda names: first(v, names)))


def edges(text: Column, kind: str) -> Column:
    """Names used on an edge (posedge or negedge), in order, as often as they are."""
    return _found(strip_comments(text), rf"(?i)\b{kind}\s+({_NAME})", 1)


def dual_edge_clocks(text: Column) -> Column:
    """Nets that are used on both edges."""
    both = lambda t: F.array_sort(F.array_distinct(F.array_intersect(edges(t, "posedge"), edges(t, "negedge"))))
    return _let(text, lambda t: F.when(t.rlike(r"(?i)\bnegedge\b"), both(t)).when(t.isNotNull(), F.array().cast("array<string>")))


def pick_clock(inputs: Column, rising: Column) -> Column:
    """An input with a clock's name, else that most often used on a rising edge, the earliest of equals."""
    named = F.try_element_at(F.filter(inputs, lambda n: n.rlike(CLOCK)), F.lit(1))
    votes = lambda rose: F.transform(inputs, lambda n, i: F.struct(F.size(F.filter(rose, lambda r: r == n)).alias("n"), (-i).alias("i"), n.alias("name")))
    best = _let(rising, lambda rose: F.array_max(F.filter(votes(rose), lambda v: v["n"] > 0)))
    return F.coalesce(named, best["name"])


def active_low(reset: Column, rising: Column, falling: Column, body: Column) -> Column:
    """Whether the reset is active when low: by the edges it is used on, else by how conditions test it; null if that is even."""
    up, down = F.array_contains(rising, reset), F.array_contains(falling, reset)
    # Conditions without blanks are looked up as plain text, each kind once.
    flat = F.regexp_replace(body, r"\s+", "")

    def tests(flat: Column, *forms: tuple[str, str]) -> Column:
        return sum((F.regexp_count(flat, F.concat(F.lit(r"\bif\(\Q" + a), reset, F.lit(b + r"\E"))) for a, b in forms), F.lit(0))

    counts = lambda t: F.struct(tests(t, ("!", ")"), ("!(", "))"), ("", "==1'b0)")).alias("low"), tests(t, ("", ")"), ("", "==1'b1)")).alias("high"))
    by_use = _let(_let(flat, counts), lambda n: F.when(n["low"] > n["high"], True).when(n["low"] < n["high"], False))
    return F.when(up & ~down, False).when(down & ~up, True).otherwise(by_use)


def with_context(modules: DataFrame, code: str, top: str) -> DataFrame:
    """Adds ports (name, direction, width), internals (name, width), constants, clock, reset, active_low of the module `top`."""
    clean = strip_comments(strip_formal(F.col(code)))
    pattern = F.concat(F.lit(r"(?s)\bmodule\s+"), F.col(top), F.lit(r"\b(.*?)\bendmodule\b"))
    m = modules.withColumn("__body", F.call_function("regexp_extract", clean, pattern, F.lit(1)))
    body = F.col("__body")
    chunks = _found(body, r"\b(?:input|output|inout)\b[^;)]*?(?=\b(?:input|output|inout)\b|[;)])")
    width = lambda x: F.coalesce(F.nullif(F.regexp_extract(x, r"(\[[^\]]*\])", 1), F.lit("")), F.lit("1"))
    port = lambda x: F.transform(_names(x), lambda n: F.struct(n.alias("name"), F.regexp_extract(x, r"^(\w+)", 1).alias("direction"), width(x).alias("width")))
    m = m.withColumn("ports", _first_of_each(F.flatten(F.transform(chunks, port)), lambda p: p["name"]))
    known = F.transform("ports", lambda p: p["name"])
    inner = F.transform(_found(body, r"\b(?:reg|wire|logic|integer|bit)\b[^;()]*;"), lambda x: F.transform(_names(x), lambda n: F.struct(n.alias("name"), width(x).alias("width"))))
    internals = _let(known, lambda k: F.filter(_first_of_each(F.flatten(inner), lambda p: p["name"]), lambda p: ~F.array_contains(k, p["name"])))
    constants = F.array_distinct(F.flatten(F.transform(_found(body, r"\blocalparam\b([^;]*);", 1), lambda x: _found(x, rf"({_NAME})\s*=(?!=)", 1))))
    m = m.withColumns({"internals": internals, "constants": constants, "__rising": edges(body, "posedge"), "__falling": edges(body, "negedge")})
    rising, falling = F.col("__rising"), F.col("__falling")
    inputs = F.transform(F.filter("ports", lambda p: p["direction"] == "input"), lambda p: p["name"])
    m = m.withColumn("clock", pick_clock(inputs, rising))
    others = F.filter(inputs, lambda n: ~n.eqNullSafe(F.col("clock")))
    used = _let(others, lambda o: F.filter(_found(body, rf"(?i)\b(?:posedge|negedge)\s+({_NAME})", 1), lambda n: F.array_contains(o, n)))
    m = m.withColumn("reset", F.coalesce(F.try_element_at(F.filter(others, lambda n: n.rlike(RESET)), F.lit(1)), F.try_element_at(used, F.lit(1))))
    return m.withColumn("active_low", active_low(F.col("reset"), rising, falling, body)).drop("__body", "__rising", "__falling")


def interesting(ports: Column, internals: Column, constants: Column, clock: Column, reset: Column) -> Column:
    """Names that a property can be about, in order."""
    names = F.array_distinct(F.concat(F.transform(ports, lambda p: p["name"]), F.transform(internals, lambda p: p["name"]), constants))
    return F.filter(names, lambda n: ~n.eqNullSafe(clock) & ~n.eqNullSafe(reset))


def disable_clause(reset: Column, low: Column) -> Column:
    is_low = F.coalesce(low, reset.rlike(LOW))
    return F.when(reset.isNull(), "").otherwise(F.concat(F.lit("disable iff ("), F.when(is_low, "!").otherwise(""), reset, F.lit(")")))


def names_used(block: Column) -> Column:
    return F.array_distinct(_found(mask(block), _NAME))


# --- texts for models and checkers; the wording is our own ---


def describe(top: Column, ports: Column, internals: Column, constants: Column, clock: Column, reset: Column, low: Column) -> Column:
    """A module's ports and names, a line each."""
    shown = F.array_join(F.transform(ports, lambda p: F.concat_ws(" ", F.lit(" "), p["direction"], p["width"], p["name"])), "\n")
    inside = F.array_join(F.transform(internals, lambda p: F.concat_ws(" ", F.lit(" "), p["width"], p["name"])), "\n")
    return F.concat_ws(
        "\n",
        F.concat(F.lit("module "), top),
        F.lit("ports:"),
        shown,
        F.when(F.size(internals) > 0, F.concat(F.lit("inside:\n"), inside)),
        F.when(F.size(constants) > 0, F.concat(F.lit("constants: "), F.array_join(constants, ", "))),
        F.concat(F.lit("clock: "), clock),
        F.concat(F.lit("reset: "), reset, F.lit(", "), disable_clause(reset, low)),
    )


def clip(text: Column, limit: int, wanted: str, note: str = "cut to fit") -> Column:
    """At most about `limit` characters: sections with a wanted heading first, cut at a line's end, and a note."""
    whole = F.btrim(text, F.lit(" \t\r\n"))
    parts = F.filter(F.split(whole, r"(?m)^(?=#{1,3}\s)"), lambda p: p != "")
    first = lambda p: p.rlike(rf"^[^\n]*(?:{wanted})")
    ordered = F.array_join(F.concat(F.filter(parts, first), F.filter(parts, lambda p: ~first(p))), "")
    cut = F.regexp_replace(F.substring(ordered, 1, limit), r"\n[^\n]*\z", "")
    return F.when(F.length(whole) <= limit, whole).otherwise(F.concat(F.btrim(cut, F.lit(" \t\r\n")), F.lit(f"\n\n[{note}]\n")))


def smoke_block(name: Column, clock: Column) -> Column:
    """A block that holds wherever the tools work."""
    return wrap(F.concat(F.lit("a_smoke: assert property (@(posedge "), F.coalesce(clock, F.lit("clk")), F.lit(") "), name, F.lit(" == "), name, F.lit(");")))


# What a parameter can be set to, and the modes of a task.
PARAMETER = r"""-?\d[\d_]*(?:\.\d+)?|\d*'[sS]?[bBoOdDhH][0-9a-fA-F_xXzZ?]+|"[^"\s]*\""""
MODES = ("bmc", "prove", "cover", "live")


def parameter_errors(parameters: Column) -> Column:
    """Of an array of NAME=VALUE texts: why it can't be used, or null."""
    names = F.transform(parameters, lambda p: F.btrim(F.substring_index(p, "=", 1)))
    bad = F.filter(parameters, lambda p: ~p.rlike(rf"^\s*{_NAME}\s*=\s*(?:{PARAMETER})\s*$"))
    return F.when(F.size(bad) > 0, F.concat(F.lit("not NAME=VALUE: "), bad[0])).when(F.size(F.array_distinct(names)) < F.size(names), "a name is set twice")


def job_errors(top: Column, files: Column, mode: Column, depth: Column) -> Column:
    """Why a job can't be run, by the first rule that fits, or null."""
    return (
        F.when(~top.rlike(rf"^{_NAME}$"), "not a top module")
        .when(F.size(files) == 0, "no file")
        .when(F.exists(files, lambda f: f.rlike(r"[/ :]")), "files need bare names")
        .when(~mode.isin(*MODES), "not a mode")
        .when(depth < 1, "no depth")
    )


def job_file(top: Column, files: Column, parameters: Column, mode: Column, depth: Column, engine: str = "smtbmc z3") -> Column:
    """The text of an external checker's job file with one task."""
    settings = F.concat_ws("\n", F.lit("[options]"), F.concat(F.lit("mode "), mode), F.when(mode != "live", F.concat(F.lit("depth "), depth.cast("string"))))
    setting = lambda p: F.concat(F.lit("chparam -set "), F.btrim(F.substring_index(p, "=", 1)), F.lit(" "), F.btrim(F.substring(p, F.instr(p, "=") + 1, F.length(p))), F.lit(" "), top)
    script = F.concat_ws("\n", F.lit("[script]"), F.concat(F.lit("read_verilog -sv -formal "), F.array_join(files, " ")), F.transform(parameters, setting), F.concat(F.lit("prep -top "), top))
    return F.concat(F.concat_ws("\n\n", settings, F.lit(f"[engines]\n{engine}"), script, F.concat(F.lit("[files]\n"), F.array_join(files, "\n"))), F.lit("\n"))

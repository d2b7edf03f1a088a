"""Rule bitmask ledger for document quality.

Every rule is evaluated once per document; the ledger keeps the measurements and one bit a failed rule.
Policies are versioned masks over these bits, so a new policy, or an ablation, never reads a text again.

Defined results: a null text counts as an empty one, which has no word and fails `few_words`. A null id is kept.
Repeated rows each get their own row, and a null id has one like any other. An empty table gives an empty table. A text of
any length is measured whole, in slices with other texts or alone. Columns of the input other than the text don't take part;
those that have a new column's name, case aside, are replaced by it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .kit import map_texts, per_document

#: Rule names by bit, first bit first.
RULES = ("few_words", "repeated_windows", "symbols", "repeated_lines", "word_length", "no_letters", "shouting")

#: Limits of the rules; see `failures`.
MIN_WORDS, MAX_REPEAT_PCT, MAX_SYMBOL_PCT, MAX_DUP_LINE_PCT = 50, 50, 5, 30
MIN_WORD_CHARS, MAX_WORD_CHARS, MAX_UPPER_PCT = 2, 30, 60

BASE = ("few_words", "repeated_windows")
#: A version names the rules that reject a document.
POLICIES = {
    "base": BASE,
    "v1": (*BASE, "symbols", "repeated_lines"),
    "v2": (*BASE, "symbols", "repeated_lines", "word_length", "no_letters", "shouting"),
}
CURRENT = "v2"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LETTER = _UPPER.copy()
_LETTER[0x61:0x7B] = True


def mask(version: str) -> int:
    return sum(1 << RULES.index(r) for r in POLICIES[version])


def repeated(code: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text the number of words in 3-word windows that occur twice or more in it."""
    n = len(code)
    if n < 3:
        return np.zeros(len(first) - 1, np.int64)
    size = np.diff(first)
    text = np.repeat(np.arange(len(size)), size)
    whole = text[:-2] == text[2:]
    at = np.flatnonzero(whole)
    bits = max(1, int(code.max()).bit_length())
    if 3 * bits <= 63:
        key = (code[at] << (2 * bits)) | (code[at + 1] << bits) | code[at + 2]
    else:
        pair = np.unique((code[at] << 32) | code[at + 1], return_inverse=True)[1]
        key = (pair << 32) | code[at + 2]
    order = np.lexsort((key, text[at]))
    k, t = key[order], text[at][order]
    same = (k[1:] == k[:-1]) & (t[1:] == t[:-1])
    twice = np.zeros(len(at), bool)
    twice[:-1] |= same
    twice[1:] |= same
    window = at[order[twice]]
    covered = np.zeros(n, bool)
    for i in range(3):
        covered[window + i] = True
    return per_document(covered, first)


def duplicate_lines(raw: memoryview, data: np.ndarray, offsets: np.ndarray, word_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word that equal an earlier line of their text, and all lines with a word."""
    n = len(offsets) - 1
    breaks = np.flatnonzero(data == 0x0A)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    text = np.searchsorted(offsets, starts, side="right") - 1
    # A break at a text's last byte opens an empty line, which lies at the next text's start: it has no word.
    bounds = np.append(starts, len(data))
    lines = np.searchsorted(word_starts, bounds)
    keep = (lines[1:] > lines[:-1]) & (text >= 0) & (text < n)
    ends = np.minimum(bounds[1:], offsets[np.minimum(text + 1, n)])
    starts, ends, text = starts[keep], ends[keep], text[keep]
    ends = ends - (data[ends - 1] == 0x0A)
    code = words.codes(raw, starts, ends)
    order = np.lexsort((code, text))
    c, t = code[order], text[order]
    again = (c[1:] == c[:-1]) & (t[1:] == t[:-1])
    dup = np.bincount(t[1:][again], minlength=n)
    return dup, np.bincount(text, minlength=n)


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The measurements of MEASURES for each text."""
    raw, offsets, starts, ends, first = words.of(texts)
    data = np.frombuffer(raw, np.uint8)
    code = words.codes(raw, starts, ends)
    characters = per_document((data & 0xC0) != 0x80, offsets)
    white = per_document(words.SPACE[data], offsets)
    dup, lines = duplicate_lines(raw, data, offsets, starts)
    upper = per_document(_UPPER[data], offsets)
    continued = per_document((data >= 0xC0), offsets)
    return {
        "n_words": np.diff(first),
        "word_chars": characters - white,
        "n_symbols": per_document(_SYMBOL[data], offsets),
        "n_dup_lines": dup,
        "n_repeat_words": repeated(code, first),
        "n_lines": lines,
        "n_letters": per_document(_LETTER[data], offsets) + continued,
        "n_upper": upper,
    }


def failures(m: dict[str, np.ndarray]) -> np.ndarray:
    """One bit a failed rule, in the order of RULES."""
    failed = {
        "few_words": m["n_words"] < MIN_WORDS,
        "repeated_windows": 100 * m["n_repeat_words"] > MAX_REPEAT_PCT * m["n_words"],
        "symbols": 100 * m["n_symbols"] > MAX_SYMBOL_PCT * m["word_chars"],
        "repeated_lines": (100 * m["n_dup_lines"] > MAX_DUP_LINE_PCT * m["n_lines"]) & (m["n_dup_lines"] >= 3),
        "word_length": (m["word_chars"] < MIN_WORD_CHARS * m["n_words"]) | (m["word_chars"] > MAX_WORD_CHARS * m["n_words"]),
        "no_letters": 2 * m["n_letters"] < m["word_chars"],
        "shouting": 100 * m["n_upper"] > MAX_UPPER_PCT * np.maximum(m["word_chars"], 1),
    }
    return sum(failed[r].astype(np.int64) << i for i, r in enumerate(RULES))


def _ledger(texts: pa.Array) -> list[pa.Array]:
    m = measure(texts)
    return [*(pa.array(m[k].astype(np.int64)) for k in MEASURES), pa.array(failures(m))]


def ledger(docs: DataFrame, text: str = "text", keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """docs' columns (or those of `keep`), the measurements, and `failed`, one bit a failed rule."""
    return map_texts(docs, text, _ledger, [(prefix + k, T.LongType()) for k in (*MEASURES, "failed")], keep)


def apply_policy(led: DataFrame, version: str = CURRENT, failed: str = "failed", to: str = "kept") -> DataFrame:
    """Adds `kept`: whether no rule of the policy failed."""
    return led.withColumn(to, F.col(failed).bitwiseAND(F.lit(mask(version)).cast("long")) == 0)


def ablation(led: DataFrame, version: str = CURRENT) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail it alone, and what would be kept without it."""
    hit = F.col("failed").bitwiseAND(F.lit(mask(version)).cast("long"))
    by_mask = led.groupBy(hit.alias("hit")).agg(F.count("*").alias("n"))  # at most 2 ** len(RULES) rows go on
    names = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES.index(r)).cast("long").alias("bit")) for r in POLICIES[version]])
    each = by_mask.withColumn("r", F.explode(names)).select("hit", "n", "r.rule", "r.bit")
    return each.groupBy("rule").agg(
        F.sum(F.when(F.col("hit").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("hit") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when((F.col("hit") == 0) | (F.col("hit") == F.col("bit")), F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


def summary(led: DataFrame) -> DataFrame:
    """Bitwise aggregation over all rows: rules that some document fails, that all fail, and the parity of failures."""
    return led.agg(F.expr("bit_or(failed)").alias("failed_by_some"), F.expr("bit_and(failed)").alias("failed_by_all"), F.count("*").alias("n"))


def rejected_base(led: DataFrame) -> DataFrame:
    return led.withColumn("base_failed", F.col("failed").bitwiseAND(F.lit(mask("base")).cast("long")) != 0)

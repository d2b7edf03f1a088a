"""The registered queries of the text operators, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable, Iterable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, decontam, divergence, idfile, packing, pii, prefixes, quality, simhash, suffix, toxicity
from .kit import documents, shared_base


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file; its folder can be set where the executors keep it elsewhere."""
    folder = os.environ.get("PUBLIC_TOKENIZERS_DIR")
    return os.path.join(folder, name) if folder else public_tokenizers.path(name)


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that all executors share."""
    return f"{shared_base(spark)}/tracecheck-{uuid.uuid4().hex}"


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = shared_folder(spark)
    idfile.write(documents(spark, sf_dir), place, vocabulary("byte_bpe_50k.json"))
    return idfile.read(spark, place)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    chain = toxicity.train(*toxicity.sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return toxicity.score(docs, chain, keep=["doc_id"])


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.count_tokens(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), keep=["doc_id"])


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = quality.rejected_base(quality.apply_policy(quality.ledger(documents(spark, sf_dir), keep=["doc_id"])))
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(documents(spark, sf_dir))


#: The turns of conversation -1.
ODD_TURNS = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    formatted = chat.format_conversations(turns.unionAll(spark.createDataFrame(ODD_TURNS, "conv_id long, turn long, role string, text string")))

    def read_back(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, loss in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = chat.parse(text)
                said = "".join(chat.unescape(text[x["start"] : x["end"]]) for x in loss)
                both = "".join(f"{role}\n{t}\n" for role, t in turns)
                rows.append((len(turns), hashlib.sha256(both.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), len(text)))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), vocabulary("byte_bpe_50k.tiktoken"), keep=["doc_id"])


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", simhash.hex_fingerprint("fp").alias("fingerprint"), "component_id")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(documents(spark, sf_dir), keep=["doc_id"])


def op11_multi_length_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_ids, op2_toxicity, op3_token_counts, op4_quality_rules, op5_suffix_dedup, op6_chat_format, op7_byte_bpe, op8_decontamination, op9_simhash, op10_pii, op11_multi_length_packing, op12_prefix_trie, op13_source_divergence)}

#: op4's rules again, as SQL. A line's words, windows and marks are worked out with list functions and grouping.
OP4_SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT r, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM t
), p AS (
  SELECT r, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3
), g AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2]) AS c FROM p
), rep AS (
  SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM g WHERE c > 1) GROUP BY r
), l AS (
  SELECT r, unnest(string_split(text, chr(10))) AS line FROM t
), lines AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
), m AS (
  SELECT t.r, doc_id, len(ws)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
    length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS n_upper,
    length(regexp_replace(text, '[^A-Za-z\x{80}-\x{10FFFF}]+', '', 'g')) AS n_letters
  FROM t JOIN w USING (r) LEFT JOIN rep USING (r) LEFT JOIN lines USING (r)
), f AS (
  SELECT *, n_words < 50 AS f0, 100 * n_repeat_words > 50 * n_words AS f1, 100 * n_symbols > 5 * word_chars AS f2,
    100 * n_dup_lines > 30 * n_lines AND n_dup_lines >= 3 AS f3, word_chars < 2 * n_words OR word_chars > 30 * n_words AS f4,
    2 * n_letters < word_chars AS f5, 100 * n_upper > 60 * greatest(word_chars, 1) AS f6
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f0 OR f1 AS base_failed,
  NOT (f0 OR f1 OR f2 OR f3 OR f4 OR f5 OR f6) AS kept,
  (f0::INT + 2 * f1::INT + 4 * f2::INT + 8 * f3::INT + 16 * f4::INT + 32 * f5::INT + 64 * f6::INT)::BIGINT AS failed
FROM f
"""

#: Every 50-byte string of every text, as hex digits, and the smallest id that has it; then what is covered and what is left.
OP5_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), p AS (
  SELECT r, doc_id, unnest(range(0, greatest(length(h) // 2 - 49, 0))) AS i, h FROM d
), w AS (
  SELECT r, doc_id, i, md5_number(substr(h, 2 * i + 1, 100)) AS k FROM p
), m AS (
  SELECT r, i FROM (SELECT r, i, doc_id, min(doc_id) OVER (PARTITION BY k) AS least FROM w) WHERE least < doc_id
), g AS (
  SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 50 THEN 0 ELSE 1 END AS fresh FROM m
), s AS (
  SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS span FROM g
), spans AS (
  SELECT r, span, min(i) AS a, max(i) + 50 AS b FROM s GROUP BY r, span
), kept AS (
  SELECT r, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS from_, a AS to_, b - a AS size FROM spans
), part AS (
  SELECT r, count(*) AS n_spans, sum(size) AS n_removed, string_agg(substr(h, 2 * from_ + 1, 2 * (to_ - from_)), '' ORDER BY to_) AS before, max(to_ + size) AS last
  FROM kept JOIN d USING (r) GROUP BY r
)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(before, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN part USING (r)
"""

#: op6's digests from the turns themselves; the length of the template's marks is worked out from the texts.
OP6_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(regexp_replace(text, '([<\[])(\\*)(/?s>|<SYS>>|</SYS>>|/?INST\]|/?ROLE\])', '\1\\\2\3', 'g')) AS n,
    CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 5 WHEN 'system' THEN 19 END AS marks
  FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(n + marks))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

#: op12 again: each prefix by a digest of all its turns; crc32 bit by bit.
OP12_SQL = r"""
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), s AS (SELECT c, max(pos) AS size FROM t GROUP BY c
), crc AS (
  SELECT c, size, c - ((c % 5) + 5) % 5 AS base, xor(4294967295, list_reduce(
    list_transform(range(0, 8 * length(c::VARCHAR)), lambda i: CASE WHEN i % 8 = 0 THEN ascii(substr(c::VARCHAR, (i // 8 + 1)::INT, 1))::BIGINT ELSE 0::BIGINT END),
    lambda a, x: xor(xor(a, x) >> 1, CASE WHEN xor(a, x) % 2 = 1 THEN 3988292384 ELSE 0 END), 4294967295::BIGINT)) % 9 AS h FROM s
), info AS (
  SELECT crc.c, base, h, least(h, coalesce(s.size, 0)) AS shared, crc.size FROM crc LEFT JOIN s ON s.c = base
), r AS (
  SELECT info.c, pos, role, text FROM info JOIN t ON t.c = base WHERE pos <= shared
  UNION ALL SELECT info.c, pos - h + shared, role, text FROM info JOIN t USING (c) WHERE pos > h
), p AS (
  SELECT c, pos AS depth, strlen(text) AS bytes, md5(string_agg(length(role) || ':' || role || length(text) || ':' || text, '' ) OVER (PARTITION BY c ORDER BY pos)) AS path,
    pos = max(pos) OVER (PARTITION BY c) AS ends FROM r
  UNION ALL SELECT c, 0, 0, '', NOT EXISTS (SELECT 1 FROM r WHERE r.c = info.c) FROM info
), n AS (
  SELECT depth, path, min(c) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '') AS own FROM p GROUP BY depth, path
), up AS (
  SELECT n.*, a.path AS over_path, a.conv_id AS parent FROM (SELECT n.*, p.path AS over_ FROM n LEFT JOIN p ON p.c = n.conv_id AND p.depth = n.depth - 1) n LEFT JOIN n a ON a.depth = n.depth - 1 AND a.path = n.over_
), kids AS (SELECT depth - 1 AS depth, over_path AS path, count(*) AS k FROM up WHERE depth > 0 GROUP BY ALL
), sub AS (
  SELECT p.depth, p.path, sum((n.n_convs - 1) * n.bytes) AS saved, count(*) FILTER (kids.k IS NULL) AS leaves
  FROM n JOIN p ON p.c = n.conv_id AND p.depth <= n.depth LEFT JOIN kids ON kids.depth = n.depth AND kids.path = n.path GROUP BY p.depth, p.path
)
SELECT conv_id, depth::BIGINT AS depth, parent AS parent_conv_id, n_convs, coalesce(k, 0)::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(own) AS ends_sha256
FROM up LEFT JOIN kids USING (depth, path) JOIN sub USING (depth, path)
"""

#: op13 again: all cells of terms and sources of a language, in whole numbers of 128 bits.
OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), t AS (
  SELECT r, lang, source, unnest(regexp_extract_all(text, '[a-z\x{80}-\x{10FFFF}]+')) AS term FROM d
), g AS (SELECT DISTINCT lang, source FROM d
), k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10
), c AS (SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL
), v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang
), cells AS (
  SELECT g.lang, g.source, k.term, v, coalesce(c, 0) AS c FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)
), n AS (
  SELECT *, sum(c) OVER (PARTITION BY lang, source) AS n, sum(c) OVER (PARTITION BY lang, term) AS lc, sum(c) OVER (PARTITION BY lang) AS ln FROM cells
), p AS (
  SELECT lang, source, term, c, 1 + (1000000000::HUGEINT * (c + 2)) // (n + 2 * v) AS p, 1 + (1000000000::HUGEINT * (lc + 2)) // (ln + 2 * v) AS q FROM n
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE c > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""

ORACLES: dict[str, str] = {"op4_quality_rules": OP4_SQL, "op5_suffix_dedup": OP5_SQL, "op6_chat_format": OP6_SQL, "op12_prefix_trie": OP12_SQL, "op13_source_divergence": OP13_SQL}

"""Value change dumps as tables, by a Python data source.

spark.read.format("vcd").option("path", ...).option("table", "signals" | "times" | "changes").load()

Each file is one partition and one trace, named by its path. Paths are listed and files read through Spark's own
binary reader in `read_vcd`, which works on any store; the data source reads paths that all executors can open.

`read_lines` and `split_tables` are for dumps of any size: Spark's text reader cuts files into byte ranges, the header is
read once, and what a line needs from the lines before it (the time, its index, the number of changes) is carried over the
ends of ranges by running values. Only headers, which grow with the declared signals, are put together.
"""

from __future__ import annotations

import glob
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tracecheck.operators.scan import scan

SCHEMAS = {
    "signals": "trace_id string, ord int, code string, name string, scope array<string>, width int, kind string",
    "times": "trace_id string, ti int, t long",
    "changes": "trace_id string, ti int, t long, seq long, code string, raw string",
}


class VcdError(ValueError):
    """A dump that can't be read."""


def parse(text: str) -> Iterator[tuple[str, tuple]]:
    """('signals' | 'times' | 'changes', row without trace_id) in the order of the text.

    Of two declarations with one code, the later one counts. Changes before the first time have ti -1.
    """
    head, mark, body = text.partition("$enddefinitions")
    if not mark:
        raise VcdError("no $enddefinitions")
    scope: list[str] = []
    declared: dict[str, tuple] = {}
    for m in re.finditer(r"\$(\w+)(.*?)\$end\b", head, re.S):
        words = m[2].split()
        if m[1] == "scope":
            if len(words) != 2:
                raise VcdError(f"malformed $scope {m[2].strip()!r}")
            scope.append(words[1])
        elif m[1] == "upscope":
            if scope:
                scope.pop()
        elif m[1] == "var":
            if len(words) < 4 or not words[1].isdigit():
                raise VcdError(f"malformed $var {m[2].strip()!r}")
            declared.pop(words[2], None)
            name = re.sub(r"\[\d+(?::\d+)?\]$", "", words[3]) or words[3]  # a range may be attached
            declared[words[2]] = (words[2], name, [*scope], int(words[1]), words[0])
    for n, row in enumerate(declared.values()):
        yield "signals", (n, *row)
    ti, t, seq = -1, None, 0
    for line in body.partition("$end")[2].splitlines():
        s = line.strip()
        if not s or s[0] == "$":
            continue
        if s[0] == "#":
            ti, t = ti + 1, int(s[1:])
            yield "times", (ti, t)
            continue
        if s[0] in "bBrR":
            parts = s.split()
            if len(parts) != 2:
                continue
            raw, code = (parts[0][1:] if s[0] in "bB" else "r" + parts[0][1:]), parts[1]
        elif s[0].lower() in "01xz":
            raw, code = s[0], s[1:].strip()
        else:
            continue
        yield "changes", (ti, t, seq, code, raw.lower())
        seq += 1


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.table = options.get("table", "changes")
        path = options["path"]
        self.paths = sorted(glob.glob(os.path.join(path, "**", "*.vcd"), recursive=True)) if os.path.isdir(path) else sorted(glob.glob(path)) or [path]

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.path, encoding="utf-8", errors="replace") as f:
            for table, row in parse(f.read()):
                if table == self.table:
                    yield (partition.path, *row)


class VcdSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vcd"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "changes")]

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VcdSource)


#: One stream of rows for all tables: what a row belongs to, and the columns of all of them.
_ALL = "table string, trace_id string, ord int, code string, name string, scope array<string>, width int, kind string, ti int, t long, seq long, raw string"
_COLUMNS = {k: [f.split()[0] for f in re.split(r",\s*(?![^<]*>)", v)] for k, v in SCHEMAS.items()}


def parse_tables(texts: DataFrame, trace: str, text: str) -> DataFrame:
    """The rows of all tables from dumps that are a column already; each dump is parsed once."""
    schema = StructType.fromDDL(_ALL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            for t, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [dict(zip(_COLUMNS[table], (t, *row), strict=True), table=table) for table, row in parse(x)]
                yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(schema.names, kinds, strict=True)], names=schema.names)

    return texts.select(F.col(trace).cast("string"), F.col(text).cast("string")).mapInArrow(run, schema)


def table_of(rows: DataFrame, table: str) -> DataFrame:
    """One table of parse_tables."""
    return rows.where(F.col("table") == table).select(*_COLUMNS[table])


def parse_column(texts: DataFrame, trace: str, text: str, table: str) -> DataFrame:
    """The rows of one table from dumps that are a column already."""
    return table_of(parse_tables(texts, trace, text), table)


def read_vcd(spark: SparkSession, path: str, table: str) -> DataFrame:
    """One table of all dumps under path, read by Spark itself."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.vcd").option("recursiveFileLookup", "true").load(path)
    return parse_column(files.selectExpr("path as trace_id", "decode(content, 'UTF-8') as text"), "trace_id", "text", table)


def read_lines(spark: SparkSession, path: str, glob_filter: str = "*.vcd") -> DataFrame:
    """(trace_id, block, row, value): the lines of all dumps under path; block and row give their order in a file."""
    files = spark.read.option("pathGlobFilter", glob_filter).option("recursiveFileLookup", "true").text(path)
    return files.select(F.col("_metadata.file_path").alias("trace_id"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), "value")


def split_tables(lines: DataFrame) -> dict[str, DataFrame]:
    """The tables of dumps given as lines (trace_id, block, row, value). A dump without the header's end is an error."""
    place = F.struct("block", "row")
    marks = lines.groupBy("trace_id").agg(F.min(F.when(F.col("value").contains("$enddefinitions"), place)).alias("mark"))
    marks = marks.withColumn("mark", F.when(F.col("mark").isNull(), F.raise_error(F.lit("no $enddefinitions")).cast("struct<block: bigint, row: bigint>")).otherwise(F.col("mark")))
    # The header ends with the first $end behind the mark, on its line or a later one.
    closes = F.when(place == F.col("mark"), F.col("value").rlike(r"\$enddefinitions.*?\$end\b")).otherwise((place > F.col("mark")) & F.col("value").rlike(r"\$end\b"))
    ends = lines.join(marks, "trace_id").where(closes).groupBy("trace_id").agg(F.min(place).alias("end"))
    known = lines.join(ends, "trace_id")
    head = known.where(place <= F.col("end")).groupBy("trace_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "row", "value"))), lambda x: x["value"]), "\n").alias("text"))
    signals = parse_column(head, "trace_id", "text", "signals")
    # What stands behind the header's end on its line is the body's first line.
    text = F.btrim(F.when(place == F.col("end"), F.regexp_extract("value", r"^(?:.*\$enddefinitions)?.*?\$end\b(.*)$", 1)).otherwise(F.col("value")), F.lit(" \t\r"))
    vector, scalar = r"^([bBrR])(\S+)\s+(\S+)$", r"^([01xzXZ])\s*(.*)$"
    is_vector = F.col("s").rlike("^[bBrR]")
    raw = F.when(is_vector, F.concat(F.when(F.col("s").rlike("^[rR]"), "r").otherwise(""), F.regexp_extract("s", vector, 2))).otherwise(F.regexp_extract("s", scalar, 1))
    body = known.where(place >= F.col("end")).select("trace_id", "block", "row", text.alias("s")).where(F.col("s") != "")
    body = body.where(F.col("s").rlike("^#") | F.col("s").rlike(vector) | F.col("s").rlike(scalar)).select(
        "trace_id",
        "block",
        "row",
        F.when(F.col("s").startswith("#"), F.substring("s", F.lit(2), F.length("s")).cast("bigint")).alias("time"),
        F.when(~F.col("s").startswith("#"), F.lower(raw)).alias("raw"),
        F.when(~F.col("s").startswith("#"), F.when(is_vector, F.regexp_extract("s", vector, 3)).otherwise(F.btrim(F.regexp_extract("s", scalar, 2)))).alias("code"),
    )
    body = body.withColumns({"__time": F.col("time").isNotNull().cast("int"), "__change": F.col("time").isNull().cast("int")})
    placed = scan(body, ["trace_id"], ["block", "row"], {"n": ("sum", "__time"), "t": ("last", "time"), "m": ("sum", "__change")}).withColumn("ti", (F.col("n") - 1).cast("int"))
    changes = placed.where("time is null").select("trace_id", "ti", "t", (F.col("m") - 1).alias("seq"), "code", "raw")
    return {"signals": signals, "times": placed.where("time is not null").select("trace_id", "ti", F.col("time").alias("t")), "changes": changes}

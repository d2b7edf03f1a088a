"""JSON-lines logs of attempts: reading, appending, and the report files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: All fields of the logs, with types; inference would take a column that is null throughout for a string.
LOG_SCHEMA = (
    "type string, block string, top string, system string, prompt string, sva string, turn long, turns long, asserts long, skipped long, "
    "killed long, valid_mutants long, first_pass boolean, cover_ok boolean, kill_rate double, status string, ok boolean, winner_turn long, "
    "faulty_attempt string, counterexample string, fixed_attempt string, fault_status string, blocks long, syntactic_rate double, "
    "first_pass_rate double, cegar_rate double, heal_rate double"
)


def read_log(spark: SparkSession, paths: list[str], kind: str = "sft") -> DataFrame:
    """Rows of one type, with their file and place. A malformed line fails the read.

    file_ord is the path's place among `paths`; line_no is the byte order within the file, as Spark numbers it.
    """
    found = None
    for n, path in enumerate(paths):
        one = spark.read.schema(LOG_SCHEMA).option("mode", "FAILFAST").json(path).withColumn("source", F.input_file_name()).withColumn("file_ord", F.lit(n)).withColumn("line_no", F.monotonically_increasing_id())
        found = one if found is None else found.unionByName(one)
    return found.where(F.col("type") == kind)


def append_log(rows: DataFrame, path: str) -> int:
    """Appends rows as JSON lines and returns their number; without rows there is no file."""
    n = rows.count()
    if n:
        rows.write.mode("append").option("ignoreNullFields", "false").json(path)
    return n


def all_kinds(*frames: DataFrame) -> DataFrame:
    """Rows of different types in one frame; fields that a type lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def messages_request(messages: list[dict], model: str, max_tokens: int, temperature: float) -> dict:
    """The body of a chat request; sending it is left to a callable that the user gives."""
    return {"model": model, "messages": messages, "max_tokens": max_tokens, "temperature": temperature}


def reply_content(reply: str):
    """The text of a chat reply in a JSON column, or null."""
    return F.get_json_object(F.col(reply), "$.choices[0].message.content")

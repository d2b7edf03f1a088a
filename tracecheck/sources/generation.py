"""Samples from a model behind a callable. How a request is sent is up to the caller."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: send(request) -> text; raises if there is no answer. It runs on the executors.
Send = Callable[[dict], str]
#: Ways to ask for less after a failure, tried in this order.
DOWNGRADES = ("halve_tokens", "no_thinking", "no_grammar")


def downgraded(request: dict, how: str) -> dict:
    if how == "halve_tokens":
        return {**request, "max_tokens": max(1, request["max_tokens"] // 2)}
    return {k: v for k, v in request.items() if k != {"no_thinking": "thinking", "no_grammar": "grammar"}[how]}


def ask(send: Send, request: dict) -> str:
    """An answer; after each failure less is asked for, three times at most."""
    error: Exception | None = None
    for how in (None, *DOWNGRADES):
        request = request if how is None else downgraded(request, how)
        try:
            return send(request)
        except Exception as e:  # whatever the caller's transport raises
            error = e
    raise RuntimeError(f"no answer: {error}") from error


def samples(jobs: DataFrame, send: Send, n: int, max_tokens: int = 1024) -> DataFrame:
    """(job, sample, answer, error): n answers to each row (job, prompt), numbered in order; a failed one has its error."""
    wanted = jobs.select("job", "prompt").withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                try:
                    rows.append((r.job, r.sample, ask(send, {"prompt": r.prompt, "max_tokens": max_tokens, "seed": r.sample, "thinking": True, "grammar": True}), None))
                except RuntimeError as e:
                    rows.append((r.job, r.sample, None, str(e)))
            yield pd.DataFrame(rows, columns=["job", "sample", "answer", "error"])

    kind = jobs.schema["job"].dataType.simpleString()
    return wanted.mapInPandas(run, f"job {kind}, sample int, answer string, error string")


def failed_jobs(answers: DataFrame) -> DataFrame:
    """Jobs without any answer."""
    return answers.groupBy("job").agg(F.count("answer").alias("n"), F.first("error", ignorenulls=True).alias("error")).where("n = 0").select("job", "error")

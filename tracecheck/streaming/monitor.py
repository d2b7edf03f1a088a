"""Property checks on streams.

The state of a trace is its last `max_history` rows and its row count, so it is bounded by the plan. Rows of a trace
have to arrive in order between batches; within a batch they are sorted. A row that comes later than a row already
checked is late: it is not checked, and is counted. This rule is ours.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracecheck.plans import evaluate
from tracecheck.plans.properties import Plan

OUTPUT = "label string, cycle long, late long"


def violations(stream: DataFrame, plan: Plan, trace: str, order: list[str], signals: list[str]) -> DataFrame:
    """(trace, label, cycle, late): violated checks as they are found, and a row with a null label a batch with late rows.

    signals: columns that the plan reads. `order` columns have to be comparable and JSON-able once cast to string or number.
    """
    kind = stream.schema[trace].dataType.simpleString()
    keep = max(1, plan.max_history)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            (held,) = state.get
            kept = json.loads(held)
        else:
            kept = {"n": 0, "rows": [], "last": None}
        new = pd.concat(list(batches)).sort_values(order)
        rows = [{s: evaluate.plain(r[s]) for s in signals} | {"__o": [evaluate.plain(r[c]) for c in order]} for r in new.to_dict("records")]
        fresh = [r for r in rows if kept["last"] is None or r["__o"] > kept["last"]]
        late = len(rows) - len(fresh)
        history = kept["rows"] + fresh
        start = kept["n"] - len(kept["rows"])
        out = []
        for i in range(len(kept["rows"]), len(history)):
            out += [(key[0], label, start + i, 0) for label in evaluate.violated(plan, history, i, start + i)]
        if late:
            out.append((key[0], None, None, late))
        if fresh:
            kept = {"n": kept["n"] + len(fresh), "rows": history[-keep:], "last": fresh[-1]["__o"]}
        state.update((json.dumps(kept),))
        yield pd.DataFrame(out, columns=[trace, "label", "cycle", "late"]).astype({"cycle": "Int64", "late": "Int64"})

    return stream.select(trace, *order, *[s for s in signals if s not in order and s != trace]).groupBy(trace).applyInPandasWithState(step, f"`{trace}` {kind}, {OUTPUT}", "kept string", "append", GroupStateTimeout.NoTimeout)

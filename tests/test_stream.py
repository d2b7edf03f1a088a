"""The streaming monitor over several batches, with late rows."""

import random

from tracecheck.plans import monitor as batch
from tracecheck.plans.properties import parse_block
from tracecheck.streaming import monitor


def test_batches_equal_one_pass(spark, tmp_path):
    r = random.Random(3)
    rows = [(t, i, r.random() < 0.5, r.random() < 0.5) for t in range(5) for i in range(40)]
    schema = "t int, i int, p boolean, q boolean"
    plan = parse_block("a: assert property (p ##1 q |=> ##[0:2] p); b: assert property (disable iff (q) p |=> $past(p));", auto_cover=False)
    source = str(tmp_path / "in")
    for k in range(4):
        part = [x for x in rows if 10 * k <= x[1] < 10 * k + 10]
        if k == 2:
            part.append((0, 3, True, True))  # late
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = monitor.violations(stream, plan, "t", ["i"], ["p", "q"]).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = {(x.t, x.label, x.cycle) for x in batch.violations(spark.createDataFrame(rows, schema), plan, ["t"], ["i"]).collect()}
    assert {(x.t, x.label, x.cycle) for x in got.where("label is not null").collect()} == want
    assert got.where("late > 0").count() == 1

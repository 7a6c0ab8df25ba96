"""Tables kept up by a stream without state."""

import random

from pyspark.sql import functions as F

from snapspark.session import scratch_path
from snapspark.streaming import loads as L


def stream(spark, path, schema):
    return L.file_stream(spark, path, schema, files_per_batch=1)


def test_ten_batches_hold_no_state_and_a_second_run_goes_on(spark):
    rnd = random.Random(8)
    rows = [(rnd.randrange(60), i, rnd.choice("abc"), rnd.randrange(2)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id int, seq int, reason string, active int")
    source, out, checkpoint = (scratch_path(spark, name) for name in ("fold-source", "fold", "fold-checkpoint"))
    df.where("seq < 1500").repartition(11, "seq").write.parquet(source)
    last, first = L.last_of("id", "seq", ["reason"]), L.first_of("id", ["seq"], ["seq", "reason"])
    run = L.fold_batches(stream(spark, source, df.schema), last, out, checkpoint, every=4)
    assert len(run.recentProgress) >= 10 and not any(p["stateOperators"] for p in run.recentProgress)
    want = lambda n, pick: {(i, *pick([(s, r) for j, s, r, _ in rows if j == i and s < n])) for i in {j for j, s, *_ in rows if s < n}}
    assert {tuple(r) for r in L.folded(spark, out, last).select("id", "seq", "reason").collect()} == want(1500, max)
    assert spark.read.parquet(f"{out}/done").count() == 2
    # New files are folded onto what is there.
    df.where("seq >= 1500").repartition(3, "seq").write.mode("append").parquet(source)
    L.fold_batches(stream(spark, source, df.schema), last, out, checkpoint, every=4)
    assert {tuple(r) for r in L.folded(spark, out, last).select("id", "seq", "reason").collect()} == want(2000, max)
    other, again = scratch_path(spark, "fold"), scratch_path(spark, "fold-checkpoint")
    L.fold_batches(stream(spark, source, df.schema), first, other, again, every=3)
    assert {tuple(r) for r in L.folded(spark, other, first).select("id", "seq", "reason").collect()} == want(2000, min)


def test_a_batch_that_comes_again_changes_nothing(spark):
    df = spark.createDataFrame([(i % 5, i) for i in range(40)], "id int, seq int")
    out, last = scratch_path(spark, "fold"), L.last_of("id", "seq", [])
    last = lambda rows: rows.groupBy("id").agg(F.max("seq").alias("seq"))
    for batch, (low, high) in enumerate([(0, 10), (10, 20), (20, 30), (30, 40)]):
        for _ in range(2):
            last(df.where((F.col("seq") >= low) & (F.col("seq") < high))).write.mode("overwrite").parquet(L._batch_path(f"{out}/batches", batch))
            if batch % 2:
                L.folded(spark, out, last, batch).write.mode("overwrite").parquet(f"{out}/bases/upto={batch}")
                spark.range(1).write.mode("overwrite").parquet(f"{out}/done/upto={batch}")
    assert {tuple(r) for r in L.folded(spark, out, last).collect()} == {(i, 35 + i) for i in range(5)}

"""Streams that stop, start again and repeat a batch."""

from pyspark.sql import functions as F


def test_drift_counts_each_batch_once(spark, tmp_path):
    from orefield.operators.evaluation import mean_drift, population_stability
    from orefield.plans.monitored import in_two_runs
    from orefield.streaming import monitor

    table = spark.range(3000).select("id", F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double").alias("x"), (F.col("id") % 7).alias("y"))
    ref = monitor.Reference.of(table.filter("id < 1000"), ["x", "y"])
    later = table.filter("id >= 1000").withColumn("x", F.when(F.col("id") % 50 != 0, F.col("x") * 3))
    base = str(tmp_path)
    in_two_runs(later, "id % 2 = 0", f"{base}/rows", lambda s: monitor.watch(s, ref, f"{base}/epochs", f"{base}/c"))
    monitor.watch(spark.readStream.schema(later.schema).parquet(f"{base}/rows"), ref, f"{base}/epochs", f"{base}/c").awaitTermination()  # nothing new
    got = {r["column"]: r for r in monitor.drift_so_far(spark, f"{base}/epochs", ref).collect()}
    psi = {r["column"]: r.psi for r in population_stability(table.filter("id < 1000"), later, ["x", "y"]).collect()}
    z = {r["column"]: r.z for r in mean_drift(table.filter("id < 1000"), later, ["x", "y"]).collect()}
    assert (got["x"].n, got["y"].n) == (1960, 2000) and got["x"].verdict == "drift" and got["y"].verdict == "stable"
    for c in ("x", "y"):
        assert abs(got[c].psi - psi[c]) < 1e-9 and abs(got[c].z - z[c]) < 1e-9


def test_a_repeated_epoch_folds_nothing_twice(spark, tmp_path):
    from orefield.streaming.events import Versions, upsert_batches

    state = Versions(spark, f"file://{tmp_path}/state", "k string, n long")
    fold = lambda df: df.groupBy("k").agg(F.sum("n").alias("n"))
    changes, schema = f"{tmp_path}/changes", "k string, n long"
    for run in range(3):
        spark.createDataFrame([("a", 1), ("b", 10**run)], schema).coalesce(1).write.mode("append").parquet(changes)
        upsert_batches(spark.readStream.schema(schema).parquet(changes), fold, state, f"{tmp_path}/c").awaitTermination()
    assert {r.k: r.n for r in state.before().collect()} == {"a": 3, "b": 111} and state.epochs() == [1, 2]
    # the last batch is run again, as after a failure before its commit
    before = state.before(2)
    state.write(fold(before.unionByName(spark.createDataFrame([("a", 1), ("b", 100)], schema))), 2)
    assert {r.k: r.n for r in state.before().collect()} == {"a": 3, "b": 111}
    assert Versions(spark, f"file://{tmp_path}/nothing", schema).before() is None


def test_counters_go_on_from_their_state(spark, tmp_path):
    from orefield.plans.monitored import in_two_runs
    from orefield.streaming.events import latest_counters, running_counters

    rows = spark.createDataFrame([(i, None if i % 5 == 0 else i % 3, None if i == 7 else i % 2) for i in range(60)], "i int, u int, odd int")
    base = str(tmp_path)
    in_two_runs(rows, "i < 20", f"{base}/log", lambda s: running_counters(s, "u", F.col("odd") == 1, f"{base}/epochs", f"{base}/c"))
    want = {r.u: (r.n, r.m) for r in rows.groupBy("u").agg(F.count("*").alias("n"), F.count_if(F.col("odd") == 1).alias("m")).collect()}
    assert {r.user: (r.n, r.marked) for r in latest_counters(spark, f"{base}/epochs", "int").collect()} == want

"""All registered queries of the engine against their SQL; adapters, messages, sources."""

import dataclasses
import json
import os
import time

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veilspark.config import CastleConfig, DocaConfig, PipelineConfig
from veilspark.functions import noise
from veilspark.operators import clusters, domain, forecast, measure, messages, sequence
from veilspark.plans import queries as plans
from veilspark.sources import generators, tables
from veilspark.streaming import adapters


@pytest.fixture(scope="module")
def database(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf}/{name}'")
    return con


def canonical(rows):
    return sorted(tuple("null" if x is None else f"{x:.5f}" if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(spark, sf, database, name):
    df = plans.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    cursor = database.execute(plans.SQL[name])
    theirs = [c[0] for c in cursor.description]
    assert sorted(theirs) == columns
    assert canonical(df.select(*columns).collect()) == canonical([[r[theirs.index(c)] for c in columns] for r in cursor.fetchall()])


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_other_queries_run(spark, sf, name):
    df = plans.QUERIES[name](spark, sf)
    rows = df.collect()
    if "id" in df.columns:
        assert len({r["id"] for r in rows}) == len(rows)


def test_batch_equals_stream(spark, sf):
    for batch, stream in (("castleguard", "castleguard_stream"), ("doca", "doca_stream")):
        assert canonical(plans.QUERIES[batch](spark, sf).collect()) == canonical(plans.QUERIES[stream](spark, sf).collect())


@pytest.mark.parametrize("rocks", [False, True])
def test_state_carries_over_micro_batches(spark, tmp_path, rocks):
    if rocks:
        adapters.large_state(spark)
    rows = pd.DataFrame({"user": [1] * 40, "event": range(40), "v": [float(i * 7 % 23) for i in range(40)]})
    for part in range(4):
        spark.createDataFrame(rows.iloc[part * 10 : part * 10 + 10]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        os.utime(max((tmp_path / "in").glob("*.parquet"), key=os.path.getmtime), (1000 + part, 1000 + part))
    config = CastleConfig(k=2, l=2, delta=5, headers=("v",))
    schema = "user long, event long, v double"
    source = tables.stream(spark, "parquet", str(tmp_path / "in"), schema, files_per_trigger=1)
    made = adapters.anonymise_stream(adapters.prepared(source, config, "user", "event", "event", "v"), config)
    tables.write_stream(made, "parquet", str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    batch = adapters.anonymise_batch(adapters.prepared(spark.createDataFrame(rows), config, "user", "event", "event", "v"), config)
    assert canonical(spark.read.parquet(str(tmp_path / "out")).collect()) == canonical(batch.collect())
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_flush_and_null_keys(spark):
    rows = spark.createDataFrame([(None if i % 2 else "a", i, float(i), "x") for i in range(9)], "k string, i long, v double, s string")
    config = DocaConfig(headers=("v",), delay=3)
    kept = adapters.anonymise_batch(adapters.prepared(rows, config, "k", "i", "i", "s"), config)
    assert kept.count() < adapters.anonymise_batch(adapters.prepared(rows, config, "k", "i", "i", "s"), config, flush=True).count() == 9
    empty = rows.where("false")
    assert adapters.anonymise_batch(adapters.prepared(empty, config, "k", "i", "i", "s"), config).count() == 0


def test_completion_stream(spark, tmp_path):
    spark.createDataFrame([("a", "p", 1), ("a", "q", 2), ("b", "p", 3)], "id string, stage string, at long").write.parquet(str(tmp_path / "in"))
    source = tables.stream(spark, "parquet", str(tmp_path / "in"), "id string, stage string, at long")
    done = adapters.complete_stream(source, ["p", "q"], ["p"], 50)
    tables.write_stream(done, "parquet", str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("a", 2, True, 1, 2)]


def test_completion_patience(spark):
    rows = spark.createDataFrame([("a", "p")] * 49 + [("b", "p")] * 50 + [("c", "p"), ("c", "q")], "id string, stage string")
    out = measure.complete(rows, "id", "stage", ["p", "q"], ["p"], 50).collect()
    assert sorted((r["id"], r["complete"]) for r in out) == [("b", False), ("c", True)]


def test_sliced_numbering_equals_window(spark):
    rows = spark.createDataFrame([(k, d, i) for k in (None, 1, 2) for d in (3, 1, 2, None) for i in range(5)], "k long, d long, i long")
    plain = sequence.numbered(rows, ["k"], ["d", "i"])
    sliced = sequence.numbered(rows, ["k"], ["d", "i"], slice_of=F.col("d"))
    assert canonical(plain.collect()) == canonical(sliced.collect())


def test_nearest_cluster_limit(spark):
    many = spark.range(5).select("id", F.lit(0.0).alias("lo_v"), F.col("id").cast("double").alias("hi_v"))
    rows = spark.createDataFrame([(2.4,), (None,)], "v double")
    got = clusters.nearest(rows, many, ["v"], "id").collect()
    assert got[0]["nearest"] == 2
    with pytest.raises(ValueError):
        clusters.nearest(rows, many, ["v"], "id", most=4)


def test_nearest_of_many_clusters(spark):
    many = spark.range(2500).select("id", F.lit(0.0).alias("lo_v"), F.col("id").cast("double").alias("hi_v"))
    rows = spark.createDataFrame([(float(v),) for v in (0, 2.4, 1234.5, 2499, 9999)] + [(None,)], "v double")
    got = clusters.nearest(rows, many, ["v"], "id").collect()
    assert [(r["nearest"], r["distance"]) for r in got] == [(0, 0.0), (2, pytest.approx(0.4)), (1234, 0.5), (2499, 0.0), (2499, 7500.0), (0, None)]
    assert clusters.nearest(rows, many.where("false"), ["v"], "id").where("nearest is null").count() == 6


def test_nearest_rank(spark):
    rows = spark.range(1, 201).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("v"), "id")
    got = domain.quantile_rows(rows, ["k"], "v", "id", {"p": 0.1}).where("rank = p").collect()
    assert [r["v"] for r in got] == [21.0]


def test_histogram_edges(spark):
    rows = spark.createDataFrame([(0.0,), (10.0,), (10.0,), (None,)], "v double")
    assert sorted((r["bin"], r["n"]) for r in measure.histogram(rows, "v").collect()) == [(0, 1), (9, 2)]
    same = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    assert [(r["bin"], r["lo"], r["hi"], r["n"]) for r in measure.histogram(same, "v").collect()] == [(0, 3.0, 3.0, 2)]


def test_malformed_messages(spark):
    rows = spark.createDataFrame([('{"kwh": "abc", "ok": true, "n": 5}',), ("nonsense",), (None,)], "m string")
    good, bad = messages.quarantined(rows, "m", "kwh string, n long")
    assert bad.count() == 2 and good.count() == 1
    first = good.select(*messages.numeric_fields(F.col("m"), ["kwh"]), messages.passed_through(F.col("m"), ["kwh"]).alias("p")).first()
    assert first["kwh"] == 0.0 and first["p"] == {"ok": "true", "n": "5"}
    with pytest.raises(Exception, match="missing"):
        good.select(*messages.numeric_fields(F.col("m"), ["none"])).collect()


def test_interceptors_and_csv(spark, tmp_path):
    row = spark.createDataFrame([("hello e4",)], "v string").select(messages.produced(F.col("v")).alias("p"), messages.consumed(F.col("v")).alias("c")).first()
    assert (row["p"], row["c"]) == ("h3ll0 34 X", "h3llo 3x")
    got = spark.createDataFrame([("1.5",), ("-2",), ("x",)], "v string").select(*messages.number_or_text(F.col("v"))).collect()
    assert [tuple(r) for r in got] == [(1.5, None), (None, "-2"), (None, "x")]
    tables.write(spark.createDataFrame([(1, "a")], "i long, s string"), "csv", str(tmp_path / "c"))
    assert [tuple(r) for r in tables.read(spark, "csv", str(tmp_path / "c"), "i long, s string").collect()] == [(1, "a")]


def test_history_goes_on(spark):
    rows = spark.createDataFrame([(5,), (3,)], "t long")
    first = tables.append_history(None, rows, "t")
    assert sorted((r["t"], r["seq"]) for r in first.collect()) == [(3, 1), (5, 2)]
    assert sorted(r["seq"] for r in tables.append_history(first, rows, "t", slice_of=F.floor(F.col("t") / 4)).collect()) == [3, 4]


def test_generators(spark):
    for name in generators.GENERATORS:
        df = generators.generated(name, spark.range(200))
        assert df.count() == 200 and canonical(df.collect()) == canonical(generators.generated(name, spark.range(200)).collect())
    sessions = generators.ev_sessions(spark.range(500))
    assert sessions.where("end_time_loading < start_time_loading or end_time_loading > 1440 or kwh not between 10 and 100").count() == 0
    a, b = generators.noised_pair(sessions)
    assert measure.difference(a, b, "ae_session_id", "kwh", "ae_session_id").where("noise != 0").count() == 500
    with pytest.raises(ValueError):
        generators.generated("none", spark.range(1))


def test_forecast(spark):
    plans_ = spark.createDataFrame([(1430, 30, 50.0), (10, 20, 5.0)], "start int, duration int, demand double")
    params = forecast.parameters(plans_, "start", "duration", "demand")
    first = forecast.simulate(spark, params, days=40, seed=1)
    assert sorted(r["window"] for r in first.collect()) in ([0, 1], [0, 1, 2])
    assert forecast.utility(first, forecast.simulate(spark, params, days=40, seed=1)).where("difference > 1e-9").count() == 0
    grid = forecast.minute_grid(spark.createDataFrame([(0, 1438, 4)], "d long, s int, m int"), "d", "s", "m", F.lit(1.0))
    assert sorted((r["day"], r["minute"], r["carried"]) for r in grid.collect()) == [(0, 1438, False), (0, 1439, False), (1, 0, True), (1, 1, True)]


def test_service_catalogue_and_runs(spark, sf, tmp_path):
    import json

    rows = spark.createDataFrame([(i, 10 + i, 30, 5.0) for i in range(20)], "o long, s int, d int, e double")
    got = forecast.answer(spark, rows, "s", "d", "e", "o")
    assert got and set(json.loads(got[0])) == {"window", "pipo", "demand", "power"}
    assert "events" in tables.catalogue(spark, sf)
    for name in ("a", "b"):
        (tmp_path / f"{name}.csv").write_text("x,y\n1,2\n")
    assert sorted(tuple(r) for r in tables.runs(spark, str(tmp_path / "*.csv"), "x long, y long").collect()) == [(1, 2, "a"), (1, 2, "b")]
    tables.sample_csv(spark.range(9), str(tmp_path / "out"), 4)
    assert tables.read(spark, "csv", str(tmp_path / "out"), "id long").count() == 4


def test_memory_sink(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "in"))
    source = tables.stream(spark, "parquet", str(tmp_path / "in"), "id long")
    tables.write_stream(source, "memory", "seen_rows", str(tmp_path / "check")).awaitTermination()
    assert spark.table("seen_rows").count() == 3


def test_hashed_laplace_has_its_scale(spark):
    got = spark.range(20000).select(noise.laplace(noise.hashed_uniform(1, F.col("id")), 3.0).alias("x")).agg(F.avg("x").alias("m"), F.avg(F.abs("x")).alias("a")).first()
    assert abs(got["m"]) < 0.15 and abs(got["a"] - 3.0) < 0.15


def test_plan_reads_only_needed_columns(spark, sf):
    plan = plans.k_size(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan


def test_messages_with_keys_and_times(spark):
    rows = spark.createDataFrame([("a", 1.5)], "ae_session_id string, kwh double")
    got = tables.produced(rows, "ae_session_id").first()
    value = json.loads(got["value"])
    assert got["key"] == "a" and value["kwh"] == 1.5 and abs(value["producer_timestamp"] / 1000 - time.time()) < 600


def test_pipeline_passes_fields_through(spark):
    rows = spark.createDataFrame([(f'{{"id": "{i}", "t": {i}, "v": {i * 1.5}, "w": 2, "name": "n{i}", "ok": true}}',) for i in range(30)] + [("nonsense",), (None,)], "value string")
    base = "anonymized_fields=v,w\nid=id\norder=t\nalgorithm="
    for algorithm, config in (("castleguard", CastleConfig(k=2, l=1, delta=3, headers=("v", "w"))), ("doca", DocaConfig(delay=3, headers=("v", "w"))), ("doca-alt", None)):
        pipeline = PipelineConfig.from_properties(base + algorithm)
        assert type(adapters.by_name(pipeline)).__name__ == {"castleguard": "CastleConfig", "doca": "DocaConfig", "doca-alt": "DocaAltConfig"}[algorithm]
        out = [json.loads(r["value"]) for r in adapters.piped(rows, "value", pipeline, config, flush=True).collect()]
        assert len(out) > 20 and list(out[0])[:3] == ["id", "v", "w"]
        assert all(x["name"] == f"n{x['id']}" and x["t"] == x["id"] and x["ok"] == "true" for x in out)
        assert algorithm == "castleguard" or len(out) == 30
    with pytest.raises(Exception, match="missing"):
        adapters.piped(rows, "value", PipelineConfig(anonymized_fields=("none",), id="id", order="t")).collect()


def test_a_stream_through_the_pipeline(spark, tmp_path):
    rows = spark.createDataFrame([(f'{{"id": "{i}", "t": {i}, "v": {i % 7}.5, "name": "n{i}"}}',) for i in range(40)], "value string")
    rows.coalesce(1).write.text(str(tmp_path / "in"))
    pipeline = PipelineConfig(anonymized_fields=("v",), id="id", order="t")
    config = CastleConfig(k=2, l=1, delta=5, headers=("v",))
    source = tables.stream(spark, "text", str(tmp_path / "in"), "value string")
    tables.write_stream(adapters.piped(source, "value", pipeline, config), "parquet", str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    batch = adapters.piped(rows, "value", pipeline, config)
    assert canonical(spark.read.parquet(str(tmp_path / "out")).collect()) == canonical(batch.collect())


def test_k_counts_individuals(spark):
    rows = spark.createDataFrame([(i, float(i), "one", str(i)) for i in range(9)] + [(10 + i, float(i), f"p{i}", str(i)) for i in range(9)], "i long, v double, pid string, s string")
    config = CastleConfig(k=3, l=1, delta=2, headers=("v",), beta=1)
    run = lambda df, **more: adapters.anonymise_batch(adapters.prepared(df, dataclasses.replace(config, **more), "_", "i", "i", "s", "pid"), dataclasses.replace(config, **more), flush=True)
    same = rows.where("i < 9").withColumn("_", F.lit("a"))
    assert run(same).count() == 0 and run(same, shipped=True, l=1).count() == 9
    out = run(rows.withColumn("_", F.lit("a"))).join(rows.select(F.col("i").cast("string").alias("id"), "pid"), "id")
    assert out.count() > 0 and out.groupBy("cluster").agg(F.countDistinct("pid").alias("n")).where("n < 3").count() == 0


def test_metrics_as_csv_and_state_that_is_forgotten(spark, tmp_path):
    folder = tmp_path / "in"
    for part, rows in enumerate(([("a", "p", 1), ("a", "q", 2)], [("b", "p", 3)])):
        spark.createDataFrame(rows, "id string, stage string, at long").coalesce(1).write.mode("append").parquet(str(folder))
        os.utime(max(folder.glob("*.parquet"), key=os.path.getmtime), (1000 + part, 1000 + part))
    source = tables.stream(spark, "parquet", str(folder), "id string, stage string, at long", files_per_trigger=1)
    done = adapters.complete_stream(source, ["p", "q"], ["p"], 50)
    tables.write_stream_csv(done, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = tables.read(spark, "csv", str(tmp_path / "out" / "*"), "id string, seen long, complete boolean, p long, q long").collect()
    assert [tuple(r) for r in got] == [("a", 2, True, 1, 2)]


def test_observed_ranges_and_scratch(spark, monkeypatch):
    rows, seen = tables.observed(spark.range(5).selectExpr("cast(id as double) v"), "ranges", ["v"])
    rows.collect()
    assert seen.get == {"lo_v": 0.0, "hi_v": 4.0}
    assert tables.scratch(spark, "x") != tables.scratch(spark, "x")


def test_cumulative_in_slices(spark):
    rows = spark.createDataFrame([(t,) for t in (-3, -3, 0, 5, 17, 17, 40)], "t long")
    for size in (1, 7, 4096):
        got = [(r["tick"], r["total"]) for r in measure.cumulative(rows, F.col("t"), size).orderBy("tick").collect()]
        assert [t for t, _ in got] == list(range(-3, 41)) and dict(got)[-3] == 2 and dict(got)[16] == 4 and dict(got)[17] == 6 and got[-1] == (40, 7)
    assert measure.cumulative(rows.where("false"), F.col("t")).count() == 0


def test_truncated_normal(spark):
    u = lambda k: (noise.hashed_uniform(f"u{k}", F.col("id")), noise.hashed_uniform(f"v{k}", F.col("id")))
    got = spark.range(20000).select(noise.truncated_normal([u(k) for k in range(4)], 0.0, 1.0, 0.0).alias("x")).agg(F.avg("x").alias("m"), F.min("x").alias("lo"), F.avg((F.col("x") == 0).cast("int")).alias("zero")).first()
    assert abs(got["m"] - 0.798) < 0.07 and got["lo"] >= 0 and got["zero"] < 0.1

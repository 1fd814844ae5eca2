"""Records, reuse, cool-down and streams."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from storelens.operators import history as H
from storelens.operators.cooldown import cooldown_replay
from storelens.session import scratch_path
from storelens.sources.records import append_records, as_records, from_document, read_records
from storelens.sources.requests import read_requests
from storelens.streaming.cooldown import accepted_requests, rocksdb_state, write_accepted

NOW = dt.datetime(2024, 5, 2, 12, tzinfo=dt.timezone.utc)
SCHEMA = "id long, store_url string, store_name string, scraped_at timestamp, processing_time double, success boolean, insights_data string"
DOC = '{"store_url":"u","store_name":"n"}'


def records(spark, *rows):
    """Rows of (id, store, hours before NOW, time, success, document)."""
    return spark.createDataFrame(
        [(i, s, s.upper(), NOW - dt.timedelta(hours=h), t, ok, d) for i, s, h, t, ok, d in rows], SCHEMA
    )


def test_latest_records(spark):
    table = records(spark, (1, "a", 5, 1.0, True, DOC), (2, "a", 3, 1.0, True, DOC), (3, "a", 3, 1.0, True, DOC), (4, "a", 1, 1.0, False, DOC), (5, "b", 1, 1.0, False, DOC))
    assert [(r.store_url, r.id) for r in H.latest_records(table).collect()] == [("a", 3)]


def test_cached_report(spark):
    table = records(spark, (1, "https://a.com", 500, 1.0, True, DOC), (2, "https://a.com", 1, 1.0, False, "{}"))
    assert H.cached_report(table, " a.com ").first().report.store_name == "n"
    assert H.cached_report(table, "b.com").isEmpty()


@pytest.mark.parametrize("given, served", [((50, 0), (50, 0)), ((500, 20), (100, 20)), ((0, -1), (10, 0)), ((10, 20), (10, 20))])
def test_page_bounds(given, served):
    assert H.page_bounds(*given) == served


def test_history_page(spark):
    table = records(spark, *[(i, "a", i, 1.0, i % 2 == 0, DOC) for i in range(30)])
    rows = H.history_page(table, 5, 10).collect()
    assert [r.id for r in rows] == [10, 11, 12, 13, 14] and tuple(rows[0].asDict()) == H.HISTORY_FIELDS
    assert H.history_page(table, 5, 100).isEmpty()


def test_service_stats(spark):
    table = records(spark, (1, "a", 1, 2.5, True, DOC), (2, "a", 2, 3.0, True, DOC), (3, "a", 3, 1.0, False, DOC))
    assert tuple(H.service_stats(table).first()) == (3, 2, 1, 66.67, 2.17, True)
    unknown = records(spark, (1, "a", 1, None, None, DOC), (2, "a", 2, 3.0, True, DOC), (3, "a", 3, 9.0, False, DOC))
    assert tuple(H.service_stats(unknown, 2).first()) == (2, 2, 0, 100.0, 1.5, True)
    assert tuple(H.service_stats(table.where("false")).first()) == (0, 0, 0, 0.0, 0.0, False)


def test_reuse(spark):
    table = records(
        spark, (1, "https://a.com", 23.9, 1.0, True, DOC), (2, "https://b.com", 24, 1.0, True, DOC), (3, "https://c.com", 1, 1.0, False, DOC),
        (4, "https://d.com", 2, 1.0, True, DOC), (5, "https://d.com", 1, 1.0, True, "not json"), (6, "https://e.com", -1, 1.0, True, DOC),
    )
    requests, _ = read_requests(spark.createDataFrame([(f"{c}.com",) for c in "abcdef"], "website_url string"))
    stale = {r.store_url[8] for r in H.stale_requests(requests, table, NOW).collect()}
    fresh = {r.store_url[8] for r in H.fresh_hits(requests, table, NOW).collect()}
    assert stale == set("bcdf") and fresh == set("ae")


def test_requests(spark):
    rows = [("a.com", True), ("", False), (None, None), ("not-a-valid-url", False), (" https://b.com ", None)]
    valid, rejects = read_requests(spark.createDataFrame(rows, "website_url string, include_competitors boolean"))
    assert {tuple(r)[1:] for r in valid.select("website_url", "store_url", "include_competitors").collect()} == {("https://a.com", True), ("https://b.com", False)}
    assert sorted(r.reason for r in rejects.collect()) == ["Invalid website URL: not-a-valid-url", "Website URL is required", "Website URL is required"]


def test_records_survive_the_table(spark):
    reports = spark.createDataFrame(
        [("https://a.com", "A", 1714651200.25, 1.5, True, []), ("https://b.com", None, 1714651200.0, None, False, ["no page"])],
        "store_url string, store_name string, scraped_at double, processing_time double, success boolean, errors array<string>",
    )
    path = scratch_path(spark, "records")
    append_records(as_records(reports), path)
    append_records(as_records(reports.limit(1).withColumn("scraped_at", F.lit(1714737600.0))), path)
    back = read_records(spark, path)
    rows = back.withColumn("doc", from_document(F.col("insights_data"))).orderBy("store_url", "scraped_at").collect()
    assert [(r.store_url, r.success, r.error_message) for r in rows] == [("https://a.com", True, None), ("https://a.com", True, None), ("https://b.com", False, '["no page"]')]
    assert rows[0].doc.scraped_at == 1714651200.25 and rows[0].scraped_at == dt.datetime(2024, 5, 2, 12, 0, 0, 250000) and len({r.id for r in rows}) == 3
    plan = back.where("scraped_date >= '2024-05-03' and store_url = 'x' and success")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(scraped_date" in plan and "EqualTo(store_url,x)" in plan


def log(seed, stores=4, n=400, hours=400):
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    grid = [start + dt.timedelta(hours=rng.choice([rng.randint(0, hours), rng.uniform(0, hours)])) for _ in range(n)]
    return [(i, f"s{min(rng.randint(0, 9), stores - 1)}", t, rng.random() < 0.7) for i, t in enumerate(grid)]


def greedy(rows, use_success):
    last, out = {}, set()
    for i, store, ts, ok in sorted(rows, key=lambda r: (r[2], r[0])):
        if store not in last or ts - last[store] >= dt.timedelta(hours=24):
            out.add((store, i))
            if ok or not use_success:
                last[store] = ts
    return out


@pytest.mark.parametrize("chunk_rows", [10**9, 150, 20, 3])
@pytest.mark.parametrize("success", [None, "ok"])
def test_cooldown_is_greedy_for_any_chunking(spark, chunk_rows, success):
    """Small chunks force the path of busy stores; one store holds most requests."""
    for seed in range(2):
        rows = log(seed)
        table = spark.createDataFrame(rows, "id int, store_url string, ts timestamp, ok boolean").repartition(5)
        got = cooldown_replay(table, success=success, chunk_rows=chunk_rows).collect()
        assert {(r.store_url, r.id) for r in got} == greedy(rows, success is not None) and len(got) == len(set(got))


@pytest.mark.parametrize("success", [None, "ok"])
def test_cooldown_stream_agrees(spark, success):
    rows = sorted(log(9), key=lambda r: r[2])
    folder = scratch_path(spark, "log")
    schema = "id int, store_url string, ts timestamp, ok boolean"
    for i in range(4):
        spark.createDataFrame(rows[i * 100 : i * 100 + 100], schema).coalesce(1).write.mode("append").parquet(folder)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = scratch_path(spark, "accepted")
    accepted = accepted_requests(source, success=success)
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    with rocksdb_state(spark):
        write_accepted(accepted, out, scratch_path(spark, "state")).awaitTermination()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == provider
    assert {(r.store_url, r.id) for r in spark.read.parquet(out).collect()} == greedy(rows, success is not None)


def _reports(spark, *rows):
    return spark.createDataFrame(
        [(u, n, at, 1.0, True, []) for u, n, at in rows],
        "store_url string, store_name string, scraped_at double, processing_time double, success boolean, errors array<string>",
    )


def test_rerun_of_a_batch_job_does_not_double(spark):
    path = scratch_path(spark, "records")
    reports = _reports(spark, ("https://a.com", "A", 1714651200.0), ("https://b.com", "B", 1714651200.0))
    append_records(as_records(reports), path)
    append_records(as_records(reports), path)  # the same job again, another writer
    rows = read_records(spark, path).collect()
    assert sorted(r.store_url for r in rows) == ["https://a.com", "https://b.com"]


def test_retry_past_midnight_replaces_its_own_attempt(spark):
    path = scratch_path(spark, "records")
    first = _reports(spark, ("https://a.com", "A", 1714694399.0))  # 23:59:59
    again = _reports(spark, ("https://a.com", "A2", 1714694401.0))  # 00:00:01 of the next day, another id
    append_records(as_records(first), path, batch=7, writer="nightly")
    append_records(as_records(again), path, batch=7, writer="nightly")
    rows = read_records(spark, path).collect()
    assert [(r.store_name, str(r.scraped_date)) for r in rows] == [("A2", "2024-05-03")]


def test_two_streams_keep_each_others_records(spark):
    path = scratch_path(spark, "records")
    append_records(as_records(_reports(spark, ("https://a.com", "A", 1714651200.0))), path, batch=0, writer="stream-1")
    append_records(as_records(_reports(spark, ("https://b.com", "B", 1714651200.0))), path, batch=0, writer="stream-2")
    later = _reports(spark, ("https://a.com", "A-more-pages", 1714651200.0))  # same id, made again later
    append_records(as_records(later), path, batch=1, writer="stream-1")
    rows = sorted((r.store_url, r.store_name) for r in read_records(spark, path).collect())
    assert rows == [("https://a.com", "A-more-pages"), ("https://b.com", "B")]


def test_an_attempt_without_commit_is_not_read(spark):
    path = scratch_path(spark, "records")
    append_records(as_records(_reports(spark, ("https://a.com", "A", 1714651200.0))), path, writer="w")
    lost = as_records(_reports(spark, ("https://z.com", "Z", 1714651200.0)))
    lost.write.partitionBy("scraped_date").parquet(f"{path}/data/attempt=died-before-commit")
    assert [r.store_url for r in read_records(spark, path).collect()] == ["https://a.com"]

import time

from wayscore import schemas
from wayscore.functions.decisions import request_text
from wayscore.operators import scoring
from wayscore.sources import tables
from wayscore.streaming import requests as streaming

REQUESTS = [(i, f"d{i % 4}", float(i % 60) if i % 7 else None, i % 26) for i in range(200)]


def run(spark, source, results, checkpoint, **options):
    arriving = streaming.open_files(spark, source, schemas.DRIVER_REQUESTS, files_per_batch=2)
    running = streaming.start_scoring(arriving, results, checkpoint, **options)
    running.awaitTermination()
    return spark.read.parquet(results)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_stream_equals_batch_over_several_files_and_restarts(spark, tmp_path):
    source, results, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    first = spark.createDataFrame(REQUESTS[:150], schemas.DRIVER_REQUESTS)
    streaming.submit(first.repartition(5), source)
    assert rows(run(spark, source, results, checkpoint)) == rows(streaming.result_rows(first))
    # A restart scores what is new, and nothing twice.
    run(spark, source, results, checkpoint)
    streaming.submit(spark.createDataFrame(REQUESTS[150:], schemas.DRIVER_REQUESTS), source)
    after = run(spark, source, results, checkpoint)
    whole = spark.createDataFrame(REQUESTS, schemas.DRIVER_REQUESTS)
    assert rows(after) == rows(streaming.result_rows(whole))


def test_failed_requests_are_rows(spark):
    df = spark.createDataFrame(REQUESTS, schemas.DRIVER_REQUESTS)
    for row in streaming.result_rows(df).collect():
        if row["request_id"] % 7 == 0:
            assert (row["status"], row["error"], row["risk_level"]) == ("Failed", "missing input", None)
        else:
            assert row["status"] == "Success" and row["risk_level"] in ("High Risk", "Safe")


def test_text_model_on_a_stream(spark, tmp_path):
    source, results, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    df = spark.createDataFrame(REQUESTS, schemas.DRIVER_REQUESTS)
    df.repartition(3).write.parquet(source)

    def scorer(requests):
        return scoring.score_by_text(requests, request_text())

    found = run(spark, source, results, checkpoint, scorer=scorer)
    assert rows(found) == rows(streaming.result_rows(df))


def test_continuous_query_picks_up_new_files(spark, tmp_path):
    source, results, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    df = spark.createDataFrame(REQUESTS, schemas.DRIVER_REQUESTS)
    df.limit(0).write.parquet(source)
    arriving = streaming.open_files(spark, source, schemas.DRIVER_REQUESTS)
    running = streaming.start_scoring(arriving, results, checkpoint, continuous=True)
    try:
        streaming.submit(df, source)
        running.processAllAvailable()
        assert running.isActive
        assert spark.read.parquet(results).count() == 200
    finally:
        running.stop()
        time.sleep(0.1)


def test_request_status(spark):
    df = spark.createDataFrame(REQUESTS, schemas.DRIVER_REQUESTS)
    done = streaming.result_rows(df.filter("request_id < 100"))
    status = streaming.request_status(df, done)
    assert status.count() == 200
    for row in status.collect():
        if row["request_id"] >= 100:
            assert (row["status"], row["risk_level"]) == ("Pending", None)
        else:
            assert row["status"] == ("Success" if row["request_id"] % 7 else "Failure")


def test_given_events_as_a_stream(spark, given, tmp_path):
    arriving = streaming.open_files(spark, f"{given}/events*.parquet", schemas.EVENTS)
    running = streaming.start_scoring(
        tables.driver_requests(arriving), str(tmp_path / "out"), str(tmp_path / "state")
    )
    running.awaitTermination()
    batch = streaming.result_rows(tables.driver_requests(tables.events(spark, given)))
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(batch)

"""The log as a stream: published batches, replays, identical batches, day counts and late rows."""

import pytest

from assayframe.operators import log_results
from assayframe.streaming import store
from assayframe.streaming.watch import day_counts, late_rows, log_stream, publish_rest, watch_days, watch_results, watch_summary

COLUMNS = ("experiment_id", "sample_id", "measurement_type", "value", "units")


def _rows(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


@pytest.fixture
def log(tables):
    rows = [{"experiment_id": f"E{i % 3}", "timestamp": f"2024-01-0{1 + i // 3}T10:00:00", "pH": str(i % 2), "observation": f"conversion {60 + i}%"} for i in range(9)]
    return tables.fill("daily_log", rows)["daily_log"]


def test_watch_equals_the_batch_run(spark, tables, log, tmp_path):
    path, source = str(tmp_path / "store"), str(tmp_path / "log")
    log.coalesce(1).write.parquet(source)
    for checkpoint in ("c1", "c2"):  # the second watch sees the same file again and adds nothing
        watch_results(log_stream(spark, source, 1), path, str(tmp_path / checkpoint)).awaitTermination()
    assert _rows(store.stored(spark, path)) == _rows(log_results.daily_log_results(tables))
    summary = watch_summary(spark, path).first()
    assert (summary["batches"], summary["applied_batches"], summary["identical_batches"]) == (2, 1, 1)
    assert summary["rows"] == store.stored(spark, path).count() > 0


def test_replay_and_death_between_rows_and_signature(spark, tables, log, tmp_path, monkeypatch):
    path, name = str(tmp_path / "store"), store.batch_name("watch", 0)
    want = _rows(log_results.daily_log_results(tables))
    create = spark.createDataFrame

    def die(data, schema=None, *more, **named):
        if schema == store.SIGNATURE:
            raise OSError("lost")
        return create(data, schema, *more, **named)

    with monkeypatch.context() as m:
        m.setattr(spark, "createDataFrame", die)
        with pytest.raises(OSError):
            store.publish(log, path, name)
    assert store.stored(spark, path).count() == 0  # written, but not part of the store
    assert store.publish(log, path, name) == "applied" and _rows(store.stored(spark, path)) == want
    assert store.publish(log, path, name) == "replayed" and _rows(store.stored(spark, path)) == want
    assert store.publish(log, path, store.batch_name("watch", 1)) == "identical" and _rows(store.stored(spark, path)) == want


def test_batches_see_stored_and_other_results(spark, tables, log, tmp_path):
    path = str(tmp_path / "store")
    tables.fill("results", [{"experiment_id": "E0", "sample_id": "S", "measurement_type": "conversion", "value": "60", "units": "%"}])
    want = _rows(log_results.daily_log_results(tables))
    for k in range(3):
        store.publish(log.where(f"timestamp like '2024-01-0{k + 1}%'"), path, store.batch_name("w", k), tables["results"])
    assert _rows(store.stored(spark, path)) == want
    plan = store.stored(spark, path, [0])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "(bucket" in plan.split("PartitionFilters: [", 1)[1].split("PushedFilters", 1)[0]  # only its folders are read


def test_day_counts_and_late_rows(spark, tables, tmp_path):
    source, out = str(tmp_path / "log"), str(tmp_path / "days")
    at = lambda day, n: [{"experiment_id": "E", "timestamp": f"2024-01-{day:02d}T1{k}:00:00", "observation": "x"} for k in range(n)]
    batches = [at(1, 3) + [{"experiment_id": "E", "timestamp": "no time", "observation": "x"}], at(2, 2), at(9, 1), at(1, 2) + at(20, 1), at(21, 1)]
    query = None
    for k, rows in enumerate(batches):  # one batch after another, so the watermark moves between them
        tables.fill("daily_log", rows)
        tables["daily_log"].coalesce(1).write.mode("append").parquet(source)
        query = day_counts(log_stream(spark, source)).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
    days = {r.day: r.observations for r in spark.read.parquet(out).collect()}
    assert days["2024-01-01"] == 3 and days["2024-01-02"] == 2 and days["2024-01-09"] == 1
    late = late_rows(spark.read.parquet(source), spark.read.parquet(out)).collect()
    assert [(r.day, r.observations, r.counted) for r in late] == [("2024-01-01", 5, 3)]


def _walk(rows):
    """(sample, value) of the rows a reader keeps who walks (day, row number) and drops repeats of either key."""
    samples, values, out = set(), set(), []
    for day, _, e, field, stamp, value in sorted(rows):
        sample, worth = (e, stamp, field), (e, field, value)
        if sample not in samples and worth not in values:
            samples.add(sample), values.add(worth), out.append((e, value))
    return sorted(out)


@pytest.mark.parametrize("arrival", ["in order", "backwards", "interleaved"])
def test_days_in_any_order_of_arrival(spark, tables, tmp_path, arrival):
    """Chains of both keys over days and repeats within them: the store is that of the walk, and so of the batch run."""
    cells = [  # (day, hour, pH): repeats of a time, of a value, and of values whose row was dropped itself
        (1, 8, "5"), (1, 8, "6"), (1, 9, "6"), (1, 9, "5"), (1, 8, "5"), (2, 8, "5"), (2, 9, "7"), (2, 9, "6"), (3, 8, "7"), (3, 8, "8"),
        (3, 9, "8"), (3, 10, "9"), (4, 8, "9"), (4, 8, "10"), (4, 9, "10"), (5, 7, "11"),
    ]
    rows = [{"experiment_id": "E", "timestamp": f"2024-01-{d:02d}T{h:02d}:00:00", "pH": v} for d, h, v in cells]
    rows += [{"experiment_id": "F", "timestamp": "2024-01-02T08:00:00", "pH": "5"}, {"experiment_id": "E", "timestamp": "no time", "pH": "12"}]
    log = tables.fill("daily_log", rows)["daily_log"]
    whole = _rows(log_results.daily_log_results(tables))
    n = len(rows)
    order = {"in order": list(range(n)), "backwards": list(range(n))[::-1], "interleaved": sorted(range(n), key=lambda i: (i % 3, -i))}[arrival]
    source, path = str(tmp_path / "log"), str(tmp_path / "store")
    keys = [f"{i:06d}" for i in order]
    run = lambda: watch_days(log_stream(spark, source, 1), path, str(tmp_path / "c"), "10 days").awaitTermination()
    for k in range(0, n, 6):  # every file is a micro-batch
        log.where(log.row_key.isin(keys[k:k + 6])).coalesce(1).write.mode("append").parquet(source)
    run()
    assert store.stored(spark, path).count() == 0  # the watermark has passed no day yet
    tables.fill("daily_log", [{"experiment_id": "", "timestamp": "2024-03-01T00:00:00"}])["daily_log"].coalesce(1).write.mode("append").parquet(source)
    run()
    got = _rows(store.stored(spark, path))
    assert got == [r for r in whole if r[3] != "12"]  # a row without a time belongs to no day
    assert sorted((r[0], r[3]) for r in got) == _walk(
        (r["timestamp"][:10], i, r["experiment_id"], "pH", r["timestamp"], r["pH"]) for i, r in enumerate(rows) if r["timestamp"] != "no time")
    late = tables.fill("daily_log", [{"experiment_id": "E", "timestamp": "2024-01-02T12:00:00", "pH": "13"}])["daily_log"]
    late.coalesce(1).write.mode("append").parquet(source)
    run()
    assert _rows(store.stored(spark, path)) == got  # later than the watermark
    assert publish_rest(log.unionByName(late), path, "rest") == "applied"
    assert sorted(r[3] for r in _rows(store.stored(spark, path))) == sorted([*[r[3] for r in got], "12", "13"])

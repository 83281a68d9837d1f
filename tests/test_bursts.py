"""Bursts in keyed state: the same bursts and refresh points, whether or not the stream is stopped in between."""

import datetime as dt
import random

import pytest

from cairn.streaming import bursts as B, watch

START = dt.datetime(2024, 1, 1)


def expected(events, quiet, refresh, count):
    """A loop over the events of each root in time order."""
    out, by = set(), {}
    for root, path, op, at in events:
        by.setdefault(root, []).append((at, path, op))
    for root, rows in by.items():
        rows.sort()
        groups = []
        for at, path, op in rows:
            if not groups or at - groups[-1][-1][0] > quiet:
                groups.append([])
            groups[-1].append((at, path, op))
        refreshed, since = None, 0
        for n, group in enumerate(groups):
            end = group[-1][0] + quiet
            due = refreshed is None or end - refreshed >= refresh or since + 1 >= count
            refreshed, since = (end, 0) if due else (refreshed, since + 1)
            for path in {p for _, p, _ in group}:
                out.add((root, path, "changed" if any(o == "changed" for _, p, o in group if p == path) else "deleted", n, due))
    return out


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(name)


@pytest.mark.parametrize("stops", [1, 3])
def test_bursts_and_refresh_points(rocks, tmp_path, stops):
    spark, rng, now, events = rocks, random.Random(1), 0, []
    for _ in range(60):
        now += rng.choice([50, 100, 400, 700, 2500])
        events.append((rng.choice("ab"), f"p{rng.randrange(4)}", rng.choice(["changed", "deleted"]), now))
    want = expected(events, 500, 4000, 4)
    done = [("z", "end", "changed", now + 60_000)]  # moves the watermark on behind all of them
    rows = [(r, p, o, START + dt.timedelta(milliseconds=at)) for r, p, o, at in events + done]
    size = -(-len(rows) // (2 * stops))
    got = []
    for k in range(stops):
        for j in (2 * k, 2 * k + 1):
            part = rows[j * size : (j + 1) * size]
            if part:
                spark.createDataFrame(part, watch.EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(watch.EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        out = B.bursts(stream, 500, 4, 4)
        out.writeStream.foreachBatch(lambda df, n: got.extend(tuple(r) for r in df.collect())).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    assert len(got) == len(set(got))
    assert {g for g in got if g[0] != "z"} == want

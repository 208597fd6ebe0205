"""T2 with a horizon: expiry, lateness, restarts, ties, and the processor against a plain reading of the rule."""
import random
import uuid
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from gazette.session import shared_path
from gazette.streaming.first_seen import LATE, NO_TIME, FirstSeen, write_first_seen

HOUR = 3600
SCHEMA = "page_id long, url string, html string, seen_at timestamp, batch long"
DAY = datetime(2024, 5, 1, tzinfo=timezone.utc)


def _run(spark, batches, horizon=HOUR):
    """Each batch arrives as files of its own and is read by a stream started anew on the same folders."""
    run = uuid.uuid4().hex
    src, sink = shared_path(spark, f"seen-src-{run}"), shared_path(spark, f"seen-out-{run}")
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{src}/{k}")
        pages = spark.readStream.schema(SCHEMA).parquet(f"{src}/*")
        write_first_seen(pages, sink, f"{sink}-checkpoint", horizon, "seen_at").awaitTermination()
    return sorted((r.page_id, r.reject_reason) for r in spark.read.schema(SCHEMA + ", reject_reason string").parquet(sink).collect())


def _at(minutes):
    return None if minutes is None else DAY + timedelta(minutes=minutes)


def _rows(*rows):
    return [(i, url, "x", _at(m), None) for i, url, m in rows]


def test_horizon_lateness_and_restart(spark):
    got = _run(spark, [
        _rows((1, "http://a/", 0), (2, "HTTP://A/ ", 30), (3, "http://b/", 10), (4, None, 5), (5, " ", 6), (6, "http://c/", None)),
        # a: seen at minute 30 before a restart; 80 is within the hour of that, 200 is not
        _rows((10, "http://a/", 80), (11, "http://a/", 200), (12, "http://d/", 300), (12, "http://d/", 300)),
        # the watermark is at 240: 239 is late, 240 is not; d goes on
        _rows((20, "http://b/", 239), (21, "http://b/", 240), (22, "http://d/", 359), (23, "http://a/", 1000)),
        _rows((30, "http://b/", 1000), (31, "http://d/", 1000)),
        []])
    assert got == [(1, None), (3, None), (4, None), (6, NO_TIME), (11, None), (12, None), (20, LATE), (21, None), (23, None),
                   (30, None), (31, None)]


class _Span:
    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, v):
        self.value = v

    def clear(self):
        self.value = None


class _Handle:
    def __init__(self):
        self.span, self.timers = _Span(), set()

    def getValueState(self, name, schema):
        return self.span

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


class _Mark:
    def __init__(self, mark):
        self.mark = mark

    def getCurrentWatermarkInMs(self):
        return self.mark


@pytest.mark.parametrize("seed", range(40))
def test_processor_against_the_rule(seed):
    """Random times over random batches: a row that is not late is first if no other one lies in the horizon before it,
    where the batches before have not put out a first row of the span it joins."""
    import pandas as pd
    rng = random.Random(seed)
    horizon, handle, top, known = 50, _Handle(), 0, []
    p = FirstSeen(horizon)
    p.init(handle)
    for _ in range(6):
        mark = max(0, top - horizon)
        times = [max(0, top + rng.randint(-120, 160)) for _ in range(rng.randint(0, 8))]
        for due in sorted(t for t in handle.timers if t < mark):
            handle.timers.remove(due)
            list(p.handleExpiredTimer(("u",), _Mark(mark), None))
        parts = [pd.DataFrame({"at": [t], "tie": [k], "row": [{"t": t, "k": k}]}) for k, t in enumerate(times)]
        out = pd.concat([pd.DataFrame({"row": [], "reject_reason": []}), *p.handleInputRows(("u",), iter(parts), _Mark(mark))])
        late = sorted(t for t in times if t < mark)
        good = sorted(t for t in times if t >= mark)
        first, seen = [], known[:]
        for t in good:
            if not any(abs(t - s) < horizon for s in seen if s <= t or s in known):
                first.append(t)
            seen.append(t)
        assert sorted(r["t"] for r in out["row"][out["reject_reason"].notna()]) == late
        assert sorted(r["t"] for r in out["row"][out["reject_reason"].isna()]) == first
        known += good
        top = max([top, *times])
        assert len(handle.timers) == (handle.span.value is not None)


def test_state_is_purged(spark):
    """Once the watermark has passed a URL's span by the horizon, its key is no longer in the store."""
    run = uuid.uuid4().hex
    src, sink = shared_path(spark, f"seen-src-{run}"), shared_path(spark, f"seen-out-{run}")
    totals = []
    for k, rows in enumerate([_rows(*[(i, f"http://{i}/", i % 7) for i in range(200)]), _rows((900, "http://z/", 10_000)), []]):
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{src}/{k}")
        q = write_first_seen(spark.readStream.schema(SCHEMA).parquet(f"{src}/*"), sink, f"{sink}-checkpoint", HOUR, "seen_at")
        q.awaitTermination()
        totals.append([s.numRowsTotal for s in (q.lastProgress.stateOperators if q.lastProgress else [])])
    n = spark.read.parquet(sink).filter(F.col("reject_reason").isNull()).count()
    assert n == 201, (n, totals)
    assert totals[0] and totals[-1] and totals[-1][0] < totals[0][0], totals


def test_registered_query(spark):
    import __spark_entry__ as E
    import duckdb
    from helpers import SF_SMALL
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SF_SMALL}/pages.parquet')")
    want = con.sql("SELECT page_id, url, at_hour, reject_reason FROM (" + E.oracle_sql()["t2_first_seen_horizon"] + ")").fetchall()
    df = E.queries()["t2_first_seen_horizon"](spark, SF_SMALL)
    got = [tuple(r) for r in df.select("page_id", "url", "at_hour", "reject_reason").collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and {r[3] for r in got} == {None, LATE}

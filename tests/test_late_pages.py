"""Records that wait for captures: against plain Python, over several runs of one checkpoint."""

import datetime as dt
import random

import pytest

from hitloom.operators.attach import NO_SNAPSHOT
from hitloom.schemas import SNAPSHOT
from hitloom.session import scratch_dir
from hitloom.sources.ndjson import read_records
from hitloom.streaming.late import WAITING, finished, stream_late_pages, write_heartbeats

START = dt.datetime(2024, 2, 1, tzinfo=dt.timezone.utc)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def stamp(seconds):
    return at(seconds).strftime("%Y-%m-%dT%H:%M:%SZ")


def record(rid, url, seconds, title="t"):
    values = {"record_id": rid, "url": url, "queued_at": at(seconds), "title": title, "snippet": rid,
              "score": 1.0, "engines": ["brave"], "cached": False}
    return tuple(values.get(name) for name in WAITING.fieldNames())


class Streams:
    """Two folders of arrivals, one checkpoint."""

    def __init__(self, spark, **options):
        self.spark, self.base, self.options = spark, scratch_dir(spark, "late"), options
        for name, schema in (("records", WAITING), ("captures", SNAPSHOT)):
            self.arrive(name, [], schema)

    def arrive(self, name, rows, schema):
        frame = self.spark.createDataFrame(rows, schema).coalesce(1)
        frame.write.mode("append").parquet(f"{self.base}/{name}")

    def run(self, records=(), captures=(), beat=None):
        self.arrive("records", list(records), WAITING)
        self.arrive("captures", list(captures), SNAPSHOT)
        if beat is not None:
            write_heartbeats(self.spark, at(beat), f"{self.base}/records", f"{self.base}/captures")
        folders = [f"{self.base}/{name}" for name in ("records", "captures", "out", "checkpoint")]
        finished(stream_late_pages(self.spark, *folders, **self.options))
        rows = read_records(self.spark, f"{self.base}/out").collect()
        return sorted((r.snippet, r.title, r.raw_html, r.error) for r in rows)


def parsed(text):
    return dt.datetime.fromisoformat(text.replace("Z", "+00:00")) if text and text.endswith("Z") else None


def plain(records, captures, wait, age):
    """Each record with the capture scraped last of those in its time."""
    columns, out = WAITING.fieldNames(), []
    for row in records:
        r = dict(zip(columns, row))
        if not r["url"]:
            out.append((r["record_id"], r["title"], None, None))
            continue
        low, high = r["queued_at"] - dt.timedelta(seconds=age), r["queued_at"] + dt.timedelta(seconds=wait)
        near = [(c[3], c[1] or "", c[2] or "", c[4] or "") for c in captures
                if c[0] == r["url"] and parsed(c[3]) and low <= parsed(c[3]) <= high]
        if not near:
            out.append((r["record_id"], r["title"], None, NO_SNAPSHOT))
            continue
        _, title, html, error = max(near)
        out.append((r["record_id"], title or r["title"], html or None, error or None))
    return sorted(out)


def test_a_record_waits_for_its_capture(spark):
    streams = Streams(spark, wait=30, disorder=10)
    early, late = ("u1", "one", "<p>1", stamp(5), ""), ("u2", "", "<p>2", stamp(28), "")
    waiting = [record("a", "u1", 0), record("b", "u2", 0), record("c", "u3", 0), record("d", "", 0)]
    # Nothing leaves while a later capture may still come.
    assert streams.run(waiting, [early]) == []
    # The second capture comes in a later run, with a clock that passes only its time.
    assert streams.run([], [late], beat=38) == []
    got = streams.run(beat=60)
    assert got == [("a", "one", "<p>1", None), ("b", "t", "<p>2", None), ("c", "t", None, NO_SNAPSHOT),
                   ("d", "t", None, None)]
    # What has left does not leave again; the state is free for the next record of the URL.
    assert streams.run([record("e", "u1", 62)], [("u1", "new", "<p>3", stamp(70), "")], beat=200) == [
        *got, ("e", "new", "<p>3", None)]


def test_against_plain_python(spark):
    rng = random.Random(3)
    urls = [f"https://x/{n}" for n in range(6)] + ["", None, "https://x/0"]
    records = [record(f"r{n:03d}", rng.choice(urls), rng.randrange(100), rng.choice(["t", "ü"])) for n in range(60)]
    captures = [(rng.choice(urls), rng.choice(["", None, f"c{n}"]), rng.choice(["", f"<p>{n}"]), stamp(rng.randrange(140)),
                 rng.choice(["", "", "navigate: timeout"])) for n in range(40)]
    captures += [captures[0], ("https://x/1", "no time", "<p>", "soon", ""), ("https://x/1", "no time", "<p>", None, "")]
    streams = Streams(spark, wait=20, age=5, disorder=200, salts=3)
    assert streams.run(records[:30], captures[20:]) == []
    # Equal rows that came before, and captures older than all, are still in time.
    assert streams.run([records[0], *records[30:]], captures[:20]) == []
    assert streams.run(beat=1000) == plain(records, captures, 20, 5)


def test_rows_beyond_the_disorder_stop_the_run(spark):
    streams = Streams(spark, wait=5, disorder=10)
    streams.run([record("a", "u", 100)], beat=100)
    with pytest.raises(ValueError, match="later than the disorder"):
        streams.run([record("b", "u", 1)], beat=101)


def test_a_record_without_id_stops_the_run(spark):
    streams = Streams(spark)
    with pytest.raises(Exception, match="lacks record_id"):
        streams.run([record(None, "u", 0)])


def test_bodies_are_read_once(spark):
    """Each capture file belongs to one batch: no run lists a body it has read before."""
    streams = Streams(spark, wait=30, disorder=10)
    streams.run([record("a", "u1", 0)], [("u1", "one", "<p>1", stamp(5), "")])
    folders = [f"{streams.base}/{name}" for name in ("records", "captures", "out", "checkpoint")]
    write_heartbeats(spark, at(100), *folders[:2])
    query = finished(stream_late_pages(spark, *folders, **streams.options))
    assert sum(p.numInputRows for p in query.recentProgress) == 2  # the heartbeats
    assert [r.raw_html for r in read_records(spark, folders[2]).collect()] == ["<p>1"]

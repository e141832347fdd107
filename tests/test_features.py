from datetime import datetime, timezone

from tracequarry.streaming import features

T = [datetime(2026, 1, 1, 0, 0, i, tzinfo=timezone.utc) for i in range(10)]


def write(spark, path, rows):
    cols = [x.split()[0] for x in features.EVENTS.split(", ")]
    full = [tuple(r.get(c) for c in cols) for r in rows]
    spark.createDataFrame(full, features.EVENTS).coalesce(1).write.mode("append").parquet(path)


def test_incremental_equals_all_at_once(spark, tmp_path):
    catalog = spark.createDataFrame([("Read",), ("mcp__repohub__get_file",)], "tool_name string")
    e = lambda i, kind, at=None, tool=None, ms=None, s="s": dict(session_id=s, event_id=f"e{i}", event_type=kind, timestamp=at, tool_name=tool, duration_ms=ms)
    first = [e(1, "User", T[1]), e(2, "tool_use", T[2], "tool_Read", 5), e(3, "Tool", T[3], None, -4), e(4, "human", None), e(9, "user", T[1], s=None)]
    second = [e(1, "human", T[8]), e(2, "tool", T[4], " READ", 5), e(5, "tool-use", T[5], "repohub.get-file", 7), e(6, "tool", T[6], "Unheard", None), e(7, "tool", None, " "), e(8, None, T[0])]
    path, folder = str(tmp_path / "in"), str(tmp_path / "state")
    write(spark, path, first)
    a = features.event_features(spark, path, catalog, folder=folder)
    assert {(r.event_key, r.n_events) for r in a.collect()} == {("user", 2), ("tool:Read", 1), ("tool:unknown", 1)}
    write(spark, path, second)
    b = {(r.event_key, r.n_events, r.last_us, r.duration_ms) for r in features.event_features(spark, path, catalog, folder=folder).collect()}
    us = lambda t: int(t.timestamp() * 1e6)
    want = {("user", 2, us(T[8]), 0), ("tool:Read", 1, us(T[4]), 5), ("tool:unknown", 2, us(T[3]), 0), ("tool:mcp__repohub__get_file", 1, us(T[5]), 7), ("tool:Unheard", 1, us(T[6]), 0), ("unknown", 1, us(T[0]), 0)}
    assert b == want
    c = {(r.event_key, r.n_events, r.last_us, r.duration_ms) for r in features.event_features(spark, path, catalog, folder=str(tmp_path / "again")).collect()}
    assert c == want
    w = features.wide(spark.createDataFrame([("s", *x) for x in want], features.FEATURES)).first()
    assert w.total_events == 8 and w.n_events["user"] == 2


def test_redelivery_with_another_duration(spark, tmp_path):
    catalog = spark.createDataFrame([("Read",)], "tool_name string")
    e = lambda i, ms, at=1: dict(session_id="s", event_id=f"e{i}", event_type="tool", timestamp=T[at], tool_name="Read", duration_ms=ms)
    batches = [[e(1, 5), e(2, None), e(3, -1), e(4, 9), e(5, 8)], [e(1, 7), e(1, 6), e(2, 3), e(4, 2), e(6, 1)], [e(1, 12), e(2, 1), e(3, 4), e(5, None), e(4, 9)], [e(1, 11, 2)]]
    path, folder = str(tmp_path / "in"), str(tmp_path / "state")
    read = lambda f: [(r.n_events, r.last_us, r.duration_ms) for r in features.event_features(spark, path, catalog, folder=f).collect()]
    got = []
    for rows in batches:
        write(spark, path, rows)
        got += read(folder)
    us = lambda t: int(t.timestamp() * 1e6)
    assert got == [(5, us(T[1]), 22), (6, us(T[1]), 28), (6, us(T[1]), 37), (6, us(T[2]), 37)]
    assert read(str(tmp_path / "again")) == got[-1:]


def test_restart_late_copy_and_folds(spark, tmp_path, monkeypatch):
    """Many batches with late copies, one of which fails half way and is run again, give what all at once gives; old versions are removed."""
    monkeypatch.setattr(features, "FOLD", 2)
    catalog = spark.createDataFrame([("Read",)], "tool_name string")
    e = lambda i, ms, at=1, s="s": dict(session_id=s, event_id=f"e{i}", event_type="tool" if i % 2 else "user", timestamp=T[at], tool_name="Read", duration_ms=ms)
    path, folder = str(tmp_path / "in"), str(tmp_path / "state")
    rows = []
    for n in range(6):
        new = [e(i, 10 * n + i, n, "st"[i % 3 > 0]) for i in range(n, n + 5)] + [e(0, n, 9 - n)]
        rows += new
        write(spark, path, new)
        if n == 3:
            with monkeypatch.context() as m:
                m.setattr(features, "_merged", lambda *a: 1 / 0)
                try:
                    features.event_features(spark, path, catalog, folder=folder)
                    raise AssertionError("it should have failed")
                except AssertionError:
                    raise
                except Exception:
                    pass
        got = {tuple(r) for r in features.event_features(spark, path, catalog, folder=folder).collect()}
        want = {tuple(r) for r in features.batch_features(spark.read.schema(features.EVENTS).parquet(path), catalog).collect()}
        assert got == want
    assert len([p for p in (tmp_path / "state" / "features").iterdir() if p.name[0] == "v"]) <= 3
    assert {tuple(r) for r in features.event_features(spark, path, catalog, folder=str(tmp_path / "once")).collect()} == want
    assert {tuple(r) for r in features.event_features(spark, path, catalog, folder=str(tmp_path / "short"), forget_after="10 days").collect()} == want


def test_empty(spark, tmp_path):
    write(spark, str(tmp_path / "in"), [])
    assert features.event_features(spark, str(tmp_path / "in"), spark.createDataFrame([("Read",)], "tool_name string"), folder=str(tmp_path / "f")).count() == 0

import random
from datetime import datetime, timedelta, timezone

from tracequarry.operators import sessions

T0 = datetime(2026, 1, 1, tzinfo=timezone.utc)
MIN = 60_000_000


def brute(rows, gap):
    by = {}
    for k, t in rows:
        if k is not None and t is not None:
            by.setdefault(k, []).append(t)
    out = set()
    for k, ts in by.items():
        ts.sort()
        a = [ts[0]]
        for t in ts[1:]:
            if t - a[-1] > gap:
                out.add((k, a[0], a[-1], len(a)))
                a = []
            a.append(t)
        out.add((k, a[0], a[-1], len(a)))
    return out


def test_chunks_do_not_matter(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "b", "b", "b", None]), r.choice([None, r.randrange(0, 5000) * MIN, r.randrange(0, 50) * 30 * MIN, -r.randrange(1, 900) * MIN])) for _ in range(1500)] + [("c", 7)] * 3
    df = spark.createDataFrame([(*x, "clash") for x in rows], "k string, t long, n string")
    for chunk in (10 * MIN, 31 * MIN, 360 * MIN):
        got = {tuple(x) for x in sessions.gap_sessions(df, key="k", time_us="t", chunk_us=chunk).collect()}
        assert got == brute(rows, 30 * MIN)
    assert sessions.gap_sessions(df.limit(0), key="k", time_us="t").count() == 0


def test_exact_gap_stays_and_copies_count_once(spark, make_spans):
    at = lambda m: T0 + timedelta(minutes=m)
    df = make_spans(*({"user_id": "u", "trace_id": t, "span_id": s, "start_time": at(m)} for t, s, m in (("t", "a", 0), ("t", "a", 0), (None, "b", 30), (None, "b", 30), ("t", "c", 60.01))), {"user_id": "u"}, {"start_time": at(1)})
    got = sorted((r.start_us - int(T0.timestamp() * 1e6), r.n_spans) for r in sessions.working_sessions(df).collect())
    assert got == [(0, 2), (int(60.01 * MIN), 1)]

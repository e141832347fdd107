"""Windows that are cut into chunks give what whole windows give, also with a third of the rows in one key; no plan gathers or windows a hot key whole."""

import random
from datetime import datetime, timedelta, timezone

import pytest

from tracequarry.operators import links, metrics, sessions

T0 = datetime(2026, 1, 1, tzinfo=timezone.utc)


def rows(n=160, seed=3):
    r = random.Random(seed)
    out = []
    for i in range(n):
        s = "hot" if i % 3 == 0 else r.choice(["a", "b", "c", None])
        out.append({
            "session_id": s, "name": r.choice(["Claude_Code_Tool_Read", "Claude_Code_Tool_Bash", "request timeout"]), "input_value": r.choice(["x", "x", "y", "", None]), "status_code": r.choice(["OK", "OK", "ERROR", None]),
            "raw_attributes": r.choice(["{}", '{"a":1}', None]), "start_time": T0 + timedelta(minutes=r.randrange(3000)), "llm_token_count_total": r.choice([None, 5]),
        })
    return out


def brute_failures(data, around):
    by = {}
    for i, x in enumerate(data):
        by.setdefault(x["session_id"], []).append((i + 1, x))
    out = []
    for s, xs in by.items():
        for k, (i, x) in enumerate(xs):
            before = xs[max(0, k - around) : k]
            kinds = ["error"] if x["status_code"] == "ERROR" else ["timeout"] if "timeout" in x["name"] else []
            if before:
                y = before[-1][1]
                same = x["name"] == y["name"] and (bool(x["input_value"]) and x["input_value"] == y["input_value"] or bool(x["raw_attributes"]) and x["raw_attributes"] == y["raw_attributes"])
                kinds += ["back_to_back"] * same
            out += [(i, s, f, ",".join(str(j) for j, _ in before)) for f in kinds]
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk", [1, 7, 100_000])
def test_failures_in_ranges(make_spans, monkeypatch, chunk):
    data = rows()
    whole = metrics.before_in_session
    monkeypatch.setattr(metrics, "before_in_session", lambda s, n: whole(s, n, chunk=chunk))
    for around in (1, 3):
        got = sorted((tuple(r) for r in metrics.failures(make_spans(*data), around=around).collect()), key=str)
        # categories: all names here are tools or unknown, by name alone, so equal names have equal categories
        assert got == brute_failures(data, around)
    assert metrics.failures(make_spans(*data).limit(0)).count() == 0


def test_failure_by_message(make_spans):
    from pyspark.sql import functions as F

    df = make_spans({"session_id": "s", "name": "x", "status_code": "OK"}).withColumn("status_message", F.lit("Rate limit reached"))
    assert [r.failure for r in metrics.failures(df).collect()] == ["rate_limit"]


@pytest.mark.parametrize("chunk", [60_000_000, 3_600_000_000, 10**15])
def test_blocks_and_intervals_in_chunks(spark, make_spans, chunk):
    from pyspark.sql import functions as F

    data = rows(120, 8)
    df = make_spans(*data).withColumn("us", F.unix_micros("start_time"))
    got = {tuple(r) for r in sessions.gap_sessions(df, key="session_id", time_us="us", chunk_us=chunk, sums=("llm_token_count_total",), numbered=True).collect()}
    want = set()
    for s in {x["session_id"] for x in data} - {None}:
        xs = sorted((int(x["start_time"].timestamp() * 1e6), x["llm_token_count_total"] or 0) for x in data if x["session_id"] == s)
        block, run = 1, [xs[0]]
        for x in [*xs[1:], None]:
            if x is None or x[0] - run[-1][0] > 30 * 60_000_000:
                want.add((s, run[0][0], run[-1][0], len(run), sum(t for _, t in run), block))
                block, run = block + 1, [x]
            else:
                run.append(x)
    assert got == want
    r = random.Random(1)
    spans = [(r.choice(["hot", "hot", "k", None]), a, a + r.choice([0, 1, 5, 40, 400])) for a in (r.randrange(20_000) for _ in range(150))] + [("k", 5, 1), ("k", None, 3)]
    iv = spark.createDataFrame(spans, "k string, a long, b long")
    got = {tuple(x) for x in links.merge_intervals(iv, key="k", start="a", end="b", chunk_us=max(1, chunk // 10**6)).collect()}
    want = set()
    for k in ("hot", "k", None):
        reach = None
        for a, b in sorted((a, b) for x, a, b in spans if x == k and a is not None and a <= b):
            if reach is None or a > reach[1]:
                if reach:
                    want.add((k, *reach))
                reach = (a, b)
            else:
                reach = (reach[0], max(reach[1], b))
        want.add((k, *reach))
    assert got == want


def test_no_whole_key_is_gathered(make_spans):
    """The plans of the session operators hold no function that gathers a group, and no window by session over rows with texts."""
    df = make_spans(*rows(30))
    for plan in (metrics.failures(df), links.batches(df.withColumn("n", df["id"]), key="session_id", order="id", size="n"), links.growing(df, key="session_id", order="id", count="llm_token_count_total")):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroups" not in text
        assert not any("windowspecdefinition(session_id" in x and "input_value" in x for x in text.split("\n"))


def test_containment_by_rarest_chunks(spark):
    r = random.Random(5)
    docs = {i: {f"line {x}" for x in r.sample(range(40), r.randrange(1, 14))} | ({"a common line"} if i % 3 else set()) for i in range(60)}
    df = spark.createDataFrame([(i, c) for i, cs in docs.items() for c in cs], "id long, chunk string")
    rep = {}
    for i in sorted(docs):
        rep.setdefault(frozenset(docs[i]), i)
    ids = sorted(rep.values())
    want = set()
    for a in ids:
        for b in ids:
            if a != b and (len(docs[a]), a) < (len(docs[b]), b):
                share = round(100.0 * len(docs[a] & docs[b]) / len(docs[a]), 2)
                if share >= 50:
                    want.add((a, b, share))
    assert {(x.child, x.parent, x.overlap) for x in links.containment(df).collect()} == want and want

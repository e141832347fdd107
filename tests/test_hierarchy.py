import random

import numpy as np
import pyarrow as pa
import pytest

from tracequarry.operators import hierarchy


def brute(rows):
    parent = {}
    for t, s, p in rows:
        if t is not None and s is not None:
            parent.setdefault((t, s), set()).add(p)
    parent = {k: min((x for x in v if x is not None), default=None) for k, v in parent.items()}
    out = {}
    for t, s in parent:
        seen, x = [], s
        while True:
            if x in seen:
                out[t, s] = (min(seen[seen.index(x) :]), -1, None)
                break
            seen.append(x)
            p = parent[t, x]
            if p is None or (t, p) not in parent:
                out[t, s] = (x, len(seen) - 1, list(reversed(seen)))
                break
            x = p
    return out


def forest(seed, n, traces):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        t = f"t{r.randrange(traces)}"
        p = None if r.random() < 0.1 else f"s{max(0, i - r.choice([1, 1, 1, 2, 9, 40])):05d}" if r.random() < 0.9 else f"s{r.randrange(n):05d}"
        rows.append((t, f"s{i:05d}", p))
    return rows + rows[::7] + [(None, "x", None), ("t0", None, None), ("t0", "self", "self"), ("t0", "lost", "nowhere"), ("t0", "empty", "")]


@pytest.mark.parametrize("limit", [100_000, 12])
@pytest.mark.parametrize("paths", [False, True])
def test_equals_walking(spark, limit, paths):
    rows = forest(3, 120, 3) + [("chain", f"c{i:03d}", f"c{i - 1:03d}" if i else "c029") for i in range(30)] + [("line", f"l{i:03d}", f"l{i - 1:03d}") for i in range(25)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "trace_id string, span_id string, parent_id string, depth string")
    got = {(r.trace_id, r.span_id): (r.root_id, r.depth, r.path if paths else None) for r in hierarchy.hierarchy(df, paths=paths, limit=limit, task_nodes=50).collect()}
    want = {k: v if paths else (v[0], v[1], None) for k, v in brute(rows).items()}
    assert got == want


def test_paths_from_records():
    """Paths are those of walking, and a chain of 20,000 needs no more steps than removals lie between its end and its root."""
    n = 20_000
    parent = np.r_[-1, np.arange(n - 1)]
    _, depth, _, records = hierarchy.contract(parent, np.ones(n), np.arange(n), True)
    start, flat = records.paths(np.array([n - 1, 5, 0]), depth)
    assert flat[: start[1]].tolist() == list(range(n)) and flat[start[1] : start[2]].tolist() == list(range(6)) and flat[start[2] :].tolist() == [0]
    hops, x = 0, n - 1
    while x >= 0:
        x, hops = records.to[x], hops + 1
    assert hops < 60
    r = np.random.default_rng(2)
    parent = np.array([-1] + [r.integers(max(0, i - r.choice([1, 2, 30])), i) for i in range(1, 3000)])
    _, depth, _, records = hierarchy.contract(parent, np.ones(3000), np.arange(3000), True)
    start, flat = records.paths(np.arange(3000), depth)
    for i in range(3000):
        path, x = [], i
        while x >= 0:
            path.append(x)
            x = parent[x]
        assert flat[start[i] : start[i + 1]].tolist() == path[::-1]


@pytest.mark.parametrize("entries", [7, 1_000_000])
def test_paths_in_portions(spark, monkeypatch, entries):
    monkeypatch.setattr(hierarchy, "PATH_ENTRIES", entries)
    rows = forest(4, 80, 2) + [("line", f"l{i:03d}", f"l{i - 1:03d}") for i in range(25)]
    df = spark.createDataFrame(rows, "trace_id string, span_id string, parent_id string")
    run = hierarchy._local(True)
    assert {(r.trace_id, r.span_id): (r.root_id, r.depth, r.path) for r in hierarchy.hierarchy(df, paths=True).collect()} == brute(rows)
    t = pa.Table.from_pylist([{"g": "x", "trace_id": "x", "span_id": f"l{i:03d}", "parent_id": f"l{i - 1:03d}", "dist": 1, "low_id": None} for i in range(25)], schema=pa.schema([(c, pa.int64() if c == "dist" else pa.string()) for c in ("g", "trace_id", "span_id", "parent_id", "dist", "low_id")]))
    got = list(run(iter(t.to_batches())))
    assert (len(got) > 10) == (entries == 7) and [len(p) for b in got for p in b.column("path").to_pylist()] == list(range(1, 26))


def test_empty_and_descendants(spark):
    df = spark.createDataFrame([("t", "a", None), ("t", "b", "a"), ("t", "c", "b"), ("t", "d", "e"), ("t", "e", "d")], "trace_id string, span_id string, parent_id string")
    assert hierarchy.hierarchy(df.limit(0)).count() == 0
    got = {(r.span_id, r.descendant_id, r.distance) for r in hierarchy.descendants(df).collect()}
    assert got == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1)}


def pairs(rows, around):
    parent = {k: None if v[2] and len(v[2]) == 1 else min(p for t, s, p in rows if (t, s) == k and p is not None) for k, v in brute(rows).items()}
    out = set()
    for t, s in parent:
        seen, x, far = {s}, parent[t, s], 1
        while x is not None and x not in seen:
            out.add((t, x, s, far))
            seen.add(x)
            x, far = parent[t, x], far + 1
        if x == s and not around:  # s lies on a circle
            out -= {o for o in out if o[0] == t and o[2] == s}
    return out


@pytest.mark.parametrize("limit", [100_000, 12])
@pytest.mark.parametrize("around", [False, True])
def test_descendants_below_circles(spark, limit, around):
    chain = [("chain", f"c{i:03d}", f"c{i - 1:03d}" if i else "c004") for i in range(5)] + [("chain", "x", "c002"), ("chain", "y", "x"), ("chain", "y", "z"), ("chain", "z", "y2")]
    rows = forest(3, 60, 3) + chain + [("self", "a", "a"), ("self", "b", "a"), ("self", "c", "b")]
    df = spark.createDataFrame(rows, "trace_id string, span_id string, parent_id string")
    got = [tuple(r) for r in hierarchy.descendants(df, around=around, limit=limit, task_nodes=50).collect()]
    assert len(got) == len(set(got)) and set(got) == pairs(rows, around)
    assert ("chain", "c002", "y", 2) in got and ("chain", "c003", "y", 6) in got and ("self", "a", "c", 2) in got


@pytest.mark.parametrize("levels", [1, 5, 15])
def test_nearest_above_equals_climbing(spark, levels):
    rows = forest(5, 120, 3) + [("chain", f"c{i:03d}", f"c{i - 1:03d}" if i else "c019") for i in range(20)] + [("chain", f"k{i:03d}", f"k{i - 1:03d}" if i else "c002") for i in range(20)]
    marks = {(t, s) for t, s, _ in rows if t and s and (s in ("c000", "self") or s[0] == "s" and s[-1] == "3")}
    parent = {k: min(p for t, s, p in rows if (t, s) == k and p is not None) if any((t, s) == k and p is not None for t, s, p in rows) else None for k in brute(rows)}
    want = set()
    for t, s in parent:
        x = s
        for far in range(1, levels + 1):
            x = parent[t, x]
            if x is None or (t, x) not in parent:
                break
            if (t, x) in marks:
                want.add((t, s, x, far))
                break
    links = spark.createDataFrame(rows, "trace_id string, span_id string, parent_id string")
    got = [tuple(r) for r in hierarchy.nearest_above(links, spark.createDataFrame(sorted(marks), "trace_id string, span_id string"), levels=levels).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert levels < 3 or ("chain", "c002", "c000", 2) in got and ("chain", "k000", "c000", 3) in got
    assert not any(s == "k018" for _, s, _, _ in got)


def test_task_above_on_circle(spark, make_spans, tmp_path):
    from tracequarry.plans import reference

    task, llm = {"trace_id": "t", "name": "Claude_Code_Tool_Task"}, {"trace_id": "t", "name": "litellm_request"}
    make_spans({**task, "span_id": "a", "parent_id": "b"}, {**llm, "span_id": "b", "parent_id": "a"}, {**llm, "span_id": "c", "parent_id": "b"}, {**llm, "span_id": "d"}, {**task, "span_id": "e", "parent_id": "c"}, {**llm, "span_id": "f", "parent_id": "e"}).write.parquet(str(tmp_path / "spans.parquet"))
    got = {(r.span_id, r.task_id, r.distance) for r in reference.nearest_task_ancestor(spark, str(tmp_path)).collect()}
    assert got == {("b", "a", 1), ("c", "a", 2), ("f", "e", 1)}

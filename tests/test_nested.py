import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracequarry.operators import nested


def brute(value, path="", listed="", in_array=False):
    out = []
    if isinstance(value, dict):
        if in_array:
            out.append((path, listed))
            listed = path
        for k, v in value.items():
            out += brute(v, path + "/" + k.replace("~", "~0").replace("/", "~1"), listed)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            out += brute(v, f"{path}/{i}", listed, True)
    return out


def fast(text):
    try:
        v = nested.parse_json(text)
    except ValueError:
        return []
    return nested.listed(v)


JSON = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=3), lambda c: st.lists(c, max_size=4) | st.dictionaries(st.text("ab/~ é", max_size=3), c, max_size=4), max_leaves=25)


@settings(max_examples=100, deadline=None)
@given(JSON)
def test_paths_equal_recursion(value):
    assert sorted(fast(json.dumps(value))) == sorted(brute(value))


@settings(max_examples=60, deadline=None)
@given(JSON)
def test_iterative_parser_equals_the_library(value):
    text = json.dumps(value, indent=1)
    assert nested._parse_deep(text) == nested._decoder.decode(text)


def test_intervals_contain():
    rows = nested.label(json.loads('{"a":[{"b":[{}]},{}],"c":1}'))
    by = {nested.pointer(rows, i): (r[0], r[1]) for i, r in enumerate(rows)}
    assert by[""][0] < by["/a/0/b/0"][0] and by[""][1] > by["/a/0/b/0"][1]
    assert not (by["/a/0"][0] < by["/a/1"][0] and by["/a/0"][1] > by["/a/1"][1])
    assert sorted(r[0] for r in rows) == list(range(len(rows))) == sorted(r[1] for r in rows)


def test_odd_texts(spark):
    deep = "[" * 100_000 + "{}" + "]" * 100_000
    texts = [None, "", "nope", "[NaN]", "[{}] x", '"[{}]"', "[{}", '[{"a\\u0000":[{}]}]', '[{"\\ud800":[{}]}]', "[{\"a\":1" + "0" * 5000 + "}]", deep, "[1,]", "{'a':[{}]}"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "k int, text string, row_key string")
    got = nested.array_objects(nested.json_texts(df, "t", F.col("k"), {"f": F.col("text")})).collect()
    by = {}
    for r in got:
        by.setdefault(int(r.row_key), []).append((r.node_path, r.parent_path))
    assert sorted(by) == [7, 8, 9, 10]
    assert len(by[7]) == len(by[8]) == 2 and by[9] == [("/0", "")] and by[10] == [("/0" * 100_000, "")]


def walk(value, above=None, step=None, depth=0, in_array=False, out=None):
    """[pre, post, depth, kind, in_array, parent, step, value] of all nodes, by recursion."""
    out = out if out is not None else {"rows": [], "post": 0}
    kind = "object" if isinstance(value, dict) else "array" if isinstance(value, list) else "null" if value is None else "boolean" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "string"
    me = len(out["rows"])
    out["rows"].append([me, None, depth, kind, in_array, above, step, None if kind in ("object", "array", "null") else json.dumps(value) if kind != "string" else value])
    for k, v in value.items() if kind == "object" else enumerate(value) if kind == "array" else ():
        walk(v, me, str(k), depth + 1, kind == "array", out)
    out["rows"][me][1] = out["post"]
    out["post"] += 1
    return out["rows"]


def test_nodes_and_links_equal_recursion(spark):
    texts = ['{"a":[{"b":[{"c":[1,"1",2.50]}]},[]],"d":{"e":[[{}]]}}', "[[[{}]],{}]", "7", '"x"', "null", '[true,{"":[false]}]', "[oops", "{}"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    nodes = nested.json_nodes(nested.json_texts(df.unionByName(df.filter("k = 1")), "t", F.col("k"), {"f": F.col("t")}))
    got, links = {}, set()
    for r in nodes.collect():
        got.setdefault(int(r.row_key), set()).add((r.pre, r.post, r.depth, r.kind, r.in_array, r.parent_pre, r.step, r.value))
    want = {}
    for i, x in enumerate(texts):
        try:
            rows = walk(json.loads(x.replace("2.50", "2.5")))
        except ValueError:
            continue
        want[i] = {tuple("2.50" if y == "2.5" else y for y in r) for r in rows}
        for pre, post, _, kind, *_ in rows:
            if kind == "array":
                over = [r[0] for r in rows if r[3] == "object" and r[0] < pre and r[1] > post]
                links.add((str(i), pre, max(over, default=None)))
    assert got == want
    tables = nested.node_tables(nodes)
    assert {(r.row_key, r.pre, r.outer_pre) for r in nested.contained(tables["object"], tables["array"]).collect()} == links
    objects = nested.contained(tables["object"], tables["object"]).collect()
    assert all(r.outer_pre is None or r.outer_pre < r.pre for r in objects) and len(objects) == 9
    assert nested.json_nodes(nested.json_texts(df.limit(0), "t", F.col("k"), {"f": F.col("t")})).count() == 0
    assert nested.contained(tables["object"].limit(0), tables["array"].limit(0)).count() == 0

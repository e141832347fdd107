"""Nested records to flat node tables, linked by interval containment.

Every node of a JSON text gets a pre-order and a post-order number in a depth-first
traversal. Node a contains node d exactly if a.pre < d.pre and a.post > d.post, so the
tables of the node types need no other link.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE_SCHEMA = "src_table string, row_key string, field string, pre int, post int, depth int, kind string, in_array boolean, parent_pre int, step string, value string"
KINDS = ("object", "array", "string", "number", "boolean", "null")
LISTED_SCHEMA = "src_table string, row_key string, field string, node_path string, parent_path string"

_WS = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?", re.ASCII)
_WORDS = {"true": True, "false": False, "null": None}


class Number(str):
    """A number as it is written."""


def _no_constant(name: str):
    raise ValueError(f"{name} is not JSON")


_decoder = json.JSONDecoder(parse_int=Number, parse_float=Number, parse_constant=_no_constant)


def _parse_deep(text: str):
    """The value of a text nested deeper than the recursive parser goes; ValueError if it isn't JSON."""
    scan = json.decoder.scanstring
    at, stack, top, key = 0, [], [], None
    holder: list | dict = top
    want = "value"
    while True:
        at = _WS.match(text, at).end()
        c = text[at : at + 1]
        if want in ("value", "first") and not (want == "first" and c in "]}" and c):
            if isinstance(holder, dict):
                if c != '"':
                    raise ValueError("key expected")
                key, at = scan(text, at + 1, True)
                at = _WS.match(text, at).end()
                if text[at : at + 1] != ":":
                    raise ValueError("colon expected")
                at = _WS.match(text, at + 1).end()
                c = text[at : at + 1]
            if c in ("[", "{"):
                new: list | dict = [] if c == "[" else {}
                at += 1
            elif c == '"':
                new, at = scan(text, at + 1, True)
            elif m := _NUMBER.match(text, at):
                new, at = Number(m.group()), m.end()
            elif w := next((w for w in _WORDS if text.startswith(w, at)), None):
                new, at = _WORDS[w], at + len(w)
            else:
                raise ValueError("value expected")
            if isinstance(holder, dict):
                holder[key] = new
            else:
                holder.append(new)
            if c in ("[", "{"):
                stack.append(holder)
                holder, want = new, "first"
            else:
                want = "next"
        elif c and c in "]}" and holder is not top:
            if (c == "]") != isinstance(holder, list):
                raise ValueError("wrong bracket")
            holder, want, at = stack.pop(), "next", at + 1
        elif c == "," and holder is not top:
            want, at = "value", at + 1
        elif not c and holder is top and want == "next":
            return top[0]
        else:
            raise ValueError("unexpected text")


def parse_json(text: str):
    """The value of a JSON text (numbers as text); ValueError unless it is strictly JSON."""
    try:
        return _decoder.decode(text)
    except RecursionError:
        return _parse_deep(text)


def _clean(s: str) -> str:
    """Lone surrogates, which JSON escapes can spell, have no UTF-8 form: they become U+FFFD."""
    return s if s.isascii() else s.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def label(value, scalars: bool = True) -> list[list]:
    """[pre, post, depth, kind, in_array, place of the parent, step from it, scalar] of every node, by pre-order; without scalars these only take up numbers."""
    rows: list[list] = []
    pre = post = 0
    # An explicit stack: texts may nest deeper than Python's recursion goes. A single number closes the node at that place.
    work: list = [(value, -1, "", 0, False)]
    while work:
        item = work.pop()
        if isinstance(item, int):
            rows[item][1] = post
            post += 1
            continue
        v, up, step, depth, in_array = item
        if isinstance(v, (dict, list)):
            at = len(rows)
            is_object = isinstance(v, dict)
            rows.append([pre, 0, depth, "object" if is_object else "array", in_array, up, step, None])
            pre += 1
            work.append(at)
            if is_object:
                work.extend([(x, at, k, depth + 1, False) for k, x in reversed(v.items())])
            else:
                work.extend([(x, at, i, depth + 1, True) for i, x in zip(range(len(v) - 1, -1, -1), reversed(v))])
        else:
            if scalars:
                kind = "null" if v is None else "boolean" if isinstance(v, bool) else "number" if isinstance(v, Number) else "string"
                rows.append([pre, post, depth, kind, in_array, up, step, None if v is None else str(v).lower() if isinstance(v, bool) else v])
            pre += 1
            post += 1
    return rows


def pointer(rows: list[list], at: int) -> str:
    """The JSON Pointer of a node: made only for nodes that are asked for, as those of all nodes of a deep text would be very long together."""
    steps = []
    while rows[at][5] >= 0:
        step = rows[at][6]
        steps.append(step.replace("~", "~0").replace("/", "~1") if isinstance(step, str) else str(step))
        at = rows[at][5]
    return "".join("/" + s for s in reversed(steps))


def nearest_container(nodes: list[tuple[int, int]]) -> list[int]:
    """For (pre, post) pairs by pre-order, the place of the innermost pair that contains each, else -1."""
    out, open_ = [], []
    for i, (_, post) in enumerate(nodes):
        while open_ and nodes[open_[-1]][1] < post:
            open_.pop()
        out.append(open_[-1] if open_ else -1)
        open_.append(i)
    return out


def listed(value) -> list[tuple[str, str]]:
    """(path, path of the innermost one around it or '') of the objects that are elements of arrays, found by the containment of their intervals."""
    rows = label(value, scalars=False)
    at = [i for i, r in enumerate(rows) if r[4] and r[3] == "object"]
    paths = [pointer(rows, i) for i in at]
    return [(p, paths[up] if up >= 0 else "") for p, up in zip(paths, nearest_container([(rows[i][0], rows[i][1]) for i in at]))]


def _arrow_text(values: list) -> pa.Array:
    try:
        return pa.array(values, pa.string())
    except (UnicodeEncodeError, pa.ArrowInvalid):
        return pa.array([x if x is None else _clean(x) for x in values], pa.string())


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        src, key, field, text = (b.column(i).to_pylist() for i in range(4))
        cols: list[list] = [[] for _ in range(11)]
        for s, k, f, t in zip(src, key, field, text):
            try:
                value = parse_json(t)
            except ValueError:
                continue
            for r in label(value):  # a node's place among all nodes is its pre-order number
                up = r[5] if r[5] >= 0 else None
                for c, x in zip(cols, (s, k, f, *r[:5], up, None if up is None else str(r[6]), r[7])):
                    c.append(x)
            if len(cols[0]) >= 20_000:
                yield _node_batch(cols)
                cols = [[] for _ in range(11)]
        yield _node_batch(cols)


def _node_batch(cols: list[list]) -> pa.RecordBatch:
    text, whole = {0, 1, 2, 6, 9, 10}, {3, 4, 5, 8}
    arrays = [_arrow_text(c) if i in text else pa.array(c, pa.int32() if i in whole else pa.bool_()) for i, c in enumerate(cols)]
    return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in NODE_SCHEMA.split(", ")])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        src, key, field, text = (b.column(i).to_pylist() for i in range(4))
        cols: list[list] = [[] for _ in range(5)]
        for s, k, f, t in zip(src, key, field, text):
            try:
                value = parse_json(t)
            except ValueError:
                continue
            if not isinstance(value, (dict, list)):
                continue
            for path, above in listed(value):
                for c, x in zip(cols, (s, k, f, path, above)):
                    c.append(x)
        yield pa.RecordBatch.from_arrays([*map(_arrow_text, cols)], names=["src_table", "row_key", "field", "node_path", "parent_path"])


def json_texts(df: DataFrame, src_table: str, key: Column, fields: dict[str, Column]) -> DataFrame:
    """(src_table, row_key, field, text): a row for each record and field whose text isn't null."""
    parts = F.array(*(F.struct(F.lit(n).alias("field"), c.alias("text")) for n, c in fields.items()))
    rows = df.select(key.cast("string").alias("row_key"), F.explode(parts).alias("x"))
    return rows.select(F.lit(src_table).alias("src_table"), "row_key", "x.field", "x.text").filter("text IS NOT NULL")


def json_nodes(texts: DataFrame) -> DataFrame:
    """All nodes of json_texts() with their interval labels, the label of their parent and their step from it (a key, or a place in an array; null at the top). Texts that aren't valid JSON give no rows; an empty table gives none.

    A record is parsed within its row, so no shuffle is needed. Repeated records give repeated rows; of repeated keys in an object the last counts. Numbers are as they are written.
    """
    return texts.select("src_table", "row_key", "field", "text").mapInArrow(_nodes, NODE_SCHEMA)


def node_tables(nodes: DataFrame) -> dict[str, DataFrame]:
    """A table for each node type; they are linked by interval containment within (src_table, row_key, field)."""
    return {k: nodes.filter(F.col("kind") == k).drop("kind") for k in KINDS}


_KEY = ("src_table", "row_key", "field")
_LINK_SCHEMA = "src_table string, row_key string, field string, pre int, post int, outer_pre int"


def _contain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Intervals come by key and pre-order; the open ones are a stack, which is as deep as the text is nested."""
    key, open_ = None, []
    for b in batches:
        out: list[tuple] = []
        for *k, pre, post, outer in zip(*(b.column(i).to_pylist() for i in range(6))):
            if k != key:
                key, open_ = k, []
            while open_ and open_[-1][1] < post:
                open_.pop()
            if outer:
                open_.append((pre, post))
            else:
                out.append((*k, pre, post, open_[-1][0] if open_ else None))
        cols = list(zip(*out)) or [()] * 6
        yield pa.RecordBatch.from_arrays([*map(_arrow_text, map(list, cols[:3])), *(pa.array(c, pa.int32()) for c in cols[3:])], names=[x.split()[0] for x in _LINK_SCHEMA.split(", ")])


def contained(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """(src_table, row_key, field, pre, post, outer_pre): each inner node with the innermost outer node whose interval contains it, null if none; a node does not contain itself.

    Both kinds are sorted together, so there are no pairs of intervals: a record with very many nodes is scanned once. Records that are stored again count once.
    """
    both = inner.select(*_KEY, "pre", "post", F.lit(False).alias("outer")).unionByName(outer.select(*_KEY, "pre", "post", F.lit(True).alias("outer"))).distinct()
    # at one place the inner row comes first: a node of both kinds is not its own container
    return both.repartition(*_KEY).sortWithinPartitions(*_KEY, "pre", "outer").mapInArrow(_contain, _LINK_SCHEMA)


def array_objects(texts: DataFrame) -> DataFrame:
    """A row for each object that is an element of an array, with its JSON Pointer and that of the innermost such object around it ('' if none).

    Null texts, invalid JSON and texts without such objects give no rows. Both brackets must occur, which the scan checks before Python sees a text.
    """
    some = texts.filter(F.col("text").contains("[") & F.col("text").contains("{"))
    return some.select("src_table", "row_key", "field", "text").mapInArrow(_listed, LISTED_SCHEMA)

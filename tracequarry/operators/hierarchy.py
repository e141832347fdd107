"""Parent-child rows to hierarchies by tree contraction.

A round rakes the leaves and splices out an independent set of unary nodes; each removal is
recorded with the node's parent at that time and the distance to it. Rounds end when only
roots and self-loops are left; a self-loop is what remains of a circle. The records are then
run backwards, which gives each removed node the root, depth and path of its parent.

Groups (traces) up to LOCAL_LIMIT nodes are contracted with arrays, many groups in a task.
Larger groups are contracted as tables, whichever their size, until what is left of each is
below the limit; no group is ever gathered whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracequarry.session import written

#: Nodes of a group that one task may hold. At 16-digit ids this is about 30 MB.
LOCAL_LIMIT = 100_000
#: Nodes that a task is given by putting groups together.
TASK_NODES = 50_000
#: Nodes of paths that a task puts together at once, at least those of one path.
PATH_ENTRIES = 1_000_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (size of them) for each pair, behind each other."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


class Records:
    """What a contraction leaves: of each removed node its parent at that time and, as a stretch of `pool`, the nodes that had been spliced out between the two, from above."""

    def __init__(self, n: int):
        self.to, self.at, self.size = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64)
        self._pool: list[np.ndarray] = []
        self._held = 0

    def splice(self, gone: np.ndarray, child: np.ndarray) -> None:
        """The link of each child passes over the node gone, and over what either's link passed over."""
        size = self.size[gone] + 1 + self.size[child]
        at = self._held + np.cumsum(size) - size
        new = np.empty(size.sum(), np.int64)
        pool = self.pool
        new[_ranges(at - self._held, self.size[gone])] = pool[_ranges(self.at[gone], self.size[gone])]
        new[at - self._held + self.size[gone]] = gone
        new[_ranges(at - self._held + self.size[gone] + 1, self.size[child])] = pool[_ranges(self.at[child], self.size[child])]
        self._pool = [np.r_[pool, new]]
        self._held += len(new)
        self.at[child], self.size[child] = at, size

    @property
    def pool(self) -> np.ndarray:
        return self._pool[0] if self._pool else np.zeros(0, np.int64)

    def paths(self, nodes: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where each path begins, nodes of the paths from root to node), put together from the records: a step for each removal that lies between a node and its root, not for each edge."""
        start = np.r_[0, np.cumsum(depth[nodes] + 1)]
        flat = np.empty(start[-1], np.int64)
        node, slot, pool = nodes, start[:-1] + depth[nodes], self.pool
        while len(node):
            flat[slot] = node
            size = self.size[node]
            flat[_ranges(slot - size, size)] = pool[_ranges(self.at[node], size)]
            node, slot = self.to[node], slot - size - 1
            on = node >= 0
            node, slot = node[on], slot[on]
        return start, flat


def contract(parent: np.ndarray, dist: np.ndarray, low: np.ndarray, paths: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, Records]:
    """Root (or core), depth, for a core the least rank on its circle, and the records (with what links pass over only if paths are wanted).

    parent: place of the parent or -1; dist: edges that the link to it stands for;
    low: least rank of the node and of the nodes that the link passes over.
    Depth is -1 and root is the core where the walk upward never ends.
    """
    n = len(parent)
    parent, dist, low = parent.copy(), dist.astype(np.int64), low.copy()
    records = Records(n)
    rounds: list[tuple[np.ndarray, np.ndarray]] = []
    active = np.arange(n)
    step = 0
    while True:
        has = active[(parent[active] >= 0) & (parent[active] != active)]
        if not len(has):
            break
        kids = np.bincount(parent[has], minlength=n)
        leaf = has[kids[has] == 0]
        leaf = leaf[parent[leaf] != leaf]
        records.to[leaf] = parent[leaf]
        rounds.append((leaf, dist[leaf].copy()))
        gone = np.zeros(n, bool)
        gone[leaf] = True
        rest = has[~gone[has]]
        # unary: one child is left, itself not counted
        kids = np.bincount(parent[rest], minlength=n)
        only = np.full(n, -1)
        only[parent[rest]] = rest
        unary = rest[kids[rest] == 1]
        if len(unary):
            coin = np.zeros(n, np.uint64)
            coin[unary] = _mix(unary + np.int64(step) * 1_000_003) | np.uint64(1)
            up, down = parent[unary], only[unary]
            # greater than both neighbours: no two neighbours are spliced at once
            take = unary[(coin[unary] > coin[up]) & (coin[unary] > coin[down])]
            child = only[take]
            records.to[take] = parent[take]
            rounds.append((take, dist[take].copy()))
            if paths:
                records.splice(take, child)
            low[child] = np.minimum(low[child], low[take])
            dist[child] += dist[take]
            parent[child] = parent[take]
            gone[take] = True
        active = active[~gone[active]]
        step += 1
    root, depth = np.arange(n), np.zeros(n, np.int64)
    core = active[parent[active] == active]
    depth[core] = -1
    for who, far in reversed(rounds):
        to = records.to[who]
        root[who] = root[to]
        depth[who] = np.where(depth[to] < 0, -1, depth[to] + far)
    return root, depth, low, records


def _number(t: pa.Table) -> dict:
    """The nodes of a table (g, span_id, parent_id, dist, low_id) as places in arrays; a repeated node counts once, with its least parent_id."""
    g = pd.factorize(t.column("g").to_numpy(zero_copy_only=False))[0].astype(np.int64)
    names = np.concatenate([t.column(c).to_numpy(zero_copy_only=False) for c in ("span_id", "parent_id", "low_id")])
    codes, known = pd.factorize(names, use_na_sentinel=True)
    order = np.argsort(known.astype(str), kind="stable")  # rank by the text, so the least rank is the least id
    rank = np.empty(len(known) + 1, np.int64)
    rank[order] = np.arange(len(known))
    rank[-1] = -1
    span, up, low = np.split(rank[codes], 3)
    width = len(known) + 1
    key = g * width + span
    by = np.lexsort((np.where(up < 0, width, up), key))
    first = by[np.r_[True, key[by][1:] != key[by][:-1]]] if len(by) else by
    key, up, low, at = key[first], up[first], low[first], first
    want = g[first] * width + up
    place = np.searchsorted(key, want).clip(0, max(len(key) - 1, 0)) if len(key) else want
    found = (up >= 0) & (key[place] == want) if len(key) else np.zeros(0, bool)
    return {"at": at, "parent": np.where(found, place, -1), "rank": span[first], "low": np.where(low < 0, span[first], np.minimum(low, span[first])), "names": known[order], "dist": t.column("dist").to_numpy()[first]}


def _local(paths: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        x = _number(t)
        root, depth, low, records = contract(x["parent"], x["dist"], x["low"], paths)
        label = np.where(depth < 0, low[root], x["rank"][root])
        names = pa.array(x["names"], pa.string())
        # paths of a deep group are many times the group: they are given out in portions
        size = np.where(depth < 0, 0, depth + 1) if paths else np.zeros(len(depth), np.int64)
        portion = np.cumsum(size) // PATH_ENTRIES
        for nodes in np.split(np.arange(len(depth)), np.flatnonzero(np.diff(portion)) + 1):
            out = [
                t.column("trace_id").take(pa.array(x["at"][nodes])).combine_chunks(),
                t.column("span_id").take(pa.array(x["at"][nodes])).combine_chunks(),
                names.take(pa.array(label[nodes])) if len(nodes) else pa.array([], pa.string()),
                pa.array(depth[nodes], pa.int32()),
            ]
            if paths:
                treed = depth[nodes] >= 0
                _, flat = records.paths(nodes[treed], depth)
                values = names.take(pa.array(x["rank"][flat])) if len(flat) else pa.array([], pa.string())
                out.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size[nodes])], pa.int32()), values, mask=pa.array(~treed)))
            yield pa.RecordBatch.from_arrays(out, names=["trace_id", "span_id", "root_id", "depth", "path"][: len(out)])

    return run


_SCHEMA = "trace_id string, span_id string, root_id string, depth int"


def _contract_tables(edges: DataFrame, limit: int, paths: bool) -> DataFrame:
    """The same contraction with tables; for groups above the limit. edges: distinct (trace_id, span_id, parent_id)."""
    key = ["trace_id", "span_id"]
    ids = edges.select("trace_id", F.col("span_id").alias("parent_id"), F.lit(True).alias("_known"))
    seg = F.expr("CAST(array() AS array<string>)")
    active = written(
        edges.join(ids, ["trace_id", "parent_id"], "left").select(*key, F.when(F.col("_known"), F.col("parent_id")).alias("parent_id"), F.lit(1).cast("long").alias("dist"), F.col("span_id").alias("low_id"), *([seg.alias("seg")] if paths else [])),
        "hierarchy",
    )
    undo: list[DataFrame] = []
    step = 0
    linked = "parent_id IS NOT NULL AND parent_id <> span_id"
    # paths need the order of all removals, so then the contraction runs to its end
    def open_groups() -> DataFrame:
        g = active.groupBy("trace_id").agg(F.count("*").alias("n"), F.count_if(F.expr(linked)).alias("links"))
        return g.filter("links > 0")

    while open_groups().filter(F.lit(True) if paths else F.col("n") > limit).limit(1).count():
        kids = active.filter(linked).groupBy("trace_id", F.col("parent_id").alias("span_id")).agg(F.count("*").alias("kids"))
        now = written(active.join(kids, key, "left").fillna(0, ["kids"]), "hierarchy")
        leaf = now.filter(f"{linked} AND kids = 0").drop("kids")
        rest = now.filter(f"NOT ({linked} AND kids = 0)").drop("kids")
        more = rest.filter(linked).groupBy("trace_id", F.col("parent_id").alias("span_id")).agg(F.count("*").alias("kids"), F.min("span_id").alias("only"))
        coin = F.xxhash64("trace_id", "span_id", F.lit(step))
        rest = written(rest.join(more, key, "left").withColumn("coin", F.when(F.expr(f"{linked} AND kids = 1"), coin)), "hierarchy")
        near = rest.filter("coin IS NOT NULL").select("trace_id", F.col("span_id").alias("n_id"), F.col("coin").alias("n_coin"))
        took = (
            rest.filter("coin IS NOT NULL")
            .alias("r")
            .join(near.alias("u"), (F.col("r.trace_id") == F.col("u.trace_id")) & (F.col("r.parent_id") == F.col("u.n_id")), "left")
            .join(near.alias("d"), (F.col("r.trace_id") == F.col("d.trace_id")) & (F.col("r.only") == F.col("d.n_id")), "left")
            .filter("(u.n_coin IS NULL OR r.coin > u.n_coin) AND (d.n_coin IS NULL OR r.coin > d.n_coin)")
            .select("r.*")
        )
        took = written(took, "hierarchy")
        undo += [leaf, took.drop("kids", "only", "coin")]
        spliced = took.select("trace_id", F.col("only").alias("span_id"), F.col("parent_id").alias("t_parent"), F.col("dist").alias("t_dist"), F.col("low_id").alias("t_low"), *([F.concat("seg", F.array(took["span_id"])).alias("t_seg")] if paths else []))
        kept = rest.join(took.select(*key), key, "left_anti").join(spliced, key, "left")
        active = written(
            kept.select(
                *key,
                F.when(F.col("t_dist").isNotNull(), F.col("t_parent")).otherwise(F.col("parent_id")).alias("parent_id"),
                (F.col("dist") + F.coalesce("t_dist", F.lit(0))).alias("dist"),
                F.least("low_id", "t_low").alias("low_id"),
                *([F.concat(F.coalesce("t_seg", seg), "seg").alias("seg")] if paths else []),
            ),
            "hierarchy",
        )
        step += 1
    def ends(rows: DataFrame) -> DataFrame:
        """Roots and self-loops, which need no further step."""
        top = F.col("parent_id").isNull()
        path = [F.when(top, F.array("span_id")).alias("path")] if paths else []
        return rows.select(*key, F.when(top, F.col("span_id")).otherwise(F.col("low_id")).alias("root_id"), F.when(top, 0).otherwise(-1).alias("depth"), *path)

    if paths:
        done = ends(active)
    else:
        # groups that still have links are within the limit now; the others consist of ends, however many
        small = open_groups().select("trace_id")
        core = active.join(small, "trace_id", "left_semi").select("trace_id", "span_id", "parent_id", "dist", "low_id", F.col("trace_id").alias("g"))
        done = written(core.groupBy("g").applyInArrow(_local(False), _SCHEMA).unionByName(ends(active.join(small, "trace_id", "left_anti"))), "hierarchy")
    for gone in reversed(undo):
        above = done.select("trace_id", F.col("span_id").alias("parent_id"), "root_id", F.col("depth").alias("p_depth"), *([F.col("path").alias("p_path")] if paths else []))
        back = gone.join(above, ["trace_id", "parent_id"])
        depth = F.when(F.col("p_depth") < 0, -1).otherwise(F.col("p_depth") + F.col("dist")).cast("int")
        done = written(done.unionByName(back.select(*key, "root_id", depth.alias("depth"), *([F.concat("p_path", "seg", F.array("span_id")).alias("path")] if paths else []))), "hierarchy")
    return done


def hierarchy(links: DataFrame, *, paths: bool = False, limit: int = LOCAL_LIMIT, task_nodes: int = TASK_NODES) -> DataFrame:
    """(trace_id, span_id, root_id, depth[, path]): one row per distinct (trace_id, span_id) of links (trace_id, span_id, parent_id).

    A parent counts only if it is a span_id of the same trace, otherwise the row is a root (depth 0, its own root_id).
    Where the walk upward never ends, depth is -1, root_id the smallest span_id on the circle, path null.
    Rows with null trace_id or span_id are left out; repeated nodes count once, with their smallest parent_id; other columns are ignored.
    """
    rows = links.select("trace_id", "span_id", "parent_id").filter("trace_id IS NOT NULL AND span_id IS NOT NULL")
    sizes = rows.groupBy("trace_id").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("all"), F.max("n").alias("most")).first()
    tasks = max(1, round((total["all"] or 0) / task_nodes))
    schema = _SCHEMA + (", path array<string>" if paths else "")
    big = (total["most"] or 0) > limit
    small = rows
    if big:
        large = sizes.filter(F.col("n") > limit).select("trace_id")
        small = rows.join(large, "trace_id", "left_anti")
    given = small.select("trace_id", "span_id", "parent_id", F.lit(1).cast("long").alias("dist"), F.lit(None).cast("string").alias("low_id"), F.col("trace_id").alias("g"), F.pmod(F.xxhash64("trace_id"), F.lit(tasks)).alias("_task"))
    out = given.groupBy("_task").applyInArrow(_local(paths), schema)
    if big:
        edges = rows.join(large, "trace_id", "left_semi").groupBy("trace_id", "span_id").agg(F.min("parent_id").alias("parent_id"))
        out = out.unionByName(_contract_tables(edges, limit, paths).select(out.columns))
    return out


def _rings(links: DataFrame, lost: DataFrame, **kw) -> DataFrame:
    """(trace_id, span_id, depth, path, ring) of the nodes on and below circles, lost (trace_id, span_id, root_id): each circle is cut above its smallest node, root_id, from where path and depth count; ring is the circle from there downward."""
    rows = links.select("trace_id", "span_id", "parent_id").join(lost, ["trace_id", "span_id"])
    core = F.col("span_id") == F.col("root_id")
    cut = written(hierarchy(rows.withColumn("parent_id", F.when(~core, F.col("parent_id"))), paths=True, **kw), "hierarchy")
    last = rows.filter(core).groupBy("trace_id", "root_id").agg(F.min("parent_id").alias("span_id"))
    ring = last.join(cut.select("trace_id", "span_id", F.col("path").alias("ring")), ["trace_id", "span_id"]).drop("span_id")
    return cut.join(ring, ["trace_id", "root_id"]).select("trace_id", "span_id", "depth", "path", "ring")


def descendants(links: DataFrame, *, around: bool = False, **kw) -> DataFrame:
    """(trace_id, span_id, descendant_id, distance): every node with each other node below it, once, with the least distance.

    A node below a circle has the nodes between and all nodes of the circle above it. The nodes of a circle lie above and below each other;
    such pairs are given only with `around`. No node is its own descendant.
    """
    h = written(hierarchy(links, paths=True, **kw), "hierarchy")
    tree = h.filter("depth > 0").select("trace_id", F.col("span_id").alias("descendant_id"), "depth", F.col("depth").alias("turn"), F.slice("path", 1, F.col("depth")).alias("above"))
    lost = h.filter("depth < 0").select("trace_id", "span_id", "root_id")
    below = _rings(links, lost, **kw).withColumn("_on", F.size(F.array_intersect("path", "ring")))  # path begins with so many nodes of the ring
    if not around:
        below = below.filter("depth >= _on")
    # the walk upward goes along the path, then on from the last node of the ring to the one below the path's own part
    tail = F.slice("ring", F.col("_on") + 1, F.size("ring") - F.col("_on"))
    turn = F.col("depth") + F.size("ring") - F.col("_on")
    below = below.select("trace_id", F.col("span_id").alias("descendant_id"), "depth", turn.alias("turn"), F.concat(F.slice("path", 1, F.col("depth")), tail).alias("above"))
    x = tree.unionByName(below).select("trace_id", "descendant_id", "depth", "turn", F.posexplode("above").alias("at", "span_id"))
    # place `at` of the tail, counted from depth, is turn - at + depth edges above
    far = F.when(F.col("at") < F.col("depth"), F.col("depth") - F.col("at")).otherwise(F.col("depth") + F.col("turn") - F.col("at"))
    return x.select("trace_id", "span_id", "descendant_id", far.cast("int").alias("distance"))


def nearest_above(links: DataFrame, marked: DataFrame, *, levels: int) -> DataFrame:
    """(trace_id, span_id, above_id, distance): each node of links with the nearest node of marked (trace_id, span_id) at most `levels` edges above it, whatever lies further up.

    The stretch that is searched doubles each round, so a node holds one link and one find, and circles need no care. Nodes count as in hierarchy().
    """
    key = ["trace_id", "span_id"]
    rows = links.filter("trace_id IS NOT NULL AND span_id IS NOT NULL").groupBy(*key).agg(F.min("parent_id").alias("at"))
    marks = marked.select(*key).distinct().withColumn("_marked", F.lit(True))
    now = written(rows.join(marks, key, "left"), "above")
    up = now.select("trace_id", F.col("span_id").alias("at"), F.lit(True).alias("_known"), F.col("_marked").alias("_hit"))
    hit = F.col("_hit").isNotNull()
    now = now.join(up, ["trace_id", "at"], "left").select(*key, F.when(F.col("_known"), F.col("at")).alias("at"), F.when(hit, F.col("at")).alias("above_id"), F.when(hit, 1).alias("distance"))
    reach = 1
    while reach < levels:
        now = written(now, "above")
        up = now.select("trace_id", F.col("span_id").alias("at"), F.col("at").alias("_at"), F.col("above_id").alias("_above"), F.col("distance").alias("_far"))
        now = now.join(up, ["trace_id", "at"], "left").select(*key, F.col("_at").alias("at"), F.coalesce("above_id", "_above").alias("above_id"), F.coalesce("distance", F.col("_far") + reach).alias("distance"))
        reach *= 2
    return now.filter(F.col("distance") <= levels).select(*key, "above_id", "distance")

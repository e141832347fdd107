"""Long exact stretches shared between records, by content-defined chunking.

A gear rolling hash picks cut points: a place is a cut if its hash is the least in some window of
WINDOW places. From every cut a chunk runs to the first cut at least `m` characters on. Chunks move
with the text, so insertions do not change them. With m = min_len - 8 - 2 * WINDOW + 2, every stretch of
min_len characters holds a whole chunk, whose cuts depend on the stretch alone: two records that share such a
stretch share a chunk, without exception.

Chunks are deduplicated by digest. Where records share chunk after chunk only the first chunk of the run
matters, so digests whose occurrences all follow the same chunk are dropped. Around what is left, the windows
of exactly min_len characters are compared, first by hash and then by their text, which decides. All these steps are linear in the text. Records that share the same
stretches form a class, and only one of each class is paired with others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracequarry.llm.codes import BASE_2, Prefix, code_points, gear, gear_roll, mix, parts, sliding
from tracequarry.session import written

GEAR_SPAN, WINDOW = 8, 32
#: Rows of hit records that are sent to every task instead of shuffling the texts: at most some 10 MB.
BROADCAST_ROWS = 200_000
_OWN = np.uint64(0x5851F42D4C957F2D)
_WINDOWS = "window long, check long, before long, rid long"


def least_chunk(min_len: int) -> int:
    m = min_len - GEAR_SPAN - 2 * WINDOW + 2
    if m < 8:
        raise ValueError("min_len must be at least 78")
    return m


def chunks(points: np.ndarray, start: np.ndarray, min_len: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, Prefix]:
    """(text, from, to, digest, digest of the chunk before or 0) of each chunk, and the prefix hashes. Texts must have min_len characters."""
    values = gear(points)
    prefix = Prefix(values)
    n = len(points)
    text = np.repeat(np.arange(len(start) - 1), np.diff(start))
    order = mix(gear_roll(values)) >> np.uint64(1)
    place = np.arange(n) - start[text]
    low = sliding(order, WINDOW, True)
    # windows that begin before the hash is whole, or that run over the text's end, do not count
    whole = (place[: len(low)] >= GEAR_SPAN - 1) & (text[: len(low)] == text[WINDOW - 1 :])
    low = np.where(whole, low, np.uint64(0))
    padded = np.r_[np.zeros(WINDOW - 1, np.uint64), low, np.zeros(WINDOW - 1, np.uint64)]
    cut = np.flatnonzero((sliding(padded, WINDOW, False) == order) & (place >= GEAR_SPAN - 1))
    end = np.searchsorted(cut, cut + least_chunk(min_len))
    ok = end < len(cut)
    a, b = cut[ok], cut[end[ok]]
    same = text[a] == text[b]
    a, b = a[same], b[same]
    digest = prefix.of(a, b)
    before = np.zeros(len(a), np.uint64)
    if len(a) > 1:
        before[1:] = np.where(text[a[1:]] == text[a[:-1]], digest[:-1], np.uint64(0))
    return text[a], a, b, digest, before, prefix


def _texts(b: pa.RecordBatch, first: int, min_len: int) -> tuple[list[str], np.ndarray]:
    """The long enough texts of a batch's columns from `first` on, and the row of each; a row's equal texts once."""
    texts: list[str] = []
    rows: list[int] = []
    for i, row in enumerate(zip(*(b.column(c).to_pylist() for c in range(first, b.num_columns)))):
        for t in dict.fromkeys(row):
            if t is not None and len(t) >= min_len:
                texts.append(t)
                rows.append(i)
    return texts, np.array(rows, np.int64)


def _emit_chunks(min_len: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, rows = _texts(b, 1, min_len)
            own = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for which, _, held in parts(texts, min_len - 1):
                text, _, _, digest, before, _ = chunks(*code_points(held), min_len)
                ids = own[rows[np.array(which)[text]]]
                # a first chunk follows something of its own, so that it is never taken for the middle of a run
                before = np.where(before == 0, mix(ids.view(np.uint64) + _OWN), before)
                keep = np.unique(np.stack([ids.view(np.uint64), digest, before]), axis=1) if len(ids) else np.zeros((3, 0), np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in np.ascontiguousarray(keep)], names=["id", "digest", "before"])

    return run


def _emit_windows(min_len: int):
    """(window, check, before, rid): two hashes of each window of min_len characters around a wanted chunk, and the window that begins a character before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, rows = _texts(b.drop_columns(["rid", "digests"]), 0, min_len)
            wanted = [np.array(x, np.int64).view(np.uint64) for x in b.column("digests").to_pylist()]
            own = b.column("rid").to_numpy(zero_copy_only=False).astype(np.int64)
            for which, _, held in parts(texts, min_len - 1):
                points, start = code_points(held)
                text, a, e, digest, _, prefix = chunks(points, start, min_len)
                keep = np.zeros(len(a), bool)
                for t, w in enumerate(which):
                    x, y = np.searchsorted(text, [t, t + 1])
                    keep[x:y] = np.isin(digest[x:y], wanted[rows[w]])
                text, a, e = text[keep], a[keep], e[keep]
                lo = np.maximum(start[text], e - min_len)
                hi = np.minimum(a, start[text + 1] - min_len)
                size = np.maximum(hi - lo + 1, 0)
                who = np.repeat(np.arange(len(a)), size)
                at = lo[who] + np.arange(len(who)) - np.repeat(np.cumsum(size) - size, size)
                at, first = np.unique(at, return_index=True)
                text = text[who[first]]
                window = prefix.of(at, at + min_len)
                check = Prefix(gear(points), BASE_2).of(at, at + min_len)
                rid = own[rows[np.array(which)[text]]] if len(at) else np.zeros(0, np.int64)
                begins = np.r_[True, (np.diff(at) != 1) | (np.diff(text) != 0)] if len(at) else np.zeros(0, bool)
                before = np.where(begins, mix(rid.view(np.uint64) + _OWN), np.r_[np.uint64(0), window[:-1]] if len(window) else window)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (window, check, before)] + [pa.array(rid)], names=["window", "check", "before", "rid"])

    return run


def _emit_texts(min_len: int):
    """(rid, text) of the windows whose hash is among a record's `windows`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, rows = _texts(b.drop_columns(["rid", "windows"]), 0, min_len)
            wanted = [np.array(x, np.int64).view(np.uint64) for x in b.column("windows").to_pylist()]
            rid, out = [], []
            for which, _, held in parts(texts, min_len - 1):
                points, start = code_points(held)
                window = Prefix(gear(points)).of(np.arange(max(len(points) - min_len + 1, 0)), np.arange(min_len, len(points) + 1))
                for t, w in enumerate(which):
                    at = np.flatnonzero(np.isin(window[start[t] : start[t + 1] - min_len + 1], wanted[rows[w]]))
                    out += [held[t][i : i + min_len] for i in at.tolist()]
                    rid += [b.column("rid")[int(rows[w])].as_py()] * len(at)
            yield pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(out, pa.string())], names=["rid", "text"])

    return run


def _canonical(df: DataFrame, id_col: str, same: list[str]) -> DataFrame:
    """(id, rid) of the rows that repeat another: rid is the least id of the rows equal in `same`. Only keys are shuffled."""
    k = df.select(F.col(id_col).alias("id"), *same)
    many = k.groupBy(*same).agg(F.min("id").alias("rid"), F.count("*").alias("n")).filter("n > 1")
    on = [k[c].eqNullSafe(many[c]) for c in same]
    return k.join(many, on).filter("id <> rid").select("id", "rid")


def _hit_texts(df: DataFrame, id_col: str, texts: list[str], same: list[str], min_len: int, branching: bool) -> DataFrame:
    """Texts of the records that hold a chunk found in more than one row, with those chunks' digests."""
    long = F.greatest(*(F.coalesce(F.length(c), F.lit(0)) for c in texts)) >= min_len
    rows = df.select(F.col(id_col).cast("long").alias("id"), *texts).filter(long & F.col("id").isNotNull())
    occ = rows.mapInArrow(_emit_chunks(min_len), "id long, digest long, before long")
    of = "before" if branching else "id"
    many = occ.groupBy("digest").agg(F.min(of).alias("a"), F.max(of).alias("b")).filter("a <> b").select("digest")
    hits = occ.select("id", "digest").join(many, "digest", "left_semi").groupBy("id").agg(F.collect_set("digest").alias("digests"))  # at most a record's own chunks
    hits = hits.join(_canonical(df, id_col, same), "id", "left").select("id", "digests", F.coalesce("rid", "id").alias("rid"))
    hits = written(hits, "shared-spans")
    few = hits.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS and (hits.agg(F.sum(F.size("digests"))).first()[0] or 0) <= 10 * BROADCAST_ROWS
    return rows.join(F.broadcast(hits) if few else hits, "id").select(*texts, "rid", "digests")


def _first_windows(df: DataFrame, id_col: str, texts: list[str], same: list[str], min_len: int) -> DataFrame:
    """(rid, digest) of the windows at which a run begins that records share. Windows are found by hash; those with equal hashes are then compared by their text, of which digest is the SHA-256."""
    rows = _hit_texts(df, id_col, texts, same, min_len, branching=True)
    w = written(rows.mapInArrow(_emit_windows(min_len), _WINDOWS).select("window", "before", "rid"), "shared-windows")
    # of a shared run only its first window is needed: the one before which the records differ
    first = w.groupBy("window").agg(F.min("rid").alias("a"), F.max("rid").alias("b"), F.min("before").alias("c"), F.max("before").alias("d")).filter("a <> b AND c <> d")
    wanted = w.join(first.select("window"), "window", "left_semi").groupBy("rid").agg(F.collect_set("window").alias("windows"))  # at most a record's own windows
    wanted = written(wanted, "shared-wanted")
    few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS and (wanted.agg(F.sum(F.size("windows"))).first()[0] or 0) <= 10 * BROADCAST_ROWS
    exact = rows.drop("digests").join(F.broadcast(wanted) if few else wanted, "rid").mapInArrow(_emit_texts(min_len), "rid long, text string")
    return exact.select("rid", F.unhex(F.sha2("text", 256)).alias("digest")).distinct()


def _classes(first: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rid, class_id) of the records that share something, and (a, b) of the classes that share something, a < b.

    Records with the same windows are one class with its least id: its members share all of them with each other, and with all others they share the same.
    """
    h = F.hex("digest")
    part = lambda i: F.sum(F.conv(F.substring(h, i, 15), 16, 10).cast("decimal(38,0)"))
    # windows of one record alone are no link: equal hashes may have been of different texts
    many = first.groupBy("digest").agg(F.min("rid").alias("a"), F.max("rid").alias("b")).filter("a <> b").select("digest")
    who = written(first.join(many, "digest", "left_semi"), "shared-first")
    sign = who.groupBy("rid").agg(F.count("*").alias("n"), *(part(1 + 15 * i).alias(f"s{i}") for i in range(4)))
    by = ["n", "s0", "s1", "s2", "s3"]
    member = written(sign.join(sign.groupBy(*by).agg(F.min("rid").alias("class_id")), by).select("rid", "class_id"), "shared-classes")
    lone = who.join(member.filter("rid = class_id"), "rid").select("digest", "class_id")
    pairs = lone.withColumnRenamed("class_id", "a").join(lone.withColumnRenamed("class_id", "b"), "digest").filter("a < b").select("a", "b").distinct()
    return member, pairs


def shared_pairs(df: DataFrame, *, id_col: str = "id", texts: list[str], same: list[str], min_len: int = 120) -> DataFrame:
    """(id_a, id_b): pairs of records that share min_len or more successive characters in any of their texts; id_a < id_b.

    Rows equal in the columns `same` (nulls equal) are one record with its least id. Null and shorter texts share nothing; rows with null id are
    left out; an empty table gives no pairs. What is shared within one record alone gives no pair. Equal hashes are no verdict: the texts are compared.
    """
    member, pairs = _classes(_first_windows(df, id_col, texts, same, min_len))
    left, right = (member.select(F.col("class_id").alias(c), F.col("rid").alias(r)) for c, r in (("a", "x"), ("b", "y")))
    across = pairs.join(left, "a").join(right, "b").select("x", "y")
    within = left.join(right.withColumnRenamed("b", "a"), "a").filter("x < y").select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def shared_classes(df: DataFrame, *, id_col: str = "id", texts: list[str], same: list[str], min_len: int = 120) -> DataFrame:
    """(id, class_id, members, links): every record with its class and the number of records that it shares min_len or more successive characters with.

    Records of a class share the same stretches with each other and with others; class_id is the least id. A record that shares nothing is a class of its own, with no links.
    Links are counted between classes, so copies are never paired with each other.
    """
    member, pairs = _classes(_first_windows(df, id_col, texts, same, min_len))
    size = member.groupBy("class_id").agg(F.count("*").alias("members"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    far = both.join(size.withColumnRenamed("class_id", "b"), "b").groupBy(F.col("a").alias("class_id")).agg(F.sum("members").alias("far"))
    known = member.join(size.join(far, "class_id", "left").select("class_id", "members", (F.col("members") - 1 + F.coalesce("far", F.lit(0))).alias("links")), "class_id")
    keys = df.select(F.col(id_col).cast("long").alias("id"), *same).filter("id IS NOT NULL")
    once = keys.join(_canonical(df, id_col, same).select("id"), "id", "left_anti").select("id")
    return once.join(known.withColumnRenamed("rid", "id"), "id", "left").select("id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("members", F.lit(1)).alias("members"), F.coalesce("links", F.lit(0)).alias("links"))


def shared_share(df: DataFrame, *, id_col: str = "id", texts: list[str], same: list[str], min_len: int = 120) -> DataFrame:
    """(id, n_chars, shared_chars, share): for each record how many of its characters lie in stretches of min_len or more that occur in another record.

    Every record is listed, share 0 where nothing is shared or there is no text. Of a record's rows the one with the least id gives its texts. Stretches are the
    same if two independent 64-bit hashes of them are.
    """
    w = _hit_texts(df, id_col, texts, same, min_len, branching=False).mapInArrow(_emit_windows(min_len), _WINDOWS)
    w = written(w.select("window", "check", "rid"), "shared-windows")
    many = w.groupBy("window", "check").agg(F.min("rid").alias("a"), F.max("rid").alias("b")).filter("a <> b").select("window", "check")
    known = w.join(many, ["window", "check"], "left_semi").select("window", "rid").distinct().groupBy("rid").agg(F.collect_set("window").alias("windows"))  # at most a record's own windows
    keys = df.select(F.col(id_col).cast("long").alias("id"), *same, *texts)
    first = keys.join(_canonical(df, id_col, same).select("id"), "id", "left_anti").select("id", *texts)
    return first.join(known.withColumnRenamed("rid", "id"), "id", "left").mapInArrow(_cover(min_len, len(texts)), "id long, n_chars long, shared_chars long, share double")


def _cover(min_len: int, n_texts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            cols = [b.column(1 + i).to_pylist() for i in range(n_texts)]
            total, shared = [], []
            for i, known in enumerate(b.column(1 + n_texts).to_pylist()):
                own = [c[i] for c in cols if c[i] is not None]
                total.append(sum(map(len, own)))
                got = 0
                if known:
                    for t in own:
                        if len(t) < min_len:
                            continue
                        found = []
                        for _, where, (held,) in parts([t], min_len - 1):
                            p = Prefix(gear(code_points([held])[0]))
                            x = np.arange(len(held) - min_len + 1)
                            found.append(where[0] + x[np.isin(p.of(x, x + min_len), np.array(known, np.int64).view(np.uint64))])
                        at = np.concatenate(found)
                        got += int(np.minimum(np.diff(at), min_len).sum()) + min_len if len(at) else 0
                shared.append(got)
            share = [s / n if n else 0.0 for s, n in zip(shared, total)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total, pa.int64()), pa.array(shared, pa.int64()), pa.array(share, pa.float64())], names=["id", "n_chars", "shared_chars", "share"])

    return run

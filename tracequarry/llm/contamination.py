"""Evaluation passages inside documents: size-partitioned MinHash containment search, then exact shingles.

A passage leaks where min_words successive words of it occur. The queries are the passages' windows of min_words words, as sets of q five-word shingles. The searched sets are the
documents in pieces of at most 4 q shingles, which overlap so that every run of q shingles lies in one. They are partitioned by size, with the upper bounds q, 2 q and 4 q. A query that is
contained in a set of at most u shingles has a similarity of q / u to it or more. From this each partition gets its number of MinHashes, one a band, such that a contained query
shares none of them more rarely than MISS: 1, 30 and 72 at 13 words. One equal MinHash makes a candidate. Windows in which a shingle comes again have fewer
shingles, so they are also found by what comes again. Candidates are verified by exact containment of min_words-word shingles.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracequarry.llm.codes import BASE, Prefix, code_points, gear, mix, sliding
from tracequarry.session import written

SHINGLE = 5
#: How rarely a contained query may share no MinHash with the set that holds it.
MISS = 1e-9
#: Characters of passages that are sent to every task; at most half as many windows, with some twenty MinHashes each. More are joined by shuffling the MinHashes.
ITEM_CHARS = 200_000
#: Bits of the table that tells which MinHashes the items have: 4 MB, whatever the number of items.
BLOOM_BITS = 1 << 25
#: Characters that a task looks at together.
PART_CHARS = 1 << 20

_WORD = re.compile(r"[^\W_]+")
_GAP = re.compile(r"[\W_]")
_IS_WORD = np.zeros(0x110000, bool)


def words(text: str) -> list[str]:
    """Runs of letters and digits, in lower case."""
    return _WORD.findall(text.lower())


def _word_table() -> np.ndarray:
    if not _IS_WORD[97]:
        _IS_WORD[:] = np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)
    return _IS_WORD


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of the texts, and the text it is of."""
    points, start = code_points([t.lower() + " " for t in texts])
    on = _word_table()[points]
    edge = np.flatnonzero(np.diff(np.r_[False, on, False].astype(np.int8)))
    a, b = edge[0::2], edge[1::2]
    return Prefix(gear(points)).of(a, b), np.searchsorted(start, a, "right") - 1


def _permutations(u: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and summands of as many random orders as make it rarer than MISS that a set of at most u shingles shares no MinHash with q of its own."""
    n = 1 if u <= q else int(np.ceil(np.log(MISS) / np.log1p(-q / u)))
    seed = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * BASE + np.uint64(u))
    return seed[:n] | np.uint64(1), seed[n:]


def _partitions(q: int) -> tuple[int, ...]:
    """The greatest size of the sets of each partition."""
    return q, 2 * q, 4 * q


def _shingle_hashes(texts: list[str], min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the shingles of those texts that have min_words words, by text and place."""
    word, text = word_hashes(texts)
    n = len(word) - SHINGLE + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        h = h * BASE + word[i : n + i]
    long = np.bincount(text, minlength=len(texts)) >= min_words
    own = (text[:n] == text[SHINGLE - 1 :]) & long[text[:n]]
    return mix(h[own]), text[:n][own]


def _repeats(h: np.ndarray, text: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, value) for shingles that come again less than q places on: runs with such have fewer than q different shingles, so the MinHashes alone might miss them."""
    at = [np.flatnonzero((h[:-d] == h[d:]) & (text[:-d] == text[d:])) for d in range(1, min(q, len(h)))]
    at = np.unique(np.concatenate(at)) if at else np.zeros(0, np.int64)
    return text[at], mix(h[at] ^ BASE)


def _once(text: list[np.ndarray], value: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each (text, value) once."""
    t, v = np.concatenate(text or [np.zeros(0, np.int64)]), np.concatenate(value or [np.zeros(0, np.uint64)])
    by = np.lexsort((v, t))
    t, v = t[by], v[by]
    new = np.r_[True, (t[1:] != t[:-1]) | (v[1:] != v[:-1])] if len(t) else np.zeros(0, bool)
    return t[new], v[new]


def query_sketches(texts: list[str], min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, MinHash) of the queries: every window of min_words words of the texts, in the orders of every partition."""
    q = min_words - SHINGLE + 1
    h, text = _shingle_hashes(texts, min_words)
    t, v = _repeats(h, text, q)
    ts, vs = [t], [v]
    if len(h) >= q:
        whole = text[: len(h) - q + 1] == text[q - 1 :]
        for u in _partitions(q):
            for a, b in zip(*_permutations(u, q)):
                vs.append(sliding(h * a + b, q, True)[whole])
                ts.append(text[: len(whole)][whole])
    return _once(ts, vs)


def _pieces(n: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, from, to) of the pieces of texts with n shingles each (0 or q and more): at most 4 q shingles, the last q - 1 being the next one's first, so that every run of q lies in one."""
    most = _partitions(q)[-1]
    step = most - q + 1
    start = np.r_[0, np.cumsum(n)]
    count = np.where(n == 0, 0, np.maximum(1, -(-(n - q + 1) // step)))
    text = np.repeat(np.arange(len(n)), count)
    a = start[text] + step * (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count))
    return text, a, np.minimum(a + most, start[text + 1])


def sketches(texts: list[str], min_words: int, keep: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, MinHash) of the searched sets: the texts' pieces, each in the orders of the partition of its size. keep: which values are of use."""
    q = min_words - SHINGLE + 1
    h, text = _shingle_hashes(texts, min_words)
    who, value = _repeats(h, text, q)
    if keep:
        some = keep(value)
        who, value = who[some], value[some]
    ts, vs = [who], [value]
    of, a, b = _pieces(np.bincount(text, minlength=len(texts)), q)
    size, least = b - a, 0
    for u in _partitions(q):
        mine = (size > least) & (size <= u)
        least = u
        n = size[mine]
        if not len(n):
            continue
        head = np.cumsum(n) - n
        own = h[np.repeat(a[mine] - head, n) + np.arange(n.sum())]
        for x, y in zip(*_permutations(u, q)):
            low = np.minimum.reduceat(own * x + y, head)
            some = keep(low) if keep else slice(None)
            vs.append(low[some])
            ts.append(of[mine][some])
    return _once(ts, vs)


def word_parts(texts: list[str], min_words: int, limit: int = PART_CHARS) -> Iterator[tuple[list[int], list[str]]]:
    """Portions of the texts of about `limit` characters, as (which text, part). Longer texts are cut between words; each part begins with the last min_words - 1 words of the one before."""
    which, held, size = [], [], 0
    for i, t in enumerate(texts):
        at = 0
        while at < len(t):
            end, begins = at, []
            while end < len(t) and len(begins) < min_words:
                m = _GAP.search(t, min(len(t), end + limit))
                end = m.start() if m and end + limit < len(t) else len(t)
                begins = [m.start() for m in _WORD.finditer(t, at, end)] if end < len(t) else []
            if held and size + end - at > limit:
                yield which, held
                which, held, size = [], [], 0
            which.append(i)
            held.append(t[at:end])
            size += end - at
            at = begins[1 - min_words] if end < len(t) else end
    if held:
        yield which, held


def shingles(text: str, n: int) -> set[tuple[str, ...]]:
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def _emit(min_words: int, id_name: str, query: bool, bits: np.ndarray | None = None):
    """(id, minhash) of the queries, or of the searched sets: of these only what the bits, which have a place for each value's last binary digits, know from the queries."""
    keep = None if bits is None else (lambda v: (bits[(v & np.uint64(len(bits) * 8 - 1)) >> np.uint64(3)] >> (v & np.uint64(7)).astype(np.uint8)) & 1 > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for which, texts in word_parts(b.column(1).to_pylist(), min_words):
                text, low = query_sketches(texts, min_words) if query else sketches(texts, min_words, keep)
                yield pa.RecordBatch.from_arrays([pa.array(own[np.array(which)[text]]), pa.array(low.view(np.int64))], names=[id_name, "minhash"])

    return run


def _bits(size: int):
    """The bits that the values of a partition set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.zeros(size, bool)
        for b in batches:
            on[b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) & np.uint64(size - 1)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(on, bitorder="little").tobytes()], pa.binary())], names=["bits"])

    return run


def _search(min_words: int, passages: list[tuple[int, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, h = query_sketches([p for _, p in passages], min_words)
        order = np.argsort(h, kind="stable")
        h, of = h[order], of[order]
        known = np.zeros(1 << 24, bool)
        last = np.uint64(len(known) - 1)
        known[h & last] = True
        exact = [shingles(p, min_words) for _, p in passages]
        for b in batches:
            texts = b.column(1).to_pylist()
            docs, found = [], []
            for which, part in word_parts(texts, min_words):
                text, low = sketches(part, min_words, lambda v: known[v & last])
                a, z = np.searchsorted(h, low, "left"), np.searchsorted(h, low, "right")
                near: dict[int, set[int]] = {}
                for k in np.flatnonzero(z > a):
                    near.setdefault(int(text[k]), set()).update(of[a[k] : z[k]].tolist())
                for t, candidates in near.items():
                    own = shingles(part[t], min_words)
                    for i in sorted(candidates):
                        if not own.isdisjoint(exact[i]):
                            docs.append(which[t])
                            found.append(passages[i][0])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(docs, pa.int64())), pa.array(found, pa.int64())], names=["doc_id", "item_id"])

    return run


def _verify(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for t, p in zip(b.column("text").to_pylist(), b.column("passage").to_pylist()):
                exact = shingles(p, min_words)
                keep.append(any(not exact.isdisjoint(shingles(x, min_words)) for _, part in word_parts([t], min_words) for x in part))
            yield b.select(["doc_id", "item_id"]).filter(pa.array(keep, pa.bool_()))

    return run


def leaked(docs: DataFrame, items: DataFrame, *, min_words: int = 13) -> DataFrame:
    """(doc_id, item_id): documents that hold min_words or more successive words of an item's passage.

    Words are runs of letters and digits; case is ignored. Null and shorter texts and passages match nothing; a repeated doc_id or item_id gives one row a pair, and each of
    its passages is looked for on its own. Whole texts are searched. While the passages have at most ITEM_CHARS characters they are sent to the tasks, which needs no shuffle; beyond
    that the MinHashes of both sides are joined, those of the documents only where a bit table of fixed size knows them from the items. Both ways give the same rows.
    """
    if min_words < SHINGLE:
        raise ValueError(f"min_words must be at least {SHINGLE}")
    p = items.select(F.col("item_id").cast("long").alias("item_id"), "passage").filter("item_id IS NOT NULL AND passage IS NOT NULL").distinct()
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    size = p.agg(F.sum(F.length("passage")).alias("n")).first()["n"] or 0
    if size <= ITEM_CHARS:
        passages = sorted((r["item_id"], r["passage"]) for r in p.collect())  # at most ITEM_CHARS characters
        return d.mapInArrow(_search(min_words, passages), "doc_id long, item_id long").distinct()
    right = written(p.mapInArrow(_emit(min_words, "item_id", True), "item_id long, minhash long").distinct(), "item-sketches")
    bits = np.zeros(BLOOM_BITS // 8, np.uint8)
    for r in right.select("minhash").coalesce(8).mapInArrow(_bits(BLOOM_BITS), "bits binary").toLocalIterator():  # eight rows of BLOOM_BITS / 8 bytes at most
        bits |= np.frombuffer(r["bits"], np.uint8)
    left = d.mapInArrow(_emit(min_words, "doc_id", False, bits), "doc_id long, minhash long").distinct()
    pairs = left.join(right, "minhash").select("doc_id", "item_id").distinct()
    near = pairs.join(p, "item_id").join(d, "doc_id").select("doc_id", "item_id", "text", "passage")
    return near.mapInArrow(_verify(min_words), "doc_id long, item_id long").distinct()

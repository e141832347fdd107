"""Filling containers of fixed capacity: the plan is made on counts of lengths, documents then take planned slots.

There are at most `capacity` lengths, so the histogram and the plan made from it are bounded whatever the number of documents: a plan
has a run for each group of equal containers that takes items of one length, at most about 3 * capacity groups. Documents find
their slot by their rank within their length.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracequarry.session import written

#: Where the public vocabularies lie; a parameter of every function that counts tokens.
TOKENIZERS = "/opt/tokenizers"
#: Documents for which one task ranks.
RANK_ROWS = 200_000
#: Ids of split documents that are sent to every task: 8 MB. More are joined by shuffling the texts.
BROADCAST_IDS = 1_000_000


#: Usual public vocabularies, the one that sizes are counted with first.
VOCABULARIES = ("byte_bpe_50k.tiktoken", "piece_bpe_32k.model", "word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken")


@cache
def _counter(path: str) -> Callable[[str], int]:
    """Counts the tokens of a text, by the kind of vocabulary file: ranks (.tiktoken), pieces (.model) or a whole tokenizer (.json). Strings of special tokens count as ordinary text."""
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda t: len(pieces.encode(t))
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        whole.encode_special_tokens = True
        return lambda t: len(whole.encode(t, add_special_tokens=False).ids)
    import tiktoken

    # Fixed value: the public pre-tokenization pattern of this vocabulary.
    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    e = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda t: len(e.encode_ordinary(t))


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([count(t) for t in b.column(1).to_pylist()], pa.int64())], names=["doc_id", "n_tokens"])

    return run


def _larger(paths: tuple[str, ...], capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [_counter(p) for p in paths]
        for b in batches:
            yield b.select(["doc_id"]).filter(pa.array([all(c(t) > capacity for c in counts) for t in b.column(1).to_pylist()], pa.bool_()))

    return run


def token_counts(docs: DataFrame, *, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """(doc_id, n_tokens) of every document with a text; whole texts are tokenized."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text IS NOT NULL")
    return rows.mapInArrow(_count(vocabulary), "doc_id long, n_tokens long")


def best_fit(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Runs (length, first rank, items, first container) of a best-fit-decreasing plan, and the number of containers.

    Item `first rank + i` of a length goes into container `first container + i`. Groups of containers with the same free space are
    kept as ranges, so the work depends on the lengths and not on the counts.
    """
    runs: list[tuple[int, int, int, int]] = []
    free: dict[int, list[tuple[int, int]]] = {}  # free space: ranges (first container, how many)
    opened = 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        space = length
        while left and space <= capacity:
            here = free.get(space)
            if not here:
                space += 1
                continue
            first, n = here.pop()
            take = min(n, left)
            if take < n:
                here.append((first + take, n - take))
            runs.append((length, rank, take, first))
            free.setdefault(space - length, []).append((first, take))
            rank, left = rank + take, left - take
            # what is left over in these containers is now the tighter fit if another item goes in
            space = max(length, space - length)
        each = capacity // length
        while left:
            n = left // each or 1
            fill = min(each, left)
            for k in range(fill):
                runs.append((length, rank + k * n, n, opened))
            free.setdefault(capacity - fill * length, []).append((opened, n))
            rank, left, opened = rank + fill * n, left - fill * n, opened + n
    return np.array(sorted(runs), np.int64).reshape(-1, 4), opened


def _assign(runs: np.ndarray, base: int):
    key = runs[:, 0] << 44 | runs[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("n_tokens", "rank"))
            at = np.searchsorted(key, n << 44 | rank, "right") - 1
            box = base + runs[at, 3] + rank - runs[at, 1] if len(n) else n
            yield pa.RecordBatch.from_arrays([pa.array(box), *(b.column(c) for c in ("doc_id", "part", "parts", "first_token", "n_tokens"))], names=["container_id", "doc_id", "part", "parts", "first_token", "n_tokens"])

    return run


def pack(sizes: DataFrame, *, capacity: int = 2048) -> DataFrame:
    """(container_id, doc_id, part, parts, first_token, n_tokens): every document of sizes (doc_id, n_tokens) in a container.

    Only documents larger than the capacity are split: into full containers and a rest, which is placed like any other item; parts says into how
    many, part counts from 0. Documents without tokens take no space and get no row. Repeated doc_ids are items of their own.
    """
    spark = sizes.sparkSession
    sized = sizes.filter("n_tokens > 0")
    whole = F.expr(f"n_tokens DIV {capacity}")
    rest = F.col("n_tokens") % capacity
    parts = (whole + F.when(rest > 0, 1).otherwise(0)).cast("int")
    d = sized.select("doc_id", F.col("n_tokens").alias("all"), parts.alias("parts"))
    items = d.select("doc_id", "all", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    items = items.select("doc_id", "part", "parts", (F.col("part") * F.lit(capacity).cast("long")).alias("first_token"), F.least(F.lit(capacity).cast("long"), F.col("all") - F.col("part") * capacity).alias("n_tokens"))
    counts = {r["n_tokens"]: r["n"] for r in items.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    runs, _ = best_fit(counts, capacity)
    salts = max(1, -(-max(counts.values(), default=0) // RANK_ROWS))
    items = items.withColumn("salt", F.pmod(F.xxhash64("doc_id", "part"), F.lit(salts)))
    # rank within a length: the salts before it, then the place within its salt; a length's rows are spread over the salts
    per = items.groupBy("n_tokens", "salt").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select("n_tokens", "salt", before.alias("before"))
    place = F.row_number().over(Window.partitionBy("n_tokens", "salt").orderBy("doc_id", "part"))
    ranked = items.withColumn("place", place).join(per, ["n_tokens", "salt"]).withColumn("rank", F.col("before") + F.col("place") - 1)
    if not counts:
        return spark.createDataFrame([], "container_id long, doc_id long, part int, parts int, first_token long, n_tokens long")
    out = ranked.select("doc_id", "part", "parts", "first_token", "n_tokens", F.col("rank").cast("long").alias("rank"))
    return out.mapInArrow(_assign(runs, 0), "container_id long, doc_id long, part int, parts int, first_token long, n_tokens long")


def pack_documents(docs: DataFrame, *, capacity: int = 2048, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """pack() of the documents' texts, which are tokenized once. Null texts get no row."""
    return pack(written(token_counts(docs, vocabulary=vocabulary), "token-counts"), capacity=capacity)


def split_documents(docs: DataFrame, *, capacity: int = 2048, folder: str = TOKENIZERS, vocabularies: tuple[str, ...] = VOCABULARIES) -> DataFrame:
    """(doc_id): the documents that pack_documents() splits and that all vocabularies count as larger than a container.

    The containers are filled by the first vocabulary's counts; only what it splits is counted with the others, each where those before it agree. Null texts get no row; doc_id must be unique.
    """
    first, *others = (f"{folder}/{v}" for v in vocabularies)
    big = written(pack_documents(docs, capacity=capacity, vocabulary=first).filter("parts > 1 AND part = 0").select("doc_id"), "split")
    if big.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        big = F.broadcast(big)  # so that no text is shuffled
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text IS NOT NULL")
    return texts.join(big, "doc_id", "left_semi").mapInArrow(_larger(tuple(others), capacity), "doc_id long")

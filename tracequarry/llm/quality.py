"""Text statistics per document and posterior text types.

Thresholds on statistics of a line and of its document are noisy labelling functions: each gives the line one of a few values, which speak for some of the types prose, list,
table and junk or for none. How accurate each vote is is learned by expectation-maximization on the agreements of the functions over all lines of the corpus, weighted by characters; no
vote is fixed and all start alike. As only the combination of values matters, the corpus goes into the learning as a table of combinations, which is
bounded by the functions and not by the documents. A document's types are the posteriors of its lines, weighted by characters.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracequarry.session import written

TYPES = ("prose", "list", "table", "junk")

# Frequent function words of English, German, French, Spanish, Italian, Portuguese and Dutch.
COMMON = frozenset(
    """
    the of and to a in is it that was for on are as with be at by this have from or had not but what all were when we there can an your which their
    if will each about how up out them then she he they you i so has do no could would should only more than into our its his her who why because
    der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei wir am
    dann noch wie über so zum war haben nur oder aber vor zur bis mehr durch man sein wurde wenn nichts ob weil damit
    de la le les et des un une du en que qui dans est pour pas au sur ne se ce il sont plus par avec tout mais ou nous comme cette ont être fait
    quand car lui elle aux donc sans
    el los las y que se por con una su para es al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay
    donde quien desde todo nos uno no
    di che è per non sono della con più anche come ma il lo gli alla
    o os do da em não uma com mais foi ao ele das dos
    het een van niet zijn op te met voor er maar om hem dan zou wat mijn
    """.split()
)

# What each value of each labelling function speaks for; None where it is silent. The last five look at the document, the others at the line.
FUNCTIONS: dict[str, dict[str, str | None]] = {
    "common_words": {"short": None, "none": "list table junk", "few": None, "some": "prose", "many": "junk"},
    "symbols": {"low": "prose", "middle": None, "high": "list table junk"},
    "ending": {"sentence": "prose", "open": None},
    "marker": {"item": "list", "code": "list junk", "plain": None},
    "cells": {"many": "table", "one": None},
    "width": {"few words": "list table", "line": None, "paragraph": "prose", "solid": "junk"},
    "words": {"few": "list table junk", "most": None},
    "consonants": {"clustered": "junk", "usual": None},
    "word_length": {"long": "junk", "usual": None},
    "vowels": {"odd": "junk", "usual": None},
    "letters": {"garbled": "junk", "usual": None},
    "pairs": {"salad": "junk", "usual": None},
    "run": {"long": "junk", "usual": None},
    "variety": {"little": "junk", "usual": None},
    "stops": {"none": "list table junk", "some": None},
    "same_line": {"often": "junk", "once": None},
    "line_variety": {"little": "junk", "usual": None},
    "five_words": {"again": "junk", "new": None},
    "two_words": {"again": "junk", "new": None},
    "beginning": {"again": "junk", "once": None},
    "packed": {"small": "junk", "middle": None, "large": "junk"},
}
#: How far a vote is trusted before anything is learned, between chance (0) and certainty (1): the same for every vote.
TILT = 0.5
_NAMES = {f: tuple(v) for f, v in FUNCTIONS.items()}
_BASE = [int(x) for x in np.cumprod([1, *(len(v) for v in FUNCTIONS.values())])]
_VOTES = [(i, j, np.array([t in kinds.split() for t in TYPES])) for i, values in enumerate(FUNCTIONS.values()) for j, kinds in enumerate(values.values()) if kinds]

_STATS = "n_chars long, word_count long, mean_word_length double, symbol_ratio double, punctuated_line_share double, common_word_share double, repeated_line_share double"
_LINE_SCHEMA = f"doc_id long, {_STATS}, lines array<struct<pattern:long,chars:long>>"

_ITEM = re.compile(
    r"\s*(?:[-*•+–·o▪] +(?:\[[ xX]\] )?\S|\[[ xX]\] |\(?\d{1,4}[.)] |[a-z][.)] |[-dl][rwxsStT-]{9}|(?:\?\?|[MADRCU]{1,2}) [\w./-]+/|\.{0,2}/?[\w.-]+(?:/[\w.-]+)+\s*$|[\w.-]+(?:==|>=|~=|<=|\^)[\w.]+\s*$|[\w.-]+\s*[:=]\s*\S+(?: \S+)?\s*$)"
)
_CODE = re.compile(r"\s*(?:(?:INFO|WARN|WARNING|ERROR|DEBUG|TRACE|FATAL)\b|(?:def|class|if|for|while|return|import|from|elif|else|try|with)\b[^.?!]*[:(]\s*$|(?:def|class) \w+|[\w.\[\]]+ = \S|[\w./-]+\.\w{1,5}:\d+:|[}\]{\[<]|```|~~~|#!|\$ |>>> )|^(?: {4}|\t)\S.*[(){}=;:]")
_GAPS = re.compile(r"\S(?: {2,}|\t)(?=\S)")
_SENTENCE = re.compile(r"[.?!…。！？:][\"'»”’)\]]*\s*$")
_HARD = re.compile(r"[bcdfghjklmnpqrstvwxz]{5}")
_WORDISH = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_MOJIBAKE = re.compile("[ÃÂ�€™ï¿½\x00-\x08\x0b\x0c\x0e-\x1f]")
_STOPS = re.compile(r"[.,;:!?…。！？，、؟،]")
_ASCII_LETTERS, _VOWELS = bytes(range(97, 123)), b"aeiouy"


def _salad(common: list[bool]) -> tuple[int, int]:
    """(function words directly after another, longest run of them) of a line's words."""
    pairs = run = longest = 0
    for c in common:
        if c:
            run += 1
            pairs += run > 1
            longest = max(longest, run)
        else:
            run = 0
    return pairs, longest


def line_votes(line: str, fenced: bool) -> tuple[list[int], int, int, int, int, bool]:
    """(values of the line's functions, words, letters in words, symbols, common words, ends like a sentence) of a line that isn't blank."""
    tokens = line.split()
    n = len(tokens)
    low = line.lower()
    found = _WORDISH.findall(low)
    words = len(found)
    letters = sum(map(len, found))
    solid = sum(map(len, tokens))
    symbols = solid - letters
    known = [w in COMMON for w in found]
    common = sum(known)
    share = common / n if n else 0.0
    sentence = bool(_SENTENCE.search(line))
    plain = low.isascii()
    wide = letters > 2 * n * 8 and not plain and words < letters / 12  # scripts without spaces
    ratio = symbols / solid if solid else 1.0
    cells = max(line.count("|"), line.count("\t"), line.count(";") - 1, line.count(",") - 2 if line.count(", ") * 2 < line.count(",") else 0, len(_GAPS.findall(line)) if "  " in line else 0)
    vowels = salad = run = variety = stops = 1
    if letters >= 20:
        raw = low.encode("ascii", "ignore")
        own = len(raw) - len(raw.translate(None, _ASCII_LETTERS))
        if own >= 20 and own > 0.5 * letters:
            vowels = int(0.27 * own <= len(raw) - len(raw.translate(None, _VOWELS)) <= 0.55 * own)
        if n >= 20:
            if common > 8 or common > 0.4 * words:
                pairs, longest = _salad(known)
                salad, run = int(pairs <= 0.4 * words), int(longest <= 8)
            if n >= 24:
                variety = int(len(set(tokens)) >= 0.45 * n)
    if n >= 25 and not wide:
        stops = int(len(_STOPS.findall(line)) >= n / 60)
    values = [
        0 if n < 5 or wide else 1 if share < 0.04 else 2 if share < 0.14 else 4 if share > 0.55 and n >= 20 else 3,
        0 if ratio < 0.09 else 1 if ratio < 0.2 else 2,
        0 if sentence else 1,
        1 if fenced or _CODE.match(line) else 0 if _ITEM.match(line) else 2,
        0 if cells >= 2 and n < 6 * (cells + 1) else 1,
        3 if solid > 30 * n and not wide else 0 if n < 5 and not wide else 2 if n >= 16 or wide else 1,
        0 if words < 0.5 * n else 1,
        0 if n >= 3 and len(_HARD.findall(low)) > 0.12 * n else 1,
        0 if words and letters / words > 16 and not wide else 1,
        vowels,
        0 if not line.isascii() and len(_MOJIBAKE.findall(line)) > 0.06 * solid else 1,
        salad,
        run,
        variety,
        stops,
    ]
    return values, words, letters, symbols, common, sentence


def document_votes(text: str, lines: list[str], kinds: int) -> list[int]:
    """The values of the document's functions: how much of it says again what it has said. kinds: its distinct lines."""
    w = text.split()
    fives = max(len(w) - 4, 0)
    raw = text.encode("utf-8", "replace")
    packed = len(zlib.compress(raw, 1)) / len(raw) if len(raw) >= 300 else 0.5
    return [
        0 if len(lines) >= 6 and kinds < 0.5 * len(lines) else 1,
        0 if fives >= 20 and len(set(zip(w, w[1:], w[2:], w[3:], w[4:]))) < 0.5 * fives else 1,
        0 if len(w) >= 40 and len(set(zip(w, w[1:]))) < 0.3 * len(w) else 1,
        0 if len(text) >= 120 and text.count(text.lstrip()[:40]) > 2 else 1,
        0 if packed < 0.2 else 2 if packed > 0.68 else 1,
    ]


def describe(text: str) -> tuple[tuple, dict[int, int]]:
    """The statistics of a text and the characters of its lines by vote pattern."""
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    seen: dict[str, int] = {}
    for x in lines:
        seen[x] = seen.get(x, 0) + 1
    whole = document_votes(text, lines, len(seen)) if lines else []
    patterns: dict[int, int] = {}
    words = letters = symbols = common = ends = again = 0
    fenced = False
    for x in lines:
        fence = x.lstrip()[:3] in ("```", "~~~") and len(set(x.strip())) > 1 or x.strip() == "```"
        often = seen[x] > 2 and len(x) > 15
        v, w, c, s, k, e = line_votes(x, fenced or fence)
        if fence:
            fenced = not fenced
        p = sum(map(mul, [*v, 0 if often else 1, *whole], _BASE))
        patterns[p] = patterns.get(p, 0) + len(x)
        words, letters, symbols, common, ends, again = words + w, letters + c, symbols + s, common + k, ends + e, again + often
    n = max(len(lines), 1)
    stats = (len(text), words, letters / words if words else 0.0, symbols / max(letters + symbols, 1), ends / n, common / words if words else 0.0, again / n)
    return stats, patterns


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("pattern", pa.int64()), ("chars", pa.int64())]))
    for b in batches:
        rows = [describe(t) for t in b.column(1).to_pylist()]
        cols = list(zip(*(r[0] for r in rows))) or [()] * 7
        lines = pa.array([[{"pattern": p, "chars": c} for p, c in r[1].items()] for r in rows], kind)
        ints = (pa.int64(), pa.int64(), *[pa.float64()] * 5)
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, ints)), lines], names=["doc_id", *(x.split()[0] for x in _STATS.split(", ")), "lines"])


def learn(patterns: np.ndarray, weight: np.ndarray, rounds: int = 30, prior: float = 0.001) -> tuple[np.ndarray, dict[tuple[str, str], float]]:
    """(P(type | pattern), a row for each pattern; learned accuracy of each vote).

    A vote (function, value) names a set of types; its accuracy is the share of the characters it is given for whose type is in the set. With the types' shares it
    gives how much likelier the vote is for those types than for others, the same for all in the set and for all outside. E: the posteriors of the patterns; M: shares and accuracies from
    the posteriors. All votes start alike, TILT of the way from chance to certainty, so what is found later comes from their agreements. prior: what the start counts, as a share of the data.
    """
    given = [patterns // _BASE[i] % len(v) for i, v in enumerate(FUNCTIONS.values())]
    on = [given[i] == j for i, j, _ in _VOTES]
    weight = weight / max(weight.sum(), 1)
    share = np.full(len(TYPES), 1 / len(TYPES))
    start = [kinds.mean() + TILT * (1 - kinds.mean()) for _, _, kinds in _VOTES]
    accuracy = list(start)
    post = np.zeros((len(patterns), len(TYPES)))
    for _ in range(rounds):
        log = np.tile(np.log(share), (len(patterns), 1))
        for (_, _, kinds), a, here in zip(_VOTES, accuracy, on):
            a, p = np.clip(a, 1e-4, 1 - 1e-4), np.clip(share[kinds].sum(), 1e-6, 1 - 1e-6)
            log[here] += np.where(kinds, np.log(a / p), np.log((1 - a) / (1 - p)))
        post = np.exp(log - log.max(axis=1, keepdims=True))
        post /= post.sum(axis=1, keepdims=True)
        w = post * weight[:, None]
        share = (w.sum(axis=0) + prior / len(TYPES)) / (w.sum() + prior)
        accuracy = [(w[here][:, kinds].sum() + prior * s) / (weight[here].sum() + prior) for (_, _, kinds), s, here in zip(_VOTES, start, on)]
    names = list(_NAMES)
    return post, {(names[i], _NAMES[names[i]][j]): float(a) for (i, j, _), a in zip(_VOTES, accuracy)}


def _learned(described: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[tuple[str, str], float]]:
    """(patterns, characters of each, posteriors, accuracies) of a described corpus."""
    seen = described.select(F.explode("lines").alias("x")).groupBy("x.pattern").agg(F.sum("x.chars").alias("chars")).collect()  # at most as many rows as combinations of values
    patterns, chars = (np.array([r[c] for r in seen], np.int64) for c in ("pattern", "chars"))
    return patterns, chars, *learn(patterns, chars.astype(np.float64))


def _described(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text IS NOT NULL AND text <> ''")
    return written(rows.mapInArrow(_describe, _LINE_SCHEMA), "text-types")


def vote_accuracies(docs: DataFrame) -> DataFrame:
    """(function, value, types, chars, accuracy): every vote with the characters of the lines that it is given for and its learned accuracy; votes that are never given have the start's."""
    patterns, chars, _, accuracy = _learned(_described(docs))
    rows = []
    for i, (f, values) in enumerate(FUNCTIONS.items()):
        for j, (value, kinds) in enumerate(values.items()):
            if kinds:
                rows.append((f, value, kinds, int(chars[patterns // _BASE[i] % len(values) == j].sum()), accuracy[f, value]))
    return docs.sparkSession.createDataFrame(rows, "function string, value string, types string, chars long, accuracy double")


def text_types(docs: DataFrame) -> DataFrame:
    """(doc_id, statistics, a posterior share for each type, text_type): one row for each document with a text that isn't empty.

    Shares are of the characters in lines that aren't blank; a text of white space alone has shares 0 and type junk. Repeated doc_ids give a row each.
    """
    spark = docs.sparkSession
    d = _described(docs)
    patterns, _, post, _ = _learned(d)
    table = spark.createDataFrame([(int(p), *map(float, q)) for p, q in zip(patterns, post)], "pattern long, " + ", ".join(f"p_{t} double" for t in TYPES))
    stats = [x.split()[0] for x in _STATS.split(", ")]
    # one row that holds the posteriors of all patterns goes to every task: a document stays in its row
    known = table.agg(F.map_from_entries(F.collect_list(F.struct("pattern", F.struct(*(f"p_{t}" for t in TYPES))))).alias("post"))
    x = d.join(F.broadcast(known))
    total = F.aggregate("lines", F.lit(0).cast("long"), lambda a, r: a + r["chars"])
    part = lambda t: F.aggregate("lines", F.lit(0.0), lambda a, r: a + r["chars"] * F.element_at("post", r["pattern"])[f"p_{t}"])
    x = x.withColumn("_n", total).select("doc_id", *stats, *(F.when(F.col("_n") > 0, part(t) / F.col("_n")).otherwise(0.0).alias(f"{t}_share") for t in TYPES))
    best = F.greatest(*(f"{t}_share" for t in TYPES))
    kind = F.when(best == 0, "junk")
    for t in TYPES:
        kind = kind.when(F.col(f"{t}_share") == best, t)
    return x.withColumn("text_type", kind)

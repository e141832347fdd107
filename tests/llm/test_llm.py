"""The text operators against brute force, round trips and edge cases."""

import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracequarry.llm import codes, contamination, conversations, packing, personal, quality, shared_spans
from tracequarry.sources.schemas import LINE

# Shared stretches


def shared_brute(rows, k=120):
    rid, win = {}, {}
    for i, t, s, _, _ in rows:
        rid[t, s] = min(i, rid.get((t, s), i))
    for i, t, s, a, b in rows:
        for x in (a, b):
            for j in range(len(x or "") - k + 1):
                win.setdefault(x[j : j + k], set()).add(rid[t, s])
    out = set()
    for v in win.values():
        v = sorted(v)
        out |= {(x, y) for n, x in enumerate(v) for y in v[n + 1 :]}
    return out


def shared_rows():
    r = random.Random(4)
    text = lambda n: "".join(r.choice("abcde é😀\n") for _ in range(n))
    stock = [text(n) for n in (119, 120, 121, 130, 300, 900)]
    rows = []
    for i in range(160):
        part = r.choice(stock)
        cut = r.choice([0, 0, 0, 1, 5])
        rows.append((i, f"t{i}", "s", text(r.randrange(0, 90)) + part[cut:] + text(r.randrange(0, 90)) if r.random() < 0.5 else text(r.randrange(0, 400)), r.choice([None, "", text(50), "x" * 400, "ab" * 100, part])))
    rows += [(1000 + i, t, s, a, b) for i, (_, t, s, a, b) in enumerate(rows[::9])] + [(2000, None, None, stock[4], None), (2001, None, None, stock[4], None), (2002, "q", "s", "y" * 119, "z")]
    return rows


_SHARED = "id long, trace_id string, span_id string, a string, b string"


@pytest.mark.parametrize("few", [200_000, -1])
def test_shared_pairs_equal_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(shared_spans, "BROADCAST_ROWS", few)
    rows = shared_rows()
    df = spark.createDataFrame(rows, _SHARED)
    got = [tuple(x) for x in shared_spans.shared_pairs(df, texts=["a", "b"], same=["trace_id", "span_id"]).collect()]
    want = shared_brute(rows)
    assert len(got) == len(set(got)) and set(got) == want
    classes = shared_spans.shared_classes(df, texts=["a", "b"], same=["trace_id", "span_id"]).collect()
    first = {}
    for i, t, s, _, _ in rows:
        first[t, s] = min(i, first.get((t, s), i))
    assert sorted(r.id for r in classes) == sorted(first.values())
    links = {i: sum(i in p for p in want) for i in first.values()}
    assert {r.id: r.links for r in classes} == links
    of = {r.id: r.class_id for r in classes}
    assert all((min(i, c), max(i, c)) in want for i, c in of.items() if i != c)
    assert {r.id: r.members for r in classes} == {i: sum(x == c for x in of.values()) for i, c in of.items()}
    for f in (shared_spans.shared_pairs, shared_spans.shared_classes, shared_spans.shared_share):
        assert f(df.limit(0), texts=["a", "b"], same=["trace_id", "span_id"]).count() == 0


def test_equal_hashes_are_no_verdict(spark, monkeypatch):
    """With a hash that is the same for all texts nothing is found that isn't there."""
    monkeypatch.setattr(shared_spans, "BROADCAST_ROWS", 200_000)
    r = random.Random(9)
    text = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    same = text(150)
    first = spark.createDataFrame([(i, text(120)) for i in range(3)] + [(4, same[:120]), (5, same[:120])], "rid long, t string").select("rid", F.unhex(F.sha2("t", 256)).alias("digest"))
    member, pairs = shared_spans._classes(first)
    assert sorted(tuple(x) for x in member.collect()) == [(4, 4), (5, 4)] and pairs.count() == 0


def test_long_texts_are_taken_in_parts():
    r = random.Random(8)
    texts = ["".join(r.choice("abcd ") for _ in range(n)) for n in (50, 5000, 120, 119, 777)]
    held = list(codes.parts(texts, 119, limit=300))
    assert all(sum(map(len, p)) <= 700 for _, _, p in held)
    windows = {(w, at + i, p[i : i + 120]) for which, where, ps in held for w, at, p in zip(which, where, ps) for i in range(len(p) - 119)}
    assert windows == {(i, j, t[j : j + 120]) for i, t in enumerate(texts) for j in range(len(t) - 119)}


def test_share_of_a_record(spark):
    r = random.Random(1)
    t = "".join(r.choice("abcdefgh") for _ in range(200))
    df = spark.createDataFrame([(1, "a", "s", "xx" + t + "yy", None), (2, "b", "s", t[:150], "zz"), (3, "c", "s", None, None), (4, "a", "s", "xx" + t + "yy", None)], _SHARED)
    got = {r.id: (r.n_chars, r.shared_chars) for r in shared_spans.shared_share(df, texts=["a", "b"], same=["trace_id", "span_id"]).collect()}
    assert got == {1: (204, 150), 2: (152, 150), 3: (0, 0)}


def test_min_len_guard():
    with pytest.raises(ValueError):
        shared_spans.least_chunk(60)


# Packing


def test_best_fit_places_every_item_once():
    r = random.Random(2)
    for _ in range(30):
        cap = r.choice([10, 64, 2048])
        counts = {n: r.randrange(1, 60) for n in r.sample(range(1, cap + 1), min(cap, 12))}
        runs, boxes = packing.best_fit(counts, cap)
        load, placed = np.zeros(boxes, int), {n: [] for n in counts}
        for n, rank, items, box in runs:
            load[box : box + items] += n
            placed[n] += range(rank, rank + items)
        assert load.max() <= cap and load.min() > 0
        assert all(sorted(v) == list(range(counts[n])) for n, v in placed.items())
        total = sum(n * c for n, c in counts.items())
        assert boxes <= 1.3 * max(total / cap, sum(c for n, c in counts.items() if 2 * n > cap)) + 2


def test_pack_round_trip(spark):
    sizes = [(i, n) for i, n in enumerate([1, 2047, 2048, 2049, 5000, 0, 700, 700, 700, 4096] + [100] * 50)] + [(6, 700)]
    out = packing.pack(spark.createDataFrame(sizes, "doc_id long, n_tokens long")).collect()
    load = {}
    for r in out:
        load[r.container_id] = load.get(r.container_id, 0) + r.n_tokens
    assert max(load.values()) <= 2048 and sum(load.values()) == sum(n for _, n in sizes)
    assert {r.doc_id for r in out if r.parts > 1} == {3, 4, 9}
    assert len(load) <= sum(load.values()) / 2048 + 3
    assert packing.pack(spark.createDataFrame([], "doc_id long, n_tokens long")).count() == 0


def test_tokens_of_odd_texts(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, "<|endoftext|>"), (4, "word " * 3000)], "doc_id long, text string")
    n = {r.doc_id: r.n_tokens for r in packing.token_counts(df).collect()}
    assert n[1] == 0 and 2 not in n and n[3] > 1 and n[4] > 2048


@pytest.mark.parametrize("few", [1_000_000, -1])
def test_split_where_all_vocabularies_agree(spark, monkeypatch, few):
    monkeypatch.setattr(packing, "BROADCAST_IDS", few)
    docs = {1: "word " * 3000, 2: "short", 3: " \n\t" * 3000 + "end", 4: None, 5: "", 6: "é🙂" * 3000, 7: "word " * 2040}
    df = spark.createDataFrame([(k, v, "clash") for k, v in docs.items()], "doc_id long, text string, n_tokens string")
    counts = {v: {k: packing._counter(f"{packing.TOKENIZERS}/{v}")(t) for k, t in docs.items() if t} for v in packing.VOCABULARIES}
    want = {k for k in docs if all(c.get(k, 0) > 2048 for c in counts.values())}
    assert {r.doc_id for r in packing.split_documents(df).collect()} == want and 1 in want and not want & {2, 3, 4, 5, 7}
    assert any(c[3] > 2048 for c in counts.values())
    assert packing.split_documents(df.limit(0)).count() == 0


# Contamination


def test_leaks_equal_brute_force(spark, monkeypatch):
    r = random.Random(3)
    w = lambda n: [r.choice("alpha beta gamma delta eins zwei drei fünf 7 42".split()) + str(r.randrange(30)) for _ in range(n)]
    items = {i: w(r.choice([5, 12, 13, 30])) for i in range(8)}
    docs = {}
    for d in range(120):
        it = items[r.randrange(8)]
        n = r.choice([0, 12, 13, 20])
        a = r.randrange(0, max(1, len(it) - n + 1))
        docs[d] = r.choice([" ", "  **", "\n> ", "-", " "]).join(w(r.randrange(0, 30)) + [x.upper() if r.random() < 0.3 else x for x in it[a : a + n]] + w(r.randrange(0, 30)))
    docs |= {900: None, 901: "", 902: "word"}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    ev = spark.createDataFrame([(i, " ".join(p)) for i, p in items.items()] + [(99, None), (98, "")], "item_id long, passage string")
    grams = lambda t: {tuple(x[i : i + 13]) for x in [re.findall(r"[^\W_]+", (t or "").lower())] for i in range(len(x) - 12)}
    want = {(d, i) for d, t in docs.items() for i, p in items.items() if grams(t) & grams(" ".join(p))}
    got = {tuple(x) for x in contamination.leaked(df, ev).collect()}
    assert got == want and want
    monkeypatch.setattr(contamination, "ITEM_CHARS", -1)
    assert {tuple(x) for x in contamination.leaked(df, ev).collect()} == want
    assert contamination.leaked(df.limit(0), ev).count() == 0 and contamination.leaked(df, ev.limit(0)).count() == 0


@pytest.mark.parametrize("chars", [200_000, -1])
def test_two_passages_of_an_item(spark, monkeypatch, chars):
    """A run over the end of one passage and the begin of another is no leak, whichever way is taken."""
    monkeypatch.setattr(contamination, "ITEM_CHARS", chars)
    one, two = " ".join(f"a{i}" for i in range(20)), " ".join(f"b{i}" for i in range(20))
    docs = {1: one[-20:] + " " + two[:20], 2: one, 3: two, 4: " ".join((one + " " + two).split()[12:30]), 5: ("w " * 40).strip()}
    ev = spark.createDataFrame([(7, one), (7, two), (7, one), (8, "w " * 13), (None, one)], "item_id long, passage string")
    df = spark.createDataFrame([*docs.items(), (2, one), (None, one)], "doc_id long, text string")
    assert sorted(tuple(x) for x in contamination.leaked(df, ev).collect()) == [(2, 7), (3, 7), (5, 8)]


def test_contained_queries_share_a_minhash():
    """Every window of a long text is found in its pieces, also where words come again and where the text is cut into parts."""
    r = random.Random(6)
    text = " ".join(r.choice(["one", "two", f"w{r.randrange(400)}"]) for _ in range(3000))
    w = text.split()
    for n in (13, 20, 41, 300):
        at = r.randrange(len(w) - n)
        own = set(contamination.sketches([" ".join(w[at : at + n])], 13)[1].tolist())
        for k in range(at, at + n - 12):
            assert own & set(contamination.query_sketches([" ".join(w[k : k + 13])], 13)[1].tolist())
    cut = [x for _, part in contamination.word_parts(["short text", text, "", "x" * 900], 13, limit=500) for x in part]
    assert len(cut) > 20 and set().union(*(contamination.shingles(x, 13) for x in cut)) == contamination.shingles(text, 13)


# Conversations


def line(sid, uuid, kind, content, at):
    return (kind, None, uuid, (content,) if content is not None else None, None, None, at, sid, None, None)


USE = '[{"type":"tool_use","id":"t1","name":"Read"}]'
RES = '[{"type":"tool_result","tool_use_id":"t1","content":"x"}]'


def talk(sid, *turns):
    return [line(sid, f"{sid}{i}", k, c, f"2026-01-01T{h:02d}:00:00Z" if isinstance(h, int) else h) for i, (k, c, h) in enumerate(turns)]


def test_conversations_kept_and_dropped(spark):
    rows = [
        *talk("ok", ("user", "a", 1), ("assistant", "b", 9), ("user", "c", 15), ("assistant", "d", 22)),
        *talk("tools", ("user", "a", 1), ("assistant", USE, 2), ("user", RES, 3), ("assistant", "d", 4)),
        *talk("blank", ("user", "a", 1), ("user", " \n", 2), ("user", "[]", 2), ("user", '[{"type":"text","text":" "}]', 2), ("assistant", "b", 3)),
        *talk("ms", ("user", "a", "1767225600000"), ("assistant", "b", "2026-01-01T02:00:00+01:00")),
        *talk("open", ("user", "a", 1)), *talk("first", ("assistant", "a", 1), ("user", "b", 2), ("assistant", "c", 3)), *talk("twice", ("user", "a", 1), ("user", "b", 8), ("assistant", "c", 9)),
        *talk("noresult", ("user", "a", 1), ("assistant", USE, 2)), *talk("nouse", ("user", "a", 1), ("assistant", "b", 2), ("user", RES, 3), ("assistant", "c", 4)),
        *talk("late", ("user", "a", 2), ("assistant", USE, 5), ("user", RES, 4), ("assistant", "d", 7)), *talk("time", ("user", "a", "soon"), ("assistant", "b", 2)),
        line(None, "n", "user", "a", "2026-01-01T00:00:00Z"), line("none", "n", "user", None, None),
    ]
    df = spark.createDataFrame(rows + rows[:4], LINE)
    for chunk in (conversations.HOUR_US, 100 * conversations.HOUR_US):
        got = {}
        for r in conversations.conversations(df, chunk_us=chunk).collect():
            got.setdefault(r.session_id, {})[r.turn_no] = r.uuid
        assert got == {"ok": {i + 1: f"ok{i}" for i in range(4)}, "tools": {i + 1: f"tools{i}" for i in range(4)}, "blank": {1: "blank0", 2: "blank4"}, "ms": {1: "ms0", 2: "ms1"}}
    fixed = {r.session_id for r in conversations.conversations(df, max_offset_us=2 * conversations.HOUR_US).collect()}
    assert "late" in fixed
    assert conversations.conversations(df.limit(0)).count() == 0


def test_least_squares_offsets(spark):
    """The offset is the least that minimises the squares of what the bounds are missed by, where that sum can be 0."""
    r = random.Random(12)
    rows, want = [], {}
    for i in range(60):
        lows, highs = [r.choice([None, r.randrange(-50, 900)]) for _ in range(r.randrange(1, 9))], [r.choice([None, 2000 + r.randrange(900)]) for _ in range(3)]
        if i % 2:  # the other way round
            lows, highs = [None if h is None else -h for h in highs], [None if x is None else -x for x in lows]
        rows += [(f"s{i}", x, None) for x in lows] + [(f"s{i}", None, x) for x in highs]
        lo, hi = max((x for x in lows if x is not None), default=-(10**6)), min((x for x in highs if x is not None), default=10**6)
        want[f"s{i}"] = min(max(0, lo), hi)
    limits = spark.createDataFrame(rows, "session_id string, low long, high long")
    fit = limits.select("session_id").distinct()
    got = {r.session_id: r.d for r in conversations.least_squares(limits, fit).collect()}
    assert got == want

    def rest(sid, d):
        return sum(max(0, (lo if lo is not None else d) - d) ** 2 + max(0, d - (hi if hi is not None else d)) ** 2 for s, lo, hi in rows if s == sid)

    assert all(rest(s, d) == 0 and (d == 0 or rest(s, d - (d > 0) + (d < 0)) > 0) for s, d in got.items())


@pytest.mark.parametrize("chunk", [60_000_000, 100 * conversations.HOUR_US])
def test_clocks_are_corrected(spark, chunk):
    """The user's clock is ahead by 90 seconds, so that results seem to come late, or behind, so that questions come in a row."""
    at = lambda s: f"2026-01-01T00:{s // 60:02d}:{s % 60:02d}Z"
    true = [("user", "a", 100), ("assistant", USE, 130), ("user", RES, 150), ("assistant", "b", 200), ("user", "c", 260), ("assistant", "d", 330)]
    rows, want = [], {}
    for sid, off in (("right", 0), ("behind", -90), ("ahead", 61), ("far", 900)):
        rows += talk(sid, *((k, c, at(s + off * (k == "user"))) for k, c, s in true))
        want[sid] = [f"{sid}{i}" for i in range(6)]
    rows += talk("never", ("user", "a", at(0)), ("assistant", USE, at(300)), ("user", RES, at(100)), ("user", "x", at(110)), ("assistant", "b", at(105)))
    df = spark.createDataFrame(rows, LINE)
    got = {}
    for r in conversations.conversations(df, max_offset_us=300_000_000, chunk_us=chunk).orderBy("session_id", "turn_no").collect():
        got.setdefault(r.session_id, []).append(r.uuid)
    assert got == {k: want[k] for k in ("right", "behind", "ahead")}
    assert {r.session_id for r in conversations.conversations(df, chunk_us=chunk).collect()} == {"right"}


def test_stored_times_are_kept_by_their_estimate(spark, monkeypatch):
    """Without corrections, too, each conversation is kept by its least-squares offset: all get one that no bound excludes, and of those the ones with 0 are kept."""
    rows = [
        *talk("right", ("user", "a", 1), ("assistant", USE, 2), ("user", RES, 3), ("assistant", "b", 4)), *talk("plain", ("user", "a", 1), ("assistant", "b", 2)),
        *talk("late", ("user", "a", 2), ("assistant", USE, 5), ("user", RES, 4), ("assistant", "d", 7)), *talk("open", ("user", "a", 1)),
    ]
    df = spark.createDataFrame(rows, LINE)
    kept = lambda: {r.session_id for r in conversations.conversations(df).collect()}
    solve, seen = conversations.least_squares, {}

    def watched(limits, fit):
        d = solve(limits, fit)
        seen.update({r.session_id: r.d for r in d.collect()})
        return d

    monkeypatch.setattr(conversations, "least_squares", watched)
    assert kept() == {"right", "plain"}
    assert seen == {"right": 0, "plain": 0, "late": conversations.HOUR_US + 1}
    monkeypatch.setattr(conversations, "least_squares", lambda limits, fit: solve(limits, fit).withColumn("d", F.when(F.col("session_id") == "plain", 1).otherwise(F.col("d"))))
    assert kept() == {"right"}


# Personal items


def test_bootstrapping_finds_the_unknown(spark):
    texts = [f"assigned to {n}" for n in ("Runa Wesney", "Dario Grimund", "Tevin Quenquist", "EDDA ORRBROOK")] + ["the Amber Gateway docs", "pager=+1 (506) 555-0106", "pager=+49 30 2312 5843", "pager=0207946 0777", "build 8484636266 finished at 1768151892"]
    texts += ["SSN 931-54-7491 was in the fixture", "order of columns: 79-74-0087x", "he lives at 738 Tarnbeck Avenue, Apt 5, Eastmere now", "he lives at 12 Elm Street now", "he lives at Am Tannkamp 39, 93555 Windhollow now", "see section 11 Trace Tree, table 6.4", "git clone git@code.example:a/b.git", "mail x.y+z@dev.example.net or a [at] lab.test", "", '[{"type":"text","text":"ask Runa Wesney\\nfor a review"}]']
    df = spark.createDataFrame([line("s", f"u{i}", "user", t, None) for i, t in enumerate(texts)] + [line("s", None, "user", "x@y.zz", None), line("s", "nul", "user", None, None)], LINE).withColumn("kind", F.lit("clash"))
    people = spark.createDataFrame([("Runa Wesney",), ("Dario Grimund",), (None,), ("Single",)], "person_name string")
    got = {}
    for r in personal.personal_kinds(df, people).collect():
        got.setdefault(int(r.uuid[1:]), set()).add(r.kind)
    assert got == {0: {"name"}, 1: {"name"}, 2: {"name"}, 3: {"name"}, 5: {"phone"}, 6: {"phone"}, 7: {"phone"}, 9: {"id_number"}, 11: {"address"}, 12: {"address"}, 13: {"address"}, 16: {"email"}, 18: {"name"}}
    red = {r.uuid: r.text for r in personal.redacted(df, people).collect()}
    assert red["u2"] == "assigned to [NAME]" and red["u16"] == "mail [EMAIL] or [EMAIL]" and red["u4"] == texts[4]
    assert json.loads(red["u18"])[0]["text"] == "ask [NAME]\nfor a review"
    assert personal.personal_kinds(df.limit(0), people.limit(0)).count() == 0


def test_seeds_alone_are_not_enough(spark):
    """Every kind is accepted by its patterns: without rounds nothing is, and a seed whose patterns are bad is not, while what is no seed is found beside those that are."""
    texts = ["SSN 931-54-7491", "id on file 555-12-3456", "tel 12-34-567-8901", *(f"span 1{i}-34-567-890{i} done" for i in range(6)), "write to a.b@corp.example", "see x_1@corp.example"]
    df = spark.createDataFrame([line("s", f"u{i}", "user", t, None) for i, t in enumerate(texts)], LINE)
    people = spark.createDataFrame([("Runa Wesney", "Runa@corp.example"), ("Dario Grimund", "dario@corp.example"), ("None", None)], "person_name string, email string")
    assert personal.personal_kinds(df, people, rounds=0).count() == 0
    got = {(int(r.uuid[1:]), r.kind) for r in personal.personal_kinds(df, people).collect()}
    assert got == {(0, "id_number"), (1, "id_number"), (9, "email"), (10, "email")}


def test_a_short_list_serves_many_texts(spark):
    """Twelve known persons among hundreds: they are a small share of every context, but the same of all in which persons stand. Contexts of other things, with few or none of them, stay bad."""
    word = lambda i, k: "".join("bdfglmnrst"[int(x)] + "aeiou"[int(x) % 5] for x in f"{i:03d}") + k
    names = [f"{word(i, 'v').title()} {word(i, 'k').title()}" for i in range(600)]
    other = [f"{word(i, 'p').title()} {word(i, 'x').title()}" for i in range(600)]
    texts = [f"assigned to {n}" for n in names] + [f"blame says {n} last spring" for n in names] + [f"mail {n.split()[0].lower()}@h{i}.example" for i, n in enumerate(names)]
    texts += [f"see page {n} for details" for n in other] + [f"rebuild of {n}" for n in names[:3] + other]
    df = spark.createDataFrame([line("s", f"u{i}", "user", t, None) for i, t in enumerate(texts)], LINE)
    people = spark.createDataFrame([(n, f"{n.split()[0].lower()}@h{i}.example") for i, n in enumerate(names[:12])], "person_name string, email string")
    got = {(int(r.uuid[1:]), r.kind) for r in personal.personal_kinds(df, people).collect()}
    assert got == {(i, "name") for i in range(1200)} | {(i, "email") for i in range(1200, 1800)} | {(i, "name") for i in range(2400, 2403)}


def test_names_in_other_scripts(spark):
    names = ["Иван Петров", "Мария Соколова", "Νίκος Παππάς", "محمد علي", "王小明", "김민준", "Øyvind Ødegård", "Łukasz Żak"]
    texts = [f"assigned to {n}" for n in ("Runa Wesney", "Dario Grimund", "Tevin Quenquist", *names)] + [f"ping {n} about it" for n in names] + ["Пример Текста без имени", "测试 文本"]
    df = spark.createDataFrame([line("s", f"u{i}", "user", t, None) for i, t in enumerate(texts)], LINE)
    known = ("Runa Wesney", "Dario Grimund", "Tevin Quenquist", "Иван Петров", "Νίκος Παππάς", "محمد علي")
    people = spark.createDataFrame([(n,) for n in known], "person_name string")
    red = {r.uuid: r.text for r in personal.redacted(df, people).collect()}
    assert [red[f"u{i}"] for i in range(11)] == ["assigned to [NAME]"] * 11
    assert [red[f"u{i}"] for i in range(11, 19)] == ["ping [NAME] about it"] * 8
    assert red["u19"] == texts[19] and red["u20"] == texts[20]


# Text types


def test_text_types(spark):
    prose = "The importer kept the shared cursor because the review of the parser was late. We could not say why it was slow, but the team has seen it before.\n" * 1
    docs = {
        1: prose, 2: "\n".join(f"- item number {i}" for i in range(20)), 3: "a|b|c\n" + "\n".join(f"{i}|{i * 3}|OK" for i in range(30)), 4: "same old line of text that says nothing new\n" * 30,
        5: "=" * 200 + "\n" + "#" * 300, 6: None, 7: "", 8: "  \n ", 9: prose + "```\nx = f(1)\n```", 10: "x" * 5000,
    }
    docs |= {100 + i: prose.replace("late", f"late in week {i}") for i in range(40)}
    df = spark.createDataFrame([(k, v, "c") for k, v in docs.items()], "doc_id long, text string, chars string")
    got = {r.doc_id: r for r in quality.text_types(df).collect()}
    assert set(got) == set(docs) - {6, 7}
    assert all(got[i].prose_share > 0.5 for i in (1, 9, 100)) and all(got[i].prose_share < 0.5 for i in (2, 3, 4, 5, 8, 10))
    assert got[4].text_type == "junk" and got[8].prose_share == 0 and got[1].word_count == 29
    assert quality.text_types(df.limit(0)).count() == 0


def test_accuracies_are_learned_from_agreements():
    """Votes drawn with known accuracies: all start alike, and the learned ones come near the true ones; one round does not."""
    r = np.random.default_rng(5)
    kinds = r.choice(4, 40_000, p=[0.6, 0.15, 0.15, 0.1])
    patterns = np.zeros(len(kinds), np.int64)
    true, noisy = {}, ("symbols", "two_words", "packed", "beginning")
    for i, (f, values) in enumerate(quality.FUNCTIONS.items()):
        silent = [j for j, k in enumerate(values.values()) if not k] or [0]
        pick = np.full(len(kinds), silent[0])
        for j, k in enumerate(values.values()):
            if k:
                inside = np.isin(kinds, [quality.TYPES.index(t) for t in k.split()])
                pick = np.where(r.random(len(kinds)) < np.where(inside, 0.6, 0.3 if f in noisy else 0.005), j, pick)
        for j, k in enumerate(values.values()):
            if k:
                true[f, list(values)[j]] = np.isin(kinds[pick == j], [quality.TYPES.index(t) for t in k.split()]).mean()
        patterns += pick * quality._BASE[i]
    seen, at, n = np.unique(patterns, return_inverse=True, return_counts=True)
    error = {}
    for rounds in (1, 30):
        post, acc = quality.learn(seen, n.astype(float), rounds=rounds)
        error[rounds] = ((post[at].argmax(1) == 0) != (kinds == 0)).mean()
    off = {k: (round(acc[k], 2), round(float(true[k]), 2)) for k in acc if abs(acc[k] - true[k]) > 0.1}
    assert set(acc) == set(true) and not [k for k in off if quality.FUNCTIONS[k[0]][k[1]] in ("prose", "list table junk")], off
    assert error[30] < error[1] / 4


def test_accuracies_of_a_corpus(spark):
    df = spark.createDataFrame([(1, "We saw that the parser was late, and it could not say why.\n" * 2), (2, "- one\n- two")], "doc_id long, text string")
    got = {(r.function, r.value): r for r in quality.vote_accuracies(df).collect()}
    assert got["marker", "item"].chars == 10 and all(0 <= r.accuracy <= 1 for r in got.values())
    assert all(r.chars == 0 for r in quality.vote_accuracies(df.limit(0)).collect())

"""Edge cases of the trace operators; what SQL can say is checked against SQL in test_queries.py."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tracequarry.functions import classify as C
from tracequarry.functions import identity as I
from tracequarry.functions import text as T
from tracequarry.functions.literals import as_json
from tracequarry.functions.slim import slim
from tracequarry.functions.times import iso_week, parse_time
from tracequarry.operators import links, metrics, query, transcript, unify

T0 = datetime(2026, 1, 1, tzinfo=timezone.utc)


def one(spark, value, f, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in value], f"c {kind}").select(f(F.col("c"))).collect()]


def test_classifier_order(spark):
    rows = [("x", "tool", "claude-3-haiku", None, "tools"), ("a_tool", None, None, None, "tools"), ("x", "LLM", "Claude-Haiku-4", None, "haiku_holdover"), ("litellm_request", "LLM", "claude-opus-4", None, "main"), ("litellm_request", "llm", "gpt-4", None, "internal"), ("x", "LLM", None, None, "main"), ("raw_gen_ai_request", None, None, None, "internal"), ("x", None, None, "QUOTA", "quota"), (None, None, None, None, "unknown")]
    df = spark.createDataFrame(rows, "name string, span_kind string, llm_model_name string, status_code string, want string")
    assert all(r.category == r.want for r in metrics.with_category(df).collect())


def test_threads_and_compaction(spark):
    rows = [("Claude_Code_Tool_Task", None, None, "sub_agent"), ("Claude_Code_Tool_Read", "quota", None, "main_thread"), ("x", " quota ", None, "ancillary"), ("x", '[{"text":"Command: ls"}]', None, "ancillary"), ("x", "", "Let me check it", "ancillary"), ("x", "hi", "#", "ancillary"), (None, None, None, "unknown")]
    df = spark.createDataFrame(rows, "name string, input_value string, output_value string, want string")
    assert all(r.t == r.want for r in df.withColumn("t", C.thread_type()).collect())
    long = "# Summary summarized " + "x" * 5000
    kinds = one(spark, [C.COMPACTION_TASK, "a " + C.COMPACTION_CONTINUED, long, "summary", None, ""], lambda c: C.compaction(c, F.lit("router"))["kind"])
    assert kinds == ["compaction_task", "post_compaction", "compaction_structural", None, None, None]


def test_text_functions(spark):
    assert one(spark, ["  a \t\n b　", None, ""], T.collapse)[0].startswith("a b")
    assert one(spark, ["Please fix the retry logic", "ok", None, "x <system-reminder> xxxxxxxx", "The user stepped away now"], T.is_human_turn) == [True, False, False, False, False]
    assert one(spark, ["a.py", "A.TSX", "x", None], T.language_hint) == ["python", "typescript", "text", "text"]
    assert one(spark, ["ab", "abcdef"], lambda c: T.truncate(c, 5)) == ["ab", "ab..."]
    assert one(spark, ["a<system-reminder>x\ny</system-reminder>b"], T.strip_reminders) == ["ab"]
    assert one(spark, ['[{"type":"text","text":"a"},{"type":"x"},{"type":"text","text":"b"}]', "plain", "[oops", None], T.content_text) == ["a\nb", "plain", "[oops", None]


def test_times(spark):
    got = one(spark, ["2026-01-01T00:00:00Z", "2026-01-01 01:00:00.5+01:00", "1767225600000", "soon", "", None], parse_time)
    assert [x is not None for x in got] == [True, True, True, False, False, False]
    same = ["2026-01-01T02:00:00Z", "\t2026-01-01T02:00:00,000Z\n", "2026-01-01 04:00:00+02", "2026-01-01t04:00+0200", "2025-12-31T21:00:00-05:00", "1767232800000 ", "2026-01-01T02:00:00 Z"]
    assert len(set(one(spark, same, parse_time))) == 1
    assert [x and x.hour for x in one(spark, ["2026-01-01", "2026-01-01T04:00:00+02:00", "2026-01-01T25:00:00Z", "x2026-01-01", "2026-01-01T04:00 or so"], lambda c: parse_time(c, drop_zone=True))] == [0, 4, None, None, None]
    assert one(spark, [datetime(2024, 12, 30, tzinfo=timezone.utc), None], iso_week, "timestamp") == ["2025-W01", "unknown"]


def test_identity_layouts(spark):
    raw = ['{"attributes":{"metadata":{"user_api_key_end_user_id":"user_ab12_account_11111111-1111-1111-1111-111111111111_session_s1"}}}', '{"attributes.metadata":"{\\"device_id\\":\\"d\\",\\"session_id\\":\\"s2\\"}"}', '{"attributes":{"llm":{"None":{"metadata":{"user_id":"x","session_id":"s3"}}}}}', "nope", None, '{"attributes.metadata":"{\\"session_id\\":\\"\\"}"}']
    df = spark.createDataFrame([(r, "trace", None) for r in raw], "raw_attributes string, trace_id string, input_value string")
    got = I.with_identities(df).collect()
    assert [r.found_session for r in got] == ["s1", "s2", "s3", "trace", "trace", "trace"]
    assert [r.found_user for r in got][:3] == ["ab12", "d", None]


def test_literals(spark):
    assert one(spark, ["{'a': None, 'b': [True]}", '{"a": 1}', "{oops", None, "x"], as_json) == ['{"a": null, "b": [true]}', '{"a": 1}', None, None, None]


def test_slim(spark):
    got = one(spark, ['{"name":"x","a":{"b":"","c":{"d":null}},"e":[{"f":null}],"g":0}', '{"a":{}}', "[1]", "{oops", None], slim)
    assert got == ['{"e":[{"f":null}],"g":0}', None, "[1]", "{oops", None]


def test_search_errors_and_places(spark, make_spans):
    df = make_spans({"name": "n", "input_value": "aXbxc"}, {"input_value": None})
    with pytest.raises(query.PatternError):
        query.search(df, "(")
    with pytest.raises(query.PatternError):
        query.search(df, "x", fields=("nope",))
    got = query.matches(df, "x", fields=("input_value",), around=1).collect()
    assert [(r.start, r.end, r.match, r.context) for r in got] == [(1, 2, "X", "aXb..."), (3, 4, "x", "...bxc")]
    assert query.filter_spans(df, model="%").count() == 0


def test_failures_and_repeats(make_spans):
    a = {"session_id": "s", "name": "Claude_Code_Tool_Read", "input_value": "x", "status_code": "OK"}
    df = make_spans(a, a, {**a, "status_code": "ERROR"}, {**a, "name": "request timeout"}, {**a, "session_id": "t"})
    got = sorted((r.id, r.failure, r.context) for r in metrics.failures(df).collect())
    assert got == [(2, "back_to_back", "1"), (3, "back_to_back", "1,2"), (3, "error", "1,2"), (4, "timeout", "1,2,3")]


def test_unify_wins_and_nulls(spark):
    a = spark.createDataFrame([(1, "a", "old"), (2, None, "n1")], "id long, span_id string, v string")
    b = spark.createDataFrame([(1, "a", "new", 5), (3, None, "n2", 6)], "id long, span_id string, v string, extra int")
    assert sorted((r.span_id or "", r.v) for r in unify.unify(a, b).collect()) == [("", "n2"), ("a", "new")]
    assert unify.keep_last(a.unionByName(a), ["span_id"], keep_null_keys=True).count() == 3
    assert unify.keep_first(a.limit(0), ["span_id"]).count() == 0


def test_identity_map_contested(spark):
    people = spark.createDataFrame([("A1", "P One", "p@x"), ("b2", "P Two", None), ("b2", "P Three", None)], "account_id string, person_name string, email string")
    df = spark.createDataFrame([(" a1",), ("b2",), (None,), ("",), ("unknownlongid",)], "account_id string")
    assert [r.label for r in unify.with_identity(df, people).collect()] == ["p@x", "(unclaimed:b2)", "(unattributed)", "(unattributed)", "(unclaimed:unknownl)"]


def test_continuations_across_chunks(make_spans):
    at = lambda s: T0 + timedelta(seconds=s)
    day = 86_400
    df = make_spans(
        {"session_id": "a", "start_time": at(day - 40), "end_time": at(day - 20)}, {"session_id": "b", "start_time": at(day + 10), "end_time": at(day + 20), "input_value": C.COMPACTION_CONTINUED},
        {"session_id": "c", "start_time": at(day + 81), "end_time": at(day + 90), "input_value": C.COMPACTION_CONTINUED}, {"session_id": "d", "start_time": at(day + 95)},
    )
    assert [(r.session_id, r.previous_id, r.gap_s) for r in links.continuation_links(df).collect()] == [("b", "a", 30.0)]


def test_batches_and_growth(spark):
    df = spark.createDataFrame([("k", i, s) for i, s in enumerate([5, 5, 1, 20, 1])], "k string, o int, s long")
    got = [r.batch_no for r in links.batches(df, key="k", order="o", size="s", max_rows=2, max_size=10).orderBy("ord").collect()]
    assert got == [0, 0, 1, 2, 3]
    g = spark.createDataFrame([("k", i, n) for i, n in enumerate([1, 3, 2, 10, 4, 6, 5, None])], "k string, o int, n long")
    assert [r.n for r in links.growing(g, key="k", order="o", count="n").orderBy("ord").collect()] == [1, 3, 10, 4, 6]


def test_intervals(spark):
    df = spark.createDataFrame([("k", 1, 3), ("k", 3, 5), ("k", 2, 4), ("k", 7, 9), ("k", 8, 8), ("k", 9, 1), (None, 1, 2)], "k string, a int, b int")
    m = links.merge_intervals(df, key="k", start="a", end="b")
    assert sorted((r.k or "", r.a, r.b) for r in m.collect()) == [("", 1, 2), ("k", 1, 5), ("k", 7, 9)]
    assert [(r.gap_start, r.gap_end) for r in links.interval_gaps(m, key="k", start="a", end="b").collect()] == [(5, 7)]


def test_containment_of_copies(spark):
    docs = {1: "abc", 2: "abcd", 3: "abc", 4: "ax", 5: "yz"}
    df = spark.createDataFrame([(i, f"chunk number {c}") for i, t in docs.items() for c in t], "id long, chunk string")
    got = {(r.child, r.parent, r.overlap, r.relation) for r in links.containment(df).collect()}
    assert got == {(1, 2, 100.0, "complete"), (4, 1, 50.0, "keep_both"), (4, 2, 50.0, "keep_both")}


def test_members_of_containment_classes(spark):
    a, b, c = "the first long line", "the second long line", "one more long line"
    docs = {1: f"{a}\n{b}", 2: f"{a}\n{b}\n{c}", 3: f"{a}\n{b}", 4: f"{b.upper()}\n{a}\n{a}", 5: f"{b.upper()}\n{a}\n{a}", 6: "short", 7: "short", 8: None, 9: f"{a}\n{b}\nshort", 10: f"{c}\n{b}\n{a}"}
    texts = spark.createDataFrame(list(docs.items()), "id long, text string")
    chunks = texts.select("id", F.explode(F.split("text", "\n")).alias("chunk")).filter("length(chunk) > 10")
    got = {tuple(r) for r in links.containment_classes(texts, chunks).collect()}
    assert got == {
        (1, 1, 1, 2, "representative"), (3, 1, 1, 2, "copy"), (4, 1, 4, 2, "complete"), (5, 1, 4, 2, "copy"), (9, 1, 9, 2, "complete"),
        (2, 2, 2, 3, "representative"), (10, 2, 10, 3, "complete"), (6, None, 6, 0, None), (7, None, 6, 0, None), (8, None, None, 0, None),
    }
    assert {(r.child, r.parent) for r in links.containment(chunks).collect()} == {(1, 2)}


def test_transcript_events(spark):
    from tracequarry.sources.schemas import LINE

    def line(u, kind, content, at, sub=None):
        return (kind, sub, u, (content,), None, None, f"2026-01-01T00:00:{at:02d}Z" if at is not None else None, "s", None, None)

    call = '[{"type":"text","text":"look"},{"type":"tool_use","id":"t1","name":"Read","input":{}},{"type":"tool_use","id":"t2","name":"Task","input":{}},{"type":"tool_use","id":"t3","name":"Read"}]'
    result = '[{"type":"tool_result","tool_use_id":"t1","content":"one"},{"type":"tool_result","tool_use_id":"t2","content":[{"type":"text","text":"two"}]},{"type":"tool_result","tool_use_id":"t9","content":"lost"}]'
    df = spark.createDataFrame([line("a", "user", "please look at it", 1), line("b", "assistant", call, 2), line("c", "user", result, 3), line("d", "system", None, 4, "compact_boundary"), line("e", "user", "the summary", 5), line("e", "user", "the summary", 5), line("f", "assistant", "done", 6)], LINE)
    ls = transcript.lines(df)
    got = [(r.event_type, r.text, r.tool_name) for r in transcript.events(ls).orderBy("order_idx").collect()]
    assert got == [("user", "please look at it", None), ("assistant", "look", None), ("tool", "one", "Read"), ("subagent", "two", "Task"), ("compaction", "the summary", None), ("assistant", "done", None)]
    assert sorted((r.tool_id, r.result) for r in transcript.paired_tools(ls).collect()) == [("t1", "one"), ("t2", "two"), ("t3", None)]
    assert [r.tools for r in transcript.top_tools(ls).collect()] == ["Read=2,Task=1"]
    assert "### Tool: `Read`" in transcript.markdown(transcript.events(ls)).filter("order_idx = 2").first().block
    assert transcript.events(transcript.lines(df.limit(0))).count() == 0


def test_markdown_is_whole(spark):
    long = "x" * 2500 + " end"
    kinds = [("user", None), ("assistant", None), ("compaction", None), ("tool", "Read"), ("subagent", "Task")]
    rows = [("s", i, k, long, t) for i, (k, t) in enumerate(kinds)] + [("s", 5, "tool", "short", "Read"), ("s", 6, "tool", "y" * 2000, "Read"), ("s", 7, "tool", None, None), ("s", 8, "tool", long, None)]
    got = transcript.markdown(spark.createDataFrame(rows, "session_id string, order_idx int, event_type string, text string, tool_name string")).orderBy("order_idx").collect()
    assert [long in r.block for r in got[:5]] == [True, True, True, False, False]
    assert [r.full_result for r in got] == [None, None, None, long, long, None, None, None, long]
    assert "short" in got[5].block and "y" * 2000 in got[6].block

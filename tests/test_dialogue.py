"""Chains, turns, events and documents on small fixtures, against rules spelled out in Python."""

import json
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tracequarry.functions import classify as C
from tracequarry.functions import text as T
from tracequarry.operators import dialogue, render, reports, transcript
from tracequarry.sources.schemas import LINE

T0 = datetime(2026, 1, 1, tzinfo=timezone.utc)
U1 = "11111111-1111-1111-1111-111111111111"


def at(s):
    return T0 + timedelta(seconds=s)


def named(uuid, **more):
    return json.dumps({"attributes": {"metadata": {"user_api_key_end_user_id": f"user_ab12_account_{U1}_session_{uuid}"}, **more}})


def chain_spans(make_spans):
    prompt = "Claude_Code_Internal_Prompt_"
    call = json.dumps([{"type": "text", "text": "I will read the file now"}, {"type": "tool_use", "id": "t1", "name": "Read", "input": {"file_path": "/a/b.py"}}, {"type": "tool_use", "id": "k1", "name": "Task", "input": {"subagent_type": "Explore"}}])
    result = json.dumps([{"type": "tool_result", "tool_use_id": "t1", "content": "x"}])
    tool = lambda **v: json.dumps({"attributes": {"input": {"value": json.dumps({"type": "tool_use", **v})}, "output": {"value": "y" * 2500}}})
    history = json.dumps([{"role": "user", "content": "Please look at the parser file"}, {"role": "assistant", "content": "I will read the file now"}, {"role": "user", "content": "And now the second question"}])
    return make_spans(
        {"session_id": "s1", "name": prompt + "2", "start_time": at(50), "end_time": at(55), "input_value": "And now the second question", "output_value": "The second answer is this"},
        {"session_id": "s1", "name": prompt + "1", "start_time": at(10), "end_time": at(15), "input_value": "Please look at the parser file", "output_value": call, "raw_attributes": named(U1), "llm_model_name": "claude-sonnet-4", "llm_token_count_prompt": 7, "trace_id": "t"},
        {"session_id": "s1", "name": "Claude_Code_Tool_Read", "start_time": at(16), "raw_attributes": tool(id="t1", input={"file_path": "/a/b.py", "n": 3}), "trace_id": "t"},
        {"session_id": "s1", "name": "Claude_Code_Tool_Read", "start_time": at(17), "raw_attributes": tool(id="t1", input={}), "trace_id": "t"},
        {"session_id": "s1", "name": "Claude_Code_Tool_Task", "start_time": at(18), "raw_attributes": tool(id="k1", input={"subagent_type": "Explore", "description": "look", "prompt": "find it"}).replace("y" * 2500, "[{'type': 'text', 'text': 'found it'}]"), "trace_id": "t"},
        {"session_id": "s1", "name": "raw_gen_ai_request", "start_time": at(51), "raw_attributes": json.dumps({"attributes": {"llm": {"None": {"messages": history}}}}), "trace_id": "t"},
        {"session_id": "s1", "name": prompt + "3", "start_time": at(60), "input_value": result, "output_value": "done with it", "trace_id": "t"},
        {"session_id": "s2", "name": prompt + "1", "start_time": at(100), "end_time": at(101), "input_value": C.COMPACTION_CONTINUED + " ... " + dialogue.SUMMARY + " we did things", "output_value": "-", "raw_attributes": named(U1)},
        {"session_id": "s2", "name": "Claude_Code_Tool_Bash", "start_time": at(103), "raw_attributes": tool(id="b1", input={"command": "ls"}), "trace_id": "elsewhere"},
        {"session_id": "a", "start_time": at(1000), "end_time": at(1010)}, {"session_id": "b", "start_time": at(1030), "end_time": at(1040), "input_value": C.COMPACTION_CONTINUED}, {"session_id": "c", "start_time": at(1050), "end_time": at(1060), "input_value": C.COMPACTION_CONTINUED},
        {"session_id": "lone", "start_time": at(5000), "end_time": at(5001)}, {"session_id": "late", "start_time": at(9000), "input_value": C.COMPACTION_CONTINUED}, {"session_id": None, "name": prompt + "1"},
    )


def test_chains(spark, make_spans):
    df = chain_spans(make_spans)
    got = {r.chain_id: (r.session_ids, r.claude_session_id, r.user_hash, r.sessions, r.spans, r.compactions) for r in dialogue.chains(df).collect()}
    assert got == {"s1": ("s1,s2", U1, "ab12", 2, 9, 0), "a": ("a,b,c", None, None, 3, 3, 2)}
    s = dialogue.chain_summary(dialogue.chains(df)).first()
    assert (s.chains, s.sessions, s.avg_length, s.max_length) == (2, 5, 2.5, 3)
    assert [r.chain_id for r in dialogue.longest_first(dialogue.chains(df), 2).collect()] == ["a", "s1"]
    empty = dialogue.chains(df.limit(0))
    assert empty.count() == 0 and dialogue.chain_summary(empty).first().chains == 0


def test_turns_and_links(spark, make_spans):
    df = chain_spans(make_spans)
    m = dialogue.chain_members(df)
    every = dialogue.turns(df, m, ancillary=True).orderBy("turn_index").collect()
    # prompt spans are of the main thread by their name, so a side request's turn is shown with another name's rule: none here is ancillary
    assert [(r.turn_suffix, r.thread_type, r.subagents, r.linked_turn_index) for r in every] == [("1", "main_thread", "k1:Explore", None), ("2", "main_thread", "", None), ("3", "main_thread", "", None)]
    x = dialogue.turn_metrics(dialogue.turns(df, m, ancillary=True)).first()
    assert (x.turns, x.models, x.prompt_tokens) == (3, "claude-sonnet-4=1", 7)
    assert dialogue.turns(df.limit(0), m.limit(0)).count() == 0


def test_results_are_linked_to_the_turn_that_called(spark, make_spans, monkeypatch):
    """With a rule that takes results for side requests: each is linked to the last turn up to it that made the call."""
    kind = F.when(F.col("input_value").contains("tool_result"), "ancillary").otherwise("main_thread")
    monkeypatch.setattr(dialogue.C, "thread", lambda: F.struct(kind.alias("type"), F.lit("x").alias("reason"), F.lit(1.0).alias("confidence")))
    use = lambda *ids: json.dumps([{"type": "tool_use", "id": i, "name": "Read"} for i in ids])
    res = lambda i: json.dumps([{"type": "text", "text": "t"}, {"type": "tool_result", "tool_use_id": i, "content": "c"}])
    turns = [("1", "ask", use("a", "b")), ("2", res("a"), "x"), ("3", "again", use("a")), ("10", res("a"), use("z")), ("4", res("z"), "x"), ("5", res("never"), "x")]
    df = make_spans(*({"session_id": "s", "name": "Claude_Code_Internal_Prompt_" + n, "start_time": at(i), "input_value": a, "output_value": b, "raw_attributes": named(U1)} for i, (n, a, b) in enumerate(turns)))
    m = dialogue.chain_members(df)
    got = {r.turn_suffix: (r.turn_index, r.tool_use_id, r.linked_turn_index) for r in dialogue.turns(df, m, ancillary=True).collect()}
    # numbers order the turns, so 10 is the last; z is called only after turn 4
    assert got == {"1": (0, None, None), "2": (1, "a", 0), "3": (2, None, None), "4": (3, "z", None), "5": (4, "never", None), "10": (5, "a", 2)}
    assert {r.turn_suffix: r.turn_index for r in dialogue.turns(df, m).collect()} == {"1": 0, "3": 1}


def test_events_of_a_chain(spark, make_spans):
    df = chain_spans(make_spans)
    m = dialogue.chain_members(df)
    said = [(r.order_idx, r.role, r.text) for r in dialogue.message_order(df, m).orderBy("order_idx").collect()]
    assert said == [(0, "user", "Please look at the parser file"), (1, "assistant", "I will read the file now"), (2, "user", "And now the second question")]
    ev = dialogue.chain_events(df, m).filter("chain_id = 's1'").orderBy("event_no").collect()
    got = [(r.event_type, r.order_idx, r.tool_use_id, (r.text or "")[:20]) for r in ev]
    # Task spans say which traces are the main thread's: the span of another trace gives no tool event; each call counts once
    near = lambda x: pytest.approx(x)
    assert got == [
        ("user", near(0.0), None, "Please look at the p"), ("assistant", near(1.0), None, "I will read the file"), ("tool", near(1.5), "t1", "y" * 20), ("subagent", near(1.5), "k1", "found it"), ("user", near(2.0), None, "And now the second q"),
        ("assistant", near(2.1), None, "The second answer is"), ("assistant", near(2.1), None, "done with it"), ("compaction", near(2.1), None, "The conversation is "),
    ]
    assert dialogue.chain_events(df.limit(0), m.limit(0)).count() == 0


def test_documents(spark, make_spans, tmp_path):
    df = chain_spans(make_spans)
    m = dialogue.chain_members(df)
    ev = dialogue.chain_events(df, m)
    blocks = render.markdown(ev, render.heads_of(dialogue.chains(df), df, m))
    rows = blocks.filter("chain_id = 's1'").orderBy("block_no").collect()
    text = "\n".join(r.markdown for r in rows)
    assert text.startswith("# Session: 11111111\n\n## Metadata") and "- **Models**: claude-sonnet-4 (LiteLLM only)" in text
    assert "### Tool: Read\n\n**Input**:\n```text\nfile_path: /a/b.py\nn: 3\n```" in text and "**Result** (2,500 chars):\n```python\n" + "y" * 497 + "...\n```" in text and "→ Full result: [tool_result_1.txt](./tool_result_1.txt)" in text
    assert "### Subagent: Explore\n\n**Task**: look\n**Prompt**:\n> find it\n" in text and "[subagent_explore_1.md](./subagent_explore_1.md)" in text
    assert "> **Context Summary**:\n> The conversation is summarized below: we did things" in text
    assert "*2 user turns, 3 assistant turns, 1 tool calls, 1 subagents, 1 compactions*" in text
    files = {r.file: r.file_text for r in rows if r.file}
    assert files["tool_result_1.txt"] == "y" * 2500 and "**Prompt:**\n\nfind it\n" in files["subagent_explore_1.md"] and "## Response\n\nfound it" in files["subagent_explore_1.md"]
    check = {(r.event_type): (r.expected, r.found) for r in reports.export_check(ev, blocks).filter("chain_id = 's1'").collect()}
    assert all(a == b for a, b in check.values()) and check["assistant"] == (3, 3)
    render.write_documents(blocks, str(tmp_path / "out"))
    written = [p.read_text() for p in sorted((tmp_path / "out" / "documents" / "chain_id=s1").glob("*.txt"))]
    assert len(written) == 1 and written[0].rstrip("\n") == text.rstrip("\n")


def test_questions_and_skills(spark):
    asked = json.dumps({"questions": [{"header": "Colour", "question": "Which one?", "options": [{"label": "Red", "description": "warm"}, {"label": "Blue"}]}, {"question": "Why?"}]})
    rows = [("AskUserQuestion", asked, 'User has answered your questions: "Which one?"="Red"', None), ("Skill", '{"skill":"draft","args":"x"}', "", None), ("Bash", None, "out", None)]
    got = [r[0] for r in spark.createDataFrame(rows, "tool string, input string, result string, file string").select(render.tool_section(*(F.col(c) for c in ("tool", "input", "result", "file")))).collect()]
    assert "### Tool: AskUserQuestion (2 questions)" in got[0] and "**Colour**: Which one?\n  → **Red**: warm\n  - Blue\n  **Answer**: Red" in got[0] and "**Question 2**: Why?" in got[0]
    assert got[1].startswith("### Skill: draft\n\n**Input**:\n```text\nargs: x\n```") and "**Result**: (empty)" in got[1]
    assert "**Result** (3 chars):\n```bash\nout\n```" in got[2] and "**Input**" not in got[2]


def test_live_events(spark, make_spans):
    def request(s, ins, outs, model="claude-sonnet-4", **more):
        return {"session_id": "s", "start_time": at(s), "llm_model_name": model, "raw_attributes": json.dumps({"attributes": {"llm": {"input_messages": [{"message": x} for x in ins], "output_messages": [{"message": x} for x in outs]}}}), **more}

    user = lambda c: {"role": "user", "content": c}
    bot = lambda c: {"role": "assistant", "content": c}
    df = make_spans(
        request(2, [user([{"type": "tool_result", "tool_use_id": "t1", "content": [{"type": "text", "text": "the result"}]}, {"type": "tool_result", "tool_use_id": "zz", "content": "alone", "is_error": True}])], [bot("Thanks, that is all")]),
        request(1, [user("Please look at the parser file"), {"role": "system", "content": "no"}], [bot([{"type": "text", "text": "Reading it"}, {"type": "tool_use", "id": "t1", "name": "Read", "input": {"a": 1}}])]),
        request(3, [user("quota")], [bot("x")], model="claude-3-haiku"),
        request(4, [user([{"type": "text", "text": C.COMPACTION_CONTINUED + " and so on"}, {"type": "text", "text": "old"}])], [], model="claude-3-haiku"), request(5, [user([{"type": "text", "text": C.COMPACTION_CONTINUED + " and so on"}])], [bot("ok")]),
        {"session_id": "t", "raw_attributes": "{oops"},
    )
    got = [(r.event_type, r.text, r.tool) for r in dialogue.live_events(df).orderBy("event_no").collect()]
    assert got == [
        ("user", "Please look at the parser file", None), ("assistant", "Reading it", None), ("tool", "the result", "Read"), ("tool", "alone", "tool_result (error)"), ("assistant", "Thanks, that is all", None),
        ("compaction", C.COMPACTION_CONTINUED + " and so on", None), ("assistant", "ok", None),
    ]


def test_predicates(spark, make_spans):
    long = "a" * 60
    df = make_spans(
        {"name": "Claude_Code_Internal_Prompt_1", "output_value": long, "input_value": "What about the cache?"}, {"name": "Claude_Code_Tool_Read", "output_value": long}, {"name": "litellm_request", "input_value": "x <policy_spec>", "output_value": long},
        {"name": "litellm_request", "output_value": ' {"isNewTopic": true}'}, {"name": "litellm_request", "output_value": "short", "llm_model_name": "claude-3-haiku"}, {"name": "litellm_request", "output_value": "[short", "llm_model_name": "claude-3-haiku"},
        {"name": "raw_gen_ai_request", "output_value": " # "}, {"name": None}, {"name": "litellm_request", "raw_attributes": json.dumps({"attributes": {"llm": {"None": {"system": "You are a file search specialist"}}, "input": {"value": '[{"type":"tool_result","text":"long enough text"}]'}}})},
        {"name": "x", "input_value": '[{"type":"text","text":"long enough text"}]'}, {"name": "x", "input_value": "[not json but long]"}, {"name": "x", "input_value": C.COMPACTION_CONTINUED}, {"name": "x", "input_value": "         short    "},
    )
    got = df.select("id", C.is_main_thread().alias("m"), C.is_subagent_request().alias("s"), C.is_meaningful_input(C.input_text()).alias("u")).orderBy("id").collect()
    assert [r.m for r in got] == [True, False, False, False, False, True, False, False, True, False, False, False, False]
    assert [r.id for r in got if r.s] == [9] and [r.id for r in got if r.u] == [1, 3, 10, 11]
    side = df.limit(1).select(*(C.side_input(F.lit(x)).alias(f"c{i}") for i, x in enumerate(("[{'type': 'text', 'text': 'Command: ls'}]", '[{"text":"quota"}]', "please"))), C.side_output(F.lit(" # ")).alias("o")).first()
    assert tuple(side) == ("Command:", "quota", None, "#")


def test_tool_targets(spark):
    path = "/very/long" * 9 + "/end.py"
    rows = [("Read", json.dumps({"file_path": path}), "..." + path[-57:]), ("Bash", json.dumps({"command": "x" * 60}), "x" * 47 + "..."), ("Grep", '{"pattern":"a.b"}', "`a.b` in `.`"), ("Task", '{"subagent_type":"Plan","description":"d"}', "Plan: d"), ("Skill", '{"skill":"s","args":"q"}', "s q"), ("Skill", "{}", "unknown"),
            ("AskUserQuestion", '{"questions":[{"header":"H"},{"question":"q"}]}', "H (+1)"), ("AskUserQuestion", "{}", "question"), ("Other", '{"b":"two","a":"one"}', "one"), ("Other", "nope", ""), ("Other", None, ""), (None, '{"a":"x"}', "x")]
    got = spark.createDataFrame(rows, "n string, i string, want string").select("want", T.tool_target(F.col("n"), F.col("i")).alias("got")).collect()
    assert [(r.want, r.got) for r in got] == [(w, w) for *_, w in rows]


def test_pairing_in_turn_equals_a_queue(spark):
    r = random.Random(7)
    lines, want, n = [], [], 0
    for s in range(12):
        open_, k = [], 0
        for i in range(40):
            uuid, stamp = f"{s:02d}-{i:03d}", f"2026-01-01T00:00:{i:02d}Z"
            if r.random() < 0.5:
                n += 1
                name = r.choice(["Read", "Bash", "Task"])
                lines.append(("assistant", None, uuid, (json.dumps([{"type": "tool_use", "id": f"c{n}", "name": name}]),), None, None, stamp, f"s{s}", None, None))
                if name != "Task":
                    k += 1
                    open_.append((k, name))
            else:
                lines.append(("user", None, uuid, (json.dumps([{"type": "tool_result", "tool_use_id": "?", "content": f"r{i}"}]),), None, None, stamp, f"s{s}", None, None))
                if open_:
                    k0, name = open_.pop(0)
                    want.append((f"s{s}", k0, name, f"r{i}"))
    got = transcript.paired_in_turn(transcript.lines(spark.createDataFrame(lines, LINE)))
    assert sorted((x.session_id, x.n, x.name, x.result) for x in got.collect()) == sorted(want)


def test_batches_and_checks(spark, make_spans):
    df = make_spans({"session_id": "s", "name": "x", "span_kind": "LLM", "input_value": "a" * 40, "status_code": "ERROR", "raw_attributes": '{"display":"summarized","cache_read_input_tokens":0}'}, {"session_id": "s", "name": "Claude_Code_Tool_Read", "span_kind": "TOOL"})
    b = reports.session_batches(df).first()
    assert (b.span_count, b.token_estimate, b.categories, b.models, b.has_errors) == (2, 110, "main=1,tools=1", "", True)
    assert json.loads(reports.span_records(df).orderBy("id").first().record)["category"] == "main" and "model" not in json.loads(reports.span_records(df).orderBy("id").first().record)
    assert {r.check: r.passed for r in reports.content_checks(df).collect()} == {"llm_input_content_populated": True, "llm_output_content_populated": False, "llm_token_counts_populated": False, "thinking_content_captured": False, "cache_reads_recorded": False}
    assert reports.content_checks(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        reports.time_range(df)
    assert reports.time_range(make_spans({"start_time": at(1)}, {"start_time": at(0)}))[0].second == 0
    assert "Tools used: Read" in reports.session_texts(df).first().text


def test_coverage(spark, make_spans):
    t = lambda s, *xs: [{"session_id": s, "input_value": f"the text number {x}"} for x in xs]
    df = make_spans(*t("big", *range(10)), *t("sub", 1, 2), *t("copy", *range(10)), *t("part", 1, 2, 99), *t("own", 77), {"session_id": "empty"}, {"session_id": None, "input_value": "the text number 1"})
    r = reports.coverage(df).first()
    # copies: one of big and copy is the class's representative; the other lies in it
    assert (r.sessions, r.complete, r.subsets, r.partial, r.unique, r.spans) == (6, 3, 2, 1, 2, 27)
    assert {x.session_id: x.kept_in for x in reports.deletable(df).collect()} == {"copy": "big", "sub": "big"}

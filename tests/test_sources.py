import json
import sqlite3
import threading
from datetime import datetime, timedelta, timezone
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from tracequarry.operators import query
from tracequarry.sources import readers, schemas, sinks
from tracequarry.streaming import live

T = [datetime(2026, 1, d, tzinfo=timezone.utc) for d in range(1, 20)]


def test_partitioned_round_trip(spark, make_spans, tmp_path):
    root = str(tmp_path)
    first = make_spans({"span_id": "a", "session_id": "s", "start_time": T[0], "status_code": "ERROR"}, {"span_id": "b", "session_id": "s", "start_time": T[9]}, {"span_id": "b", "session_id": "s", "start_time": T[9], "name": "last"}, {"span_id": None})
    assert sinks.write_spans(first, root, "one") == 3
    assert sinks.write_spans(make_spans({"span_id": "b"}, {"span_id": "c"}), root, "one") == 1
    got = readers.read_source(spark, root, "one")
    assert got.count() == 4 and got.filter("span_id = 'b'").first().name == "last" and set(got.columns) == {x.split()[0] for x in schemas.SPANS.split(", ")}
    assert list(readers.find_sources(spark, root)) == ["one"]
    sinks.write_sessions(got, root, "one")
    assert spark.read.parquet(f"{root}/sessions/source=one").first().has_errors
    with pytest.raises(FileNotFoundError):
        readers.read_source(spark, root, "two")


def test_json_lines(spark, make_spans, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"span_id":"a","start_time":"2026-01-01T00:00:00Z","llm_token_count_prompt":"12.7","new":1}\n{broken\n{"span_id":"b","llm_token_count_prompt":"x"}\n')
    rows = {r.span_id: r for r in readers.read_span_lines(spark, str(p)).collect()}
    assert rows["a"].llm_token_count_prompt == 12 and rows["a"].start_time is not None and rows["b"].llm_token_count_prompt is None
    sinks.write_nested_sessions(make_spans({"session_id": "s", "span_id": "1"}, {"session_id": "s", "span_id": "2"}), str(tmp_path / "src.jsonl"))
    assert {(r.session_id, r.span_id) for r in readers.read_source(spark, str(tmp_path), "src").collect()} == {("s", "1"), ("s", "2")}


def test_transcripts(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "t.jsonl").write_text('{"type":"user","uuid":"u","sessionId":"s","message":{"content":[{"type":"text","text":"x"}]}}\nbad\n')
    got = readers.read_transcripts(spark, str(tmp_path / "p")).collect()
    assert len(got) == 1 and got[0].message.content.startswith("[{") and got[0].file.endswith("t.jsonl")
    assert readers.list_transcripts(spark, str(tmp_path)).count() == 1


def test_normalizers(spark):
    df = spark.createDataFrame([("s1", "in", "7")], "`context.span_id` string, `attributes.input.value` string, `attributes.llm.token_count.prompt` string")
    r = readers.normalize_dotted(df, "phoenix").first()
    assert (r.span_id, r.input_value, r.llm_token_count_prompt, r.backend) == ("s1", "in", 7, "phoenix")
    packed = spark.createDataFrame([("s2", '{"input":{"value":"v"}}')], "span_id string, attributes string")
    assert readers.normalize_dotted(packed, "b").first().input_value == "v"
    ann = spark.createDataFrame([("s", ("good", 0.5))], "span_id string, result struct<label:string,score:double>")
    a = readers.normalize_annotations(ann.withColumn("result", F.struct("result.*", F.lit(None).cast("string").alias("explanation"))), "b").first()
    assert (a.label, a.score) == ("good", 0.5)


def test_sqlite_and_http(spark, tmp_path):
    readers.register(spark)
    db = str(tmp_path / "x.db")
    with sqlite3.connect(db) as c:
        c.execute("CREATE TABLE spans (id INTEGER PRIMARY KEY, name TEXT)")
        c.executemany("INSERT INTO spans VALUES (?, ?)", [(i, f"n{i}") for i in range(1, 101)])
    df = spark.read.format("tq_sqlite").options(path=db, query="SELECT id, name FROM spans", key="id", partitions="4").load()
    assert df.count() == 100 and df.select("name").distinct().count() == 100

    class Answer(BaseHTTPRequestHandler):
        def do_GET(self):
            a, b = (int(x.split("=")[1]) for x in self.path.split("?")[1].split("&"))
            self.send_response(200)
            self.end_headers()
            self.wfile.write("".join(json.dumps({"t": t}) + "\n" for t in range(a, b)).encode())

        def log_message(self, *a):
            pass

    s = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    got = spark.read.format("tq_http").options(url=f"http://127.0.0.1:{s.server_port}/x", start="0", end="50", slices="3").load()
    assert got.count() == 50
    s.shutdown()


def test_exports(spark):
    df = spark.createDataFrame([("s", "a|b" * 30, [1])], "session_id string, b string, a array<int>")
    assert sinks.to_csv(df).splitlines()[0] == "session_id,a,b" and sinks.to_csv(df.limit(0)) == ""
    assert "..." in sinks.to_markdown(df) and sinks.to_markdown(df.limit(0)) == "No results found."
    assert json.loads(sinks.to_json(df))[0]["a"] == [1]
    with pytest.raises(ValueError):
        sinks.export(df, "xml")


def test_stream_sessions_equal_batch(spark, make_spans, tmp_path):
    at = lambda m: datetime.fromtimestamp(T[0].timestamp() + 60 * m, timezone.utc)
    df = make_spans(*({"user_id": "u", "trace_id": "t", "span_id": str(i), "start_time": at(m)} for i, m in enumerate([0, 5, 100, 5000])), {"user_id": "u", "trace_id": "t", "span_id": "0", "start_time": at(0)})
    df.drop("id").write.parquet(str(tmp_path / "in"))
    got = live.closed_sessions(spark, str(tmp_path / "in"), str(tmp_path / "out"), late="1 hour")
    assert sorted(r.spans for r in got.collect()) == [1, 2]
    batch = live.session_windows(df.dropDuplicates(["span_id"]))
    assert sorted(r.spans for r in batch.collect()) == [1, 1, 2]


def test_stored_sessions_do_not_depend_on_batches(spark, make_spans, tmp_path):
    at = lambda h: datetime.fromtimestamp(T[0].timestamp() + 3600 * h, timezone.utc)
    hours = [[240, 0], [100.2, 5.2], [0.3, 200], [5, 100], [50, 150], [240, 0.1]]  # each a file; far from the order of time
    spans = [[{"user_id": "u", "trace_id": "t", "span_id": f"{h}", "start_time": at(h)} for h in f] for f in hours]
    for f in spans:
        make_spans(*f).drop("id").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    batch = live.session_windows(make_spans(*sum(spans, [])).dropDuplicates(["span_id"]))
    end = at(240).timestamp() - 86_400 - 1800
    want = sorted((r.start_time, r.end_time, r.spans) for r in batch.collect() if r.end_time.timestamp() <= end)
    assert [n for _, _, n in want] == [3, 2, 1, 2, 1, 1]
    for n in (1, 2, 64):
        got = live.stored_sessions(spark, str(tmp_path / "in"), str(tmp_path / f"out{n}"), files_per_batch=n)
        assert sorted((r.start_time, r.end_time, r.spans) for r in got.collect()) == want
    with pytest.warns(UserWarning, match="late"):
        live.closed_sessions(spark, str(tmp_path / "in"), str(tmp_path / "live"), files_per_batch=1)


def test_spans_are_known_by_trace_and_span(spark, make_spans, tmp_path):
    root = str(tmp_path)
    rows = [{"trace_id": "t1", "span_id": "a"}, {"trace_id": "t2", "span_id": "a"}, {"trace_id": None, "span_id": "a"}, {"span_id": None, "name": "x"}, {"span_id": None, "name": "y"}, {"span_id": None, "name": "y"}, {"trace_id": "t1", "span_id": "a", "name": "last"}]
    assert sinks.write_spans(make_spans(*rows), root, "one") == 5
    assert sinks.write_spans(make_spans(*rows), root, "one") == 0
    back = readers.read_source(spark, root, "one")
    assert {(r.trace_id, r.span_id, r.name) for r in back.collect()} == {("t1", "a", "last"), ("t2", "a", None), (None, "a", None), (None, None, "x"), (None, None, "y")}
    assert sinks.write_spans(make_spans(*rows).limit(0), root, "one") == 0


def test_nothing_is_cut_unless_asked(spark, tmp_path):
    df = spark.range(2500).selectExpr("id AS session_id", "array(id) AS a")
    assert len(json.loads(sinks.to_json(df))) == 2500 and len(sinks.to_csv(df).splitlines()) == 2501 and sinks.to_markdown(df).endswith("2500 rows")
    assert sinks.to_markdown(df, limit=5).endswith("5 rows, the first 5: there are more") and sinks.to_csv(df, limit=2).splitlines()[-1] == "# 2 rows, the first 2: there are more"
    assert json.loads(sinks.to_json(df, limit=2))[-1] == {"cut": "2 rows, the first 2: there are more"} and len(json.loads(sinks.to_json(df, limit=2500))) == 2500
    for form in ("json", "csv", "markdown"):
        sinks.write(df, form, str(tmp_path / form))
    assert spark.read.json(str(tmp_path / "json")).count() == spark.read.option("header", "true").csv(str(tmp_path / "csv")).count() == spark.read.text(str(tmp_path / "markdown")).count() == 2500
    with pytest.raises(ValueError):
        sinks.write(df, "xml", str(tmp_path / "x"))


def test_numbered_lines_and_search(spark, tmp_path):
    for n, name in ((3000, "a"), (7, "b")):
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps({"name": f"{name}{i} ENG-{i}"}) + "\n" if i % 5 else "broken\n" for i in range(1, n + 1)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        lines = readers.numbered_lines(spark, str(tmp_path / "*.jsonl")).collect()
        got = {(r.file[-7:], r.line_no, r.value) for r in readers.search_lines(spark, str(tmp_path), r"ENG-\d+", fields=("name", "nope")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(lines) == 3007 and all(r.value == "broken" if r.line_no % 5 == 0 else f"ENG-{r.line_no}\"" in r.value for r in lines)
    assert got == {(f"{f}.jsonl", i, f"ENG-{i}") for f, n in (("a", 3000), ("b", 7)) for i in range(1, n + 1) if i % 5}


def test_schemas_ranges_and_event_files(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x")], "id long, a string"), spark.createDataFrame([(2, 5)], "id long, b long")
    u = readers.union_schemas({"one": a, "two": b})
    assert {(r.id, r.a, r.b, r.schema) for r in u.collect()} == {(1, "x", None, "one"), (2, None, 5, "two")}
    with pytest.raises(ValueError):
        readers.union_schemas({})
    path = str(tmp_path / "ranges")
    assert len(readers.export_by_ranges(spark.range(25), path, rows_per_range=10)) == 3
    assert readers.export_by_ranges(spark.range(25), path, rows_per_range=10) == [] and spark.read.parquet(path).count() == 25
    assert readers.export_by_ranges(spark.range(0), path) == []
    for name in ("ann", "bob"):
        sinks.write_events(spark.createDataFrame([("s", name, "user")], "session_id string, event_id string, event_type string"), str(tmp_path / f"{name}_events.parquet"))
    assert {(r.event_id, r.source) for r in readers.read_events(spark, str(tmp_path / "*_events.parquet")).collect()} == {("ann", "ann"), ("bob", "bob")}
    assert sinks.write_events(spark.createDataFrame([("s", "e", "user"), ("s", "f", "tool")], "session_id string, event_id string, event_type string"), str(tmp_path / "n")) == {"user": 1, "tool": 1}


def test_annotations_of_a_backend(spark):
    projects = spark.createDataFrame([(1, "p"), (2, "q")], "id long, name string")
    traces = spark.createDataFrame([(10, "t1", 1), (11, "t2", 2)], "id long, trace_id string, project_rowid long")
    spans = spark.createDataFrame([(100, "a", 10, "2026-01-01"), (101, "b", 11, "2026-01-01"), (102, "c", 10, "2026-02-01")], "id long, span_id string, trace_rowid long, start_time string")
    notes = spark.createDataFrame([(1, 100, "good", ("yes", 0.5, "why"), "2026-01-03"), (2, 101, "good", None, None), (3, 102, "bad", ("no", None, None), "2026-01-04"), (4, 100, None, None, "2026-01-05")], "id long, span_rowid long, name string, result struct<label:string,score:double,explanation:string>, created_at string")
    got = readers.backend_annotations(notes, spans, traces, projects, "p")
    assert {(r.span_id, r.name, r.label, r.score) for r in got.collect()} == {("a", "good", "yes", 0.5), ("c", "bad", "no", None), ("a", None, None, None)}
    assert readers.backend_annotations(notes, spans, traces, projects, "p", end="2026-01-15").count() == 2
    assert [r.annotation_id for r in readers.span_annotations(got, spark.createDataFrame([("a",), ("a",)], "span_id string")).collect()] == ["4", "1"]
    names = lambda **kw: sorted(r.annotation_id for r in readers.named_annotations(got, **kw).collect())
    assert names(include=["good"]) == ["1"] and names(exclude=["good"]) == ["3", "4"] and names() == ["1", "3", "4"]


def test_one_session_and_catalog(spark, make_spans, tmp_path):
    df = make_spans({"raw_attributes": "session_abc", "start_time": None}, {"raw_attributes": "other"}, {"raw_attributes": None})
    assert [r.id for r in query.one_session(df, "abc").collect()] == [1] and query.one_session(df, "abc", since="2026-01-01").count() == 0
    for bad in ("None", " NULL", "", None, "Unknown", "id"):
        with pytest.raises(ValueError):
            query.one_session(df, bad)
    cat = spark.createDataFrame([("s", "old", "l", 1), ("t", "keep", None, 2)], "session_id string, category string, label string, n int")
    up = spark.createDataFrame([("s", "a", "x", 1), ("s", "b" * 90, "y" * 400, 2), ("zz", "c", "d", 3)], "session_id string, category string, label string, at int")
    assert {tuple(r) for r in sinks.update_categories(cat, up).collect()} == {("s", "b" * 80, "y" * 300, 1), ("t", "keep", None, 2)}
    sinks.append_raw(make_spans({"trace_id": "t", "span_id": "a", "name": "1"}), str(tmp_path / "raw"), "x")
    sinks.append_raw(make_spans({"trace_id": "t", "span_id": "b", "name": "2"}), str(tmp_path / "raw"), "x")
    sinks.merge_raw(spark, str(tmp_path / "raw"), str(tmp_path / "merged"))
    assert {r.name for r in spark.read.parquet(str(tmp_path / "merged")).collect()} == {"1", "2"}
    s = sinks.savings(df.select("raw_attributes"), df.select("raw_attributes").limit(1)).first()
    assert (s.rows_before, s.rows_after, s.bytes_before, s.bytes_after) == (3, 1, 16, 11)
    sinks.append_sessions(make_spans({"session_id": "s"}), str(tmp_path), "one")
    sinks.append_sessions(make_spans({"session_id": "s"}, {"session_id": "t"}), str(tmp_path), "one")
    assert sorted(r.session_id for r in spark.read.parquet(str(tmp_path / "sessions/source=one")).collect()) == ["s", "t"]


def test_trimming_and_nested_texts(spark):
    from pyspark.sql import functions as F

    from tracequarry.functions import slim, times

    big = {"llm": {"input_messages": [{"message": {"content": "old"}}, {"message": {"content": json.dumps([{"text": "x" * 40_000}, {"text": "last"}])}}], "invocation_parameters": {"tools": ["t" * 5000]}}, "input": {"value": "v" * 2001}}
    texts = [json.dumps(big), '{"llm":{"a":1}}', "[1]", "{oops", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "c string").select(slim.trim(F.col("c"))).collect()]
    v = json.loads(got[0])
    assert json.loads(v["llm"]["input_messages"][0]["message"]["content"]) == [{"text": "last"}] and len(v["llm"]["input_messages"]) == 1
    assert v["dal_trim"] == {"chars_before": len(texts[0]), "dropped_msgs": 2, "truncated": True, "input_trimmed": True, "tools_trimmed": True} and len(got[0]) < 1000
    assert got[1:] == texts[1:]
    nested = ['[{"text":"a"},{"content":[{"thinking":"b","text":" c "}]}]', "{'message.content': '[{\"text\": \"d\"}]'}", " plain ", "", None, "[broken"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in nested], "c string").select(slim.nested_texts(F.col("c"))).collect()]
    assert [sorted(x) for x in got] == [["a", "b", "c"], ["d"], ["plain"], [], [], ["[broken"]]
    d = lambda h: datetime(2026, 1, 1) + timedelta(hours=h)
    assert times.covered([(d(5), d(8)), (d(2), d(6))], d(0), d(10)) == [(d(0), d(2)), (d(8), d(10))] and times.covered([], d(0), d(1)) == [(d(0), d(1))]
    assert times.progress([(d(0), d(5))], d(0), d(10)) == 50 and times.progress([], d(0), d(1)) == 0 and times.progress([(d(0), d(1))], d(0), d(0)) == 100
    assert times.time_left(25, timedelta(hours=1)) == timedelta(hours=3) and times.time_left(0, timedelta(hours=1)) is None
    assert [times.first_window(timedelta(hours=24), n) for n in (0, 1, 4, 9)] == [timedelta(hours=x) for x in (24, 12, 1.5, 1.5)] and times.first_window(timedelta(hours=1), 4) == timedelta(minutes=15)


def test_all_sources_raw_and_older_files(spark, make_spans, tmp_path):
    root = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        readers.read_all(spark, root)
    sinks.write_spans(make_spans({"trace_id": "t", "span_id": "a"}), root, "one")
    make_spans({"trace_id": "t", "span_id": "a"}).write.parquet(f"{root}/two_spans.parquet")
    assert sorted((r.span_id, r.source) for r in readers.read_all(spark, root).collect()) == [("a", "one"), ("a", "two")]
    for n in (1, 2):
        (tmp_path / f"old_{n}.jsonl").write_text(json.dumps({"session_id": f"s{n}", "spans": [{"span_id": f"x{n}"}]}) + "\n")
    import os

    os.utime(tmp_path / "old_1.jsonl", (2_000_000_000, 2_000_000_000))
    assert [r.span_id for r in readers.read_source(spark, root, "old").collect()] == ["x1"]
    raw = tmp_path / "raw"
    raw.mkdir()
    assert readers.read_raw(spark, str(raw)).count() == 0
    (raw / "sync_1.jsonl").write_text('{"span_id":"a"}\n{broken\n')
    (raw / "other.jsonl").write_text('{"span_id":"b"}\n')
    assert [r.span_id for r in readers.read_raw(spark, str(raw)).collect()] == ["a"]

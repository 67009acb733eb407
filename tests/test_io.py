import json
import shutil

from pyspark.sql import functions as F

from gaugeworks.operators import evaluation
from gaugeworks.sources import pages, records, sinks
from gaugeworks.streaming import evaluation_log


def test_jsonl_round_trip(spark, tmp_path):
    p = tmp_path / "c.jsonl"
    p.write_text('{"id": "1", "stargazer_count": 5, "languages": ["Go"], "unknown": 1}\n\n{"id": "2"}\n')
    rows = records.read_candidates(spark, str(p)).orderBy("id").collect()
    assert [(r.id, r.stargazer_count, r.languages) for r in rows] == [("1", 5, ["Go"]), ("2", None, None)]
    sinks.write_jsonl(records.read_candidates(spark, str(p)), str(tmp_path / "out"))
    assert records.read_candidates(spark, str(tmp_path / "out")).count() == 2


def test_evaluations_and_exclusion(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text("\n".join(json.dumps({"tool_uid": "t", "judge": {"id": j}}) for j in "abb"))
    assert records.read_evaluations(spark, str(tmp_path), excluded=("a",)).count() == 2
    assert records.read_evaluations(spark, str(tmp_path), judge="a").count() == 1


def test_source_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "tests").mkdir()
    (tmp_path / "src" / "a.py").write_text("x = 1\n")
    (tmp_path / "src" / "test_a.py").write_text("x = 1\n")
    (tmp_path / "tests" / "b.py").write_text("x = 1\n")
    (tmp_path / "src" / "c.txt").write_text("x")
    assert [tuple(r) for r in records.read_source_files(spark, str(tmp_path), ["py"]).collect()] == [("src/a.py", "x = 1\n")]


def test_graph_pages(spark, tmp_path):
    node = {"id": "1", "nameWithOwner": "a/b", "languages": {"nodes": [{"name": "Go"}]}, "primaryLanguage": None, "defaultBranchRef": {"name": "main", "target": {"oid": "f"}}}
    (tmp_path / "p.json").write_text(json.dumps({"label": "topic:x", "seq": 1, "search": {"nodes": [node, None]}}) + "\n")
    rows = pages.candidates_of_pages(pages.read_pages(spark, str(tmp_path), pages.GRAPH_PAGE)).collect()
    assert len(rows) == 1 and rows[0].languages == ["Go"] and rows[0].primary_language is None and rows[0].default_branch_oid == "f" and rows[0].topics == []


def test_code_pages_modes(spark, tmp_path):
    page = lambda l, *names: json.dumps({"label": l, "seq": 1, "items": [{"repository": {"full_name": n, "fork": n == "f/f"}} for n in names]})
    (tmp_path / "p.json").write_text("\n".join([page("s2", "a/a", "f/f"), page("s1", "a/a", "b/b")]))
    df = pages.read_pages(spark, str(tmp_path), pages.CODE_PAGE)
    assert [(r.name_with_owner, r.signals) for r in pages.code_hits(df).collect()] == [("a/a", ["s1", "s2"]), ("b/b", ["s1"])]
    assert {(r.name_with_owner, r.label) for r in pages.first_signal(df, ["s1", "s2"]).collect()} == {("a/a", "s1"), ("b/b", "s1"), ("f/f", "s2")}
    assert pages.queries_for([("x", ["a", "b"]), ("x", ["a"])]) == [("x|a", '"x" a'), ("x|b", '"x" b')]


def test_page_source(spark):
    def client(query, cursor):
        n = int(cursor or 0)
        return {"q": query, "n": n, "pageInfo": {"hasNextPage": n < 2, "endCursor": str(n + 1)}}

    spark.dataSource.register(pages.page_source("fakepages", [("a", "qa"), ("b", "qb")], client))
    rows = spark.read.format("fakepages").load().collect()
    assert sorted((r.label, r.page_no) for r in rows) == [(x, k) for x in "ab" for k in range(3)]


def test_page_retries():
    calls = []

    def client(q, c):
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionError
        return {}

    assert len(list(pages.PageReader([("a", "q")], client, pause_s=0).read(pages._Partition("a", "q")))) == 1 and len(calls) == 3


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a_b", 1.5), ("c", None)], "n string, v double")
    assert sinks.latex_rows(df, ["n", "v"]) == ["a\\_b & 1,50 \\\\", "c & -- \\\\"]
    assert json.loads(sinks.render_html("__DATA__", {"t": df})) == {"t": [{"n": "a_b", "v": 1.5}, {"n": "c", "v": None}]}
    good, bad = sinks.split_quarantine(df, F.col("v") > 1, "no value")
    assert good.count() == 1 and bad.collect()[0].error == "no value"
    sinks.export_tables({"t": df}, str(tmp_path / "csv"))
    sinks.append_partitioned(df, str(tmp_path / "parts"), "n")
    sinks.append_partitioned(df.where("n = 'c'"), str(tmp_path / "parts"), "n")
    assert spark.read.parquet(str(tmp_path / "parts")).count() == 3
    sinks.replace_partitions(df.where("n = 'c'"), str(tmp_path / "parts"), "n")
    assert spark.read.parquet(str(tmp_path / "parts")).count() == 2
    sinks.rewrite_guarded(df, df, str(tmp_path / "new"))


def test_streaming_log(spark, tmp_path):
    src, out, ck = tmp_path / "in", str(tmp_path / "out"), evaluation_log.checkpoint_path(str(tmp_path / "ck"), "q")
    src.mkdir()
    line = lambda t, s, at: json.dumps({"tool_uid": t, "scenario": "x", "prompt_version": "v", "judge": {"id": "j"}, "status": s, "evaluated_at": at})
    (src / "1.json").write_text("\n".join([line("a", "error", "2"), line("a", "ok", "1"), line("b", "ok", "1")]))
    run = lambda: evaluation_log.append_batches(evaluation_log.read_log(spark, str(src), records.EVALUATION), out, ck).awaitTermination()
    run()
    assert sorted((r.tool_uid, r.status) for r in spark.read.parquet(out).collect()) == [("a", "ok"), ("b", "ok")]
    (src / "2.json").write_text(line("c", "ok", "1"))
    run()
    run()
    assert spark.read.parquet(out).count() == 3
    assert evaluation_log.checkpoint_path("r", "q1") != evaluation_log.checkpoint_path("r", "q2")


def test_streaming_window_and_late_duplicates(spark, sf, tmp_path):
    schema, src = spark.read.parquet(f"{sf}/evaluations.parquet").schema, tmp_path / "log"
    src.mkdir()
    shutil.copy(f"{sf}/evaluations.parquet", src / "1.parquet")
    stream = evaluation_log.read_log(spark, str(src), schema, "parquet")
    q = evaluation_log.windowed_status(stream).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(n) from w").collect()[0][0] == spark.read.parquet(f"{sf}/evaluations.parquet").count()
    d = evaluation_log.drop_duplicates_late(evaluation_log.read_log(spark, str(src), schema, "parquet").withColumn("j", F.col("judge.id")), ["tool_uid", "scenario", "j"])
    q = d.writeStream.format("memory").queryName("dd").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select count(*) from dd").collect()[0][0] == spark.read.parquet(f"{sf}/evaluations.parquet").select("tool_uid", "scenario", "judge.id").distinct().count()


def test_judge_runner(spark):
    work = spark.createDataFrame([(f"t{i}", "with_source", f"n{i}") for i in range(10)], "tool_uid string, scenario string, name string")
    got = evaluation.run_judge(work, "j", evaluation.build_scorer("fixed", score=4)).collect()
    assert len(got) == 10 and {r.status for r in got} == {"ok"} and got[0].scores.purpose.score == 4

    def broken(rows):
        raise RuntimeError("429 Too many requests")

    bad = evaluation.run_judge(work, "j", broken).select(evaluation.error_kind(F.col("error_detail")).alias("k")).distinct().collect()
    assert [r.k for r in bad] == ["rate_limit"]


def test_replies():
    ok = json.dumps({c: {"score": 1, "reasoning": "r"} for c in evaluation.COMPONENTS})
    assert evaluation.parse_reply("text " + ok + " end")[0] == "ok"
    for bad in (None, "", "{", "{}", ok.replace('"score": 1', '"score": 6', 1), ok.replace('"score": 1', '"score": true', 1)):
        assert evaluation.parse_reply(bad)[0] == "error"
    assert evaluation.parse_reply('{"refused": true}')[0] == "refused"


def test_rate_limiter():
    t, slept = [0.0], []
    lim = evaluation.RateLimiter(60, clock=lambda: t[0], sleep=slept.append)
    lim.wait()
    lim.wait()
    assert slept == [1.0]


def test_labels(spark):
    df = spark.createDataFrame([(1, ["a", "x"]), (2, ["x"]), (3, [])], "k int, categories array<string>")
    assert [r.categories for r in evaluation.closed_set_labels(df, ["a", "b"]).orderBy("k").collect()] == [["a"], ["none"], ["none"]]
    other = spark.createDataFrame([(1, ["a"]), (2, ["y"])], "k int, categories array<string>")
    assert [r.categories for r in evaluation.reconcile_labels(df, other, "k").orderBy("k").collect()] == [["a"], ["x", "y"], []]


def test_pages_are_resumed_replayed_and_renewed(spark, tmp_path):
    """Three rounds of two pages; a second run asks nothing, a changed query starts anew and replaces its pages only."""
    log = tmp_path / "calls"
    log.write_text("")

    def client(query, cursor):
        with open(log, "a") as f:
            f.write(f"{query}:{cursor}\n")
        n = int(cursor or 0)
        if query == "broken" and n == 3 and "again" not in log.read_text():
            raise ValueError("stop")
        return {"q": query, "n": n, "pageInfo": {"hasNextPage": n < 4, "endCursor": str(n + 1)}}

    path = str(tmp_path / "pages")
    run = lambda *qs: pages.collect_pages(spark, list(qs), client, path, pages_per_round=2, pause_s=0)
    assert sorted((r.label, r.page_no) for r in run(("a", "x"), ("b", "y")).collect()) == [(k, n) for k in "ab" for n in range(5)]
    calls = log.read_text()
    assert sorted(calls.split()) == sorted(f"{q}:{c}" for q in "xy" for c in (None, 1, 2, 3, 4))
    assert run(("a", "x"), ("b", "y")).count() == 10 and log.read_text() == calls
    got = run(("a", "x2"), ("b", "y"))
    assert sorted((r.label, r.query) for r in got.collect()) == [("a", "x2")] * 5 + [("b", "y")] * 5
    try:
        run(("c", "broken"))
        raise AssertionError
    except Exception as e:  # noqa: BLE001
        assert "stop" in str(e)
    with open(log, "a") as f:
        f.write("again\n")
    before = len(log.read_text().split())
    assert run(("c", "broken")).count() == 5
    assert log.read_text().split()[before:] == ["broken:2", "broken:3", "broken:4"]  # what was stored is not asked again


def test_rate_limit_is_waited_out_and_stopping_early_is_seen():
    slept, calls = [], []

    def client(q, c):
        calls.append(c)
        if len(calls) == 1:
            raise pages.RateLimited(130.0)
        return {"pageInfo": {"hasNextPage": True, "endCursor": "z"}}

    rows = list(pages.PageReader([], client, max_pages=2, sleep=slept.append, clock=lambda: 100.0).read(pages._Partition("a", "q")))
    assert slept == [31.0] and [r[5] for r in rows] == [True, True]


def test_code_search_pages():
    slept, now = [], [0.0]
    repo = {"full_name": "a/b", "fork": False, "owner": {"login": "a", "x": 1}, "trees_url": "t"}
    client = pages.code_search_client(lambda q, page, size: {"total_count": 2500, "incomplete_results": False, "items": [{"path": "p", "score": 1.0, "repository": repo}, {"repository": None}]}, sleep=slept.append, clock=lambda: now[0])
    got = list(pages.PageReader([], client).read(pages._Partition("a", "q")))
    assert len(got) == 10 and len(slept) == 9 and slept[0] == 6.5 and not got[-1][5]
    page = json.loads(got[0][3])
    assert page["truncated"] and page["items"] == [{"score": 1.0, "repository": {k: repo.get(k) for k in pages._REPO_FIELDS} | {"owner": {"id": None, "node_id": None, "login": "a"}}}]
    assert pages.repository_queries(["t"], ["s"], 5) == [("topic:t", "topic:t fork:false stars:>=5"), ("text:s", '"s" in:readme,description fork:false stars:>=5')]


def test_hydration(spark):
    def client(name):
        if name == "gone/x":
            raise pages.NotFound
        if name == "bad/x":
            raise ValueError("other")
        return {"n": name}

    hits = spark.createDataFrame([("a/a",), ("a/a",), ("gone/x",), ("kept/x",), (None,)], "name_with_owner string")
    cache = spark.createDataFrame([("kept/x", "{}")], "name_with_owner string, body string")
    good, gone = pages.hydrate(hits, cache, client)
    assert sorted((r.name_with_owner, r.body) for r in good.collect()) == [("a/a", '{"n": "a/a"}'), ("kept/x", "{}")]
    assert [(r.name_with_owner, r.error) for r in gone.collect()] == [("gone/x", "NOT_FOUND")]
    try:
        pages.hydrate(spark.createDataFrame([("bad/x",)], "name_with_owner string"), cache, client)[0].collect()
        raise AssertionError
    except Exception as e:  # noqa: BLE001
        assert "other" in str(e)


def test_broken_bytes_keep_the_rest(spark, tmp_path):
    (tmp_path / "a.py").write_bytes(b"x = '\xff\xe9'\ny = 1\n")
    assert records.read_source_files(spark, str(tmp_path), ["py"]).collect()[0].body == "x = '\ufffd\ufffd'\ny = 1\n"


def test_limiter_waits_for_each_call_and_one_failure_is_one_error():
    slept = []
    limiter = evaluation.RateLimiter(60, clock=lambda: 0.0, sleep=slept.append)
    ok = json.dumps({c: {"score": 2, "reasoning": "r"} for c in evaluation.COMPONENTS})

    def scorer(rows):
        if rows[0]["tool_uid"] == "b":
            raise RuntimeError("boom")
        return [ok]

    got = [evaluation._call(scorer, [{"tool_uid": u}], limiter)[0] for u in "abc"]
    assert [g[0] for g in got] == ["ok", "error", "ok"] and got[1][2] == "boom" and slept == [1.0, 2.0]


def test_chat_scorer_retries_rotates_and_refuses():
    seen = []

    def transport(key, request):
        seen.append(key)
        if key == "k1":
            return 429, {"error": "quota exceeded"}
        if len(seen) == 2:
            return 503, {}
        name = json.loads(request["messages"][1]["content"])["name"]
        return 200, {"choices": [{"message": {"content": "{}", "refusal": "no" if name == "r" else None}}]}

    scorer = evaluation.build_scorer("chat", transport=transport, model="m", keys=["k1", "k2"], instruction="i", sleep=lambda s: None)
    assert scorer([{"name": "a"}, {"name": "r"}]) == ["{}", '{"refused": true}'] and seen == ["k1", "k2", "k2", "k2"]
    detail = 'x {"error": {"details": [{"violations": [{"quotaMetric": "m", "quotaValue": "5"}]}, {"retryDelay": "7s"}]}}'
    assert evaluation.quota_detail(detail) == {"metric": "m", "limit": "5", "retry_s": "7"} and evaluation.quota_detail("x") == {}

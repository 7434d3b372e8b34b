"""Small fixtures for operators that have no SQL twin."""

import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidewell.functions import urls
from tidewell.operators import evals, fetch, fusion, governor, grounding, history, render, replies, search, tape, tools
from tidewell.sources import readers, sinks


def test_fusion_order_and_ties(spark):
    hits = [
        ("t1", "https://www.a.example/x/", "short", "brave", "rust http", 0, None, 0),
        ("t2", "http://a.example/x#f", "a longer snippet", "bing", "rust http", 3, "2024-01-01", 3),
        ("t3", "https://b.example/", "rust http", "cratesio", "rust http", 0, None, 0),
        ("t4", "   ", "", "brave", "rust http", 1, None, 1),
    ]
    rows = spark.createDataFrame(hits, "title string, url string, snippet string, provider string, query string, rank int, published_date string, pos int")
    out = {r.url_key: r for r in fusion.ranked(fusion.fuse(rows, ["rust http"])).collect()}
    assert set(out) == {"a.example/x", "b.example"}
    a = out["a.example/x"]
    assert (a.title, a.display_url, a.snippet, a.providers, a.best_rank, a.hit_count, a.published_date) == ("t1", "https://www.a.example/x/", "a longer snippet", ["brave", "bing"], 0, 2, "2024-01-01")
    assert a.rrf == 1 / 61 + 1 / 64 and out["b.example"].rrf == 2 / 61
    assert out["b.example"].position == 1 and out["b.example"].score == out["b.example"].rrf


@pytest.mark.parametrize(
    ("query", "route"),
    [("the `bytes` type", ("bytes", True)), ("tokio::sync::Mutex usage", ("tokio", True)), ("std::fs rust", None), ("the bytes crate", ("bytes", True)), ("serde_json", ("serde_json", True)), ("rust http client", ("http client", False)), ("weather today", None)],
)
def test_routes(spark, query, route):
    r = spark.createDataFrame([(query,)], "q string").select(search.crate_route(F.col("q")).alias("r")).first().r
    assert (tuple(r) if r else None) == route


def test_arguments(spark):
    cases = [
        ('{"queries":["a"],"top_k":5}', None), ('{"queries":"[\\"a\\",\\"b\\"]"}', None), ('{"q":1}', "Unknown argument `q`; allowed: queries, top_k, recency."), ("[1]", "Provide arguments as an object; got [1]."),
        ('{"queries":["a"],"top_k":"x"}', 'Provide top_k as an integer 1-30; got "x".'), ('{"queries":["a"],"top_k":null}', "Provide top_k as an integer 1-30; got null."), ('{"queries":["a"],"top_k":-3}', "Provide top_k as an integer 1-30; got -3."), ('{"queries":["a"],"top_k":2.5}', "Provide top_k as an integer 1-30; got 2.5."),
        ('{"queries":["a"],"top_k":99999999999}', None), ('{"queries":["a"],"recency":"hour"}', 'Provide recency as day|week|month|year; got "hour".'), ('{"queries":["a"],"recency":null}', None), ('{"queries":[1,2]}', "Provide queries as strings; got 1."), ('{"queries":["x",null]}', "Provide queries as strings; got null."),
        ('{"queries":null}', "Provide queries as an array of strings; got null."), ('{"queries":"plain"}', 'Provide queries as an array of strings; got "plain".'), ("{}", "Provide queries as an array of 1-8 strings; got missing."), ('{"queries":[" "]}', "Provide at least one non-empty query."), ("{", "arguments are not valid JSON"), (None, "arguments are not valid JSON"), ("NaN", "arguments are not valid JSON"),
    ]
    out = search.search_arguments(spark.createDataFrame([(a,) for a, _ in cases], "arguments string")).collect()
    assert [r.error for r in out] == [e for _, e in cases] and out[1].queries == ["a", "b"] and (out[8].top_k, out[0].top_k, out[10].top_k) == (30, 5, 15)
    cases = [
        ('{"url":"https://a.example"}', None, None), ('{"url":1}', None, "invalid url: 1 (expected absolute http(s) URL)"), ('{"url":"x","part":0}', None, "invalid part: 0 (expected an integer >= 1)"), ('{"url":"x","part":null}', None, None), ('{"url":"x","part":3}', 3, None),
        ('{"url":"x","part":4294967297}', None, "invalid part: 4294967297 (expected an integer >= 1)"), ('{"url":"x","part":true}', None, "invalid part: true (expected an integer >= 1)"), ('{"url":""}', None, None), ("{}", None, "invalid url:  (expected absolute http(s) URL)"), ('["u"]', None, 'invalid url: ["u"] (expected absolute http(s) URL)'),
    ]
    fetch_ = search.fetch_arguments(spark.createDataFrame([(a,) for a, *_ in cases], "arguments string")).collect()
    assert [(r.part, r.error) for r in fetch_] == [(p, e) for _, p, e in cases]
    v = search.valid_search(spark.createDataFrame([([" a ", ""], None), ([" "], 99), (["x" * 501], 3)], "queries array<string>, top_k int")).collect()
    assert [(r.top_k, r.error) for r in v] == [(15, None), (30, "empty_query"), (3, "too_many_queries")]


def test_classify(spark):
    rows = spark.createDataFrame([("bing", 200, "captchaSuccessPostMessage", "", 0), ("brave", 429, "", "", 0), ("yahoo", 500, "", "", 0), ("bing", 200, 'id="b_results"', "", 0), ("bing", 200, "odd", "", 0), ("yahoo", 200, "", "https://guce.yahoo.com/x", 0)], "provider string, status int, body string, final_url string, n_rows int")
    assert [(r.error, r.detail) for r in search.classify(rows).collect()] == [("challenge", "bot challenge"), ("challenge", "bot challenge"), ("upstream", "HTTP 500"), (None, None), ("upstream", "unrecognized markup"), ("challenge", "bot challenge")]


def test_paged_legs(spark):
    rows = spark.createDataFrame([("a", 0, "t1", 10), ("a", 1, "t2", 7), ("a", 2, "t3", 9), ("a", 3, "t4", 9), ("b", 0, "t1", 10), ("b", 1, "t1", 8), ("b", 2, "t2", 8), ("c", 0, "t1", 4), ("c", 1, "t2", 9)], "leg string, page int, token string, n_rows int")
    got = sorted((r.leg, r.page) for r in search.stop_pages(rows, ["leg"]).collect())
    assert got == [("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 1), ("c", 0)]


def test_reports(spark):
    rows = spark.createDataFrame([(1, "brave", 0, 0, False, False, "challenge", "wall", None), (1, "yahoo", 1, 0, False, False, "suspended", "held", "challenge")], "call_id int, engine string, leg int, n_rows int, answered boolean, cached boolean, problem string, message string, reason string")
    f = search.failures(rows, ["call_id"]).first()
    assert (f.all_challenged, f.failures) == (True, "brave: wall; yahoo: held")
    assert search.status_line(search.engine_report(rows, ["call_id"]), ["call_id"]).first().lines == ["brave: challenge", "yahoo: suspended"]
    rows = spark.createDataFrame([(1, "brave", 0, 3, True, False, None, None), (1, "brave", 1, 0, False, False, "suspended", "suspended (challenge), 3412s left"), (1, "brave", 2, 0, False, False, "suspended", "suspended (challenge), 3412s left"), (1, "bing", 0, 0, True, False, None, None), (1, "yahoo", 0, 1, True, False, None, None)], "call_id int, engine string, leg int, n_rows int, answered boolean, cached boolean, problem string, detail string")
    assert set(search.status_line(search.engine_report(rows, ["call_id"]), ["call_id"]).first().lines) == {"brave: 3 rows, suspended (challenge), 3412s left", "bing: no results", "yahoo: 1 row"}
    text = lambda kind, detail=None, query=None: spark.range(1).select(search.problem_text(F.lit(kind), F.lit(detail).cast("string"), F.lit(90), F.lit("challenge"), query)).first()[0]
    assert [text("suspended"), text("timeout"), text("timeout", query=F.lit("q")), text("upstream", "HTTP 500"), text("empty_query"), text("too_many_queries", "9 > 5")] == ["suspended (challenge), 90s left", "timed out", "timed out: q", "HTTP 500", "empty query", "too many queries: 9 > 5"]


def test_deadlines(spark):
    """After the soft limit a success cuts queued legs only; those that run go on to the hard limit."""
    legs = [(1, "a", 0, 1_000, True), (1, "b", 100, 20_000, True), (1, "c", 5_500, 9_000, True), (1, "d", 200, 31_000, True), (1, "e", None, None, False), (2, "f", 0, 7_000, True), (2, "g", 6_000, 8_000, True), (2, "h", 7_500, 9_000, True), (3, "i", 29_000, 30_000, False)]
    got = search.deadlines(spark.createDataFrame(legs, "call_id int, leg string, started_ms int, ended_ms int, ok boolean"))
    assert {r.leg: r.outcome for r in got.collect()} == {"a": "done", "b": "done", "c": "timeout", "d": "timeout", "e": "timeout", "f": "done", "g": "done", "h": "timeout", "i": "done"}
    assert {r.leg for r in got.where("queued").collect()} == {"c", "e", "h"}


def test_grounding(spark):
    bullets = spark.createDataFrame([(1, 0, "says so", "the Quote", ["https://www.a.example/p/", "https://b.example"]), (1, 1, "no page", None, ["https://c.example"]), (1, 2, "x", None, ["https://a.example/p"])], "answer_id int, ord int, text string, quote string, links array<string>")
    pages = spark.createDataFrame([(1, 0, "https://a.example/p", "here is **the quote** ok"), (1, 1, "http://www.a.example/p/", "later")], "answer_id int, pos int, url string, markdown string")
    graded = grounding.graded_bullets(bullets, pages)
    assert [r.support for r in graded.orderBy("ord").collect()] == ["exact", "unchecked", "none"]
    assert tuple(grounding.counters(graded).first())[1:] == (3, 2, 1, 0, 1)
    assert {(r.link, r.support) for r in grounding.cited_support(bullets, pages).collect()} == {("https://www.a.example/p/", "exact"), ("https://a.example/p", "none")}
    numbers = grounding.local_pages(bullets, pages.select("answer_id", "pos", F.col("url").alias("requested"), F.col("url").alias("final")))
    assert {(r.ord, tuple(r.pages)) for r in numbers.collect()} == {(0, (1,)), (2, (1,))}
    given = spark.createDataFrame([(1, ["supported", "partly"])], "answer_id int, verdicts array<string>")
    assert [r.verdict for r in grounding.verdicts(bullets, numbers, given).orderBy("ord").collect()] == ["supported", "uncited", "partly"]


def test_statistics(spark):
    a = spark.createDataFrame([(str(i), 0.0) for i in range(3)], "goal_id string, value double").withColumn("m", F.lit("x"))
    b = spark.createDataFrame([(str(i), float(i + 1)) for i in range(3)], "goal_id string, value double").withColumn("m", F.lit("x"))
    r = evals.paired(a, b, ["m"]).first()
    assert r.diff == 2 and abs(r.high - 2 - 4.303 / 3**0.5) < 1e-12
    assert evals.paired(a.limit(1), b.where("goal_id = '0'"), ["m"]).first().low is None
    reply = spark.createDataFrame([('text {"grade":"CORRECT","nuggets":[true,false]} end',), ('{"grade":"X","nuggets":[true,true]}',)], "r string")
    assert [x[0] is not None for x in reply.select(evals.judge_reply(F.col("r"), F.lit(2))).collect()] == [True, False]
    texts = ["Fine claim.", "a; b", "One. Two", "A, but b", "open ` tick", " ", "`a; b` ok"]
    got = [x[0] for x in spark.createDataFrame([(t,) for t in texts], "t string").select(evals.claim_problem(F.col("t"))).collect()]
    assert got == [None, "a semicolon joins claims", "more than one sentence", 'joins clauses with ", but"', "unbalanced backtick or double quote", "empty text", None]


def test_replies(spark):
    def call(i, **f):
        return {"choices": [{"delta": {"tool_calls": [{"index": i, **f}]}}]}

    events = [{"choices": [{"delta": {"content": "He"}}]}, {"choices": [{"delta": {"content": "y"}}]}, call(0, id="c1", function={"name": "search", "arguments": '{"a"'}), call(0, id="", function={"name": "", "arguments": ":1}"}), {"choices": [{"delta": {}, "finish_reason": "tool_calls"}], "usage": {"prompt_tokens": 3}}]
    body = "".join(f": c\ndata: {json.dumps(e)}\n\n" for e in events) + "data: [DONE]\n\ndata: cut"
    frame = spark.createDataFrame([("s", body)], "stream_id string, body string")
    rows = frame.select("stream_id", F.posexplode(replies.sse_events(F.col("body"))).alias("seq", "data"))
    r = replies.openai_replies(rows).first()
    assert (r.output, r.finish_reason, r.cut, r.usage.prompt_tokens) == ("Hey", "tool_calls", False, 3) and tuple(r.tool_calls[0]) == (0, "c1", "search", '{"a":1}')
    blocks = [{"type": "message_start", "message": {"usage": {"input_tokens": 9, "output_tokens": 1}}}, {"type": "content_block_start", "index": 0, "content_block": {"type": "text", "text": ""}}, {"type": "content_block_delta", "index": 0, "delta": {"type": "text_delta", "text": "Hi"}}, {"type": "content_block_start", "index": 1, "content_block": {"type": "tool_use", "id": "t", "name": "fetch"}}, {"type": "content_block_delta", "index": 1, "delta": {"type": "input_json_delta", "partial_json": "{}"}}, {"type": "message_delta", "delta": {"stop_reason": "tool_use"}, "usage": {"output_tokens": 5}}, {"type": "message_stop"}]
    a = replies.anthropic_replies(spark.createDataFrame([("s", i, json.dumps(b)) for i, b in enumerate(blocks)], "stream_id string, seq int, data string")).first()
    assert (a.output, a.finish_reason, a.cut, a.usage.output_tokens, a.tool_calls[0].name) == ("Hi", "tool_calls", False, 5, "fetch")
    e = spark.createDataFrame([(429, 7), (501, None), (404, None), (200, None)], "s int, r int").select(replies.http_error(F.col("s"), F.col("r")).alias("e")).collect()
    assert [(x.e and (x.e.kind, x.e.retryable, x.e.retry_after)) for x in e] == [("rate_limited", True, 7), ("server", False, None), ("rejected", False, None), None]
    merged = spark.createDataFrame([('{"a":1,"b":{"x":2}}', '{"a":5}')], "e string, t string").select(replies.merged_json(F.col("e"), F.col("t"))).first()[0]
    assert json.loads(merged) == {"a": 5, "b": {"x": 2}}


def test_governor_skips(spark):
    log = spark.createDataFrame([("e", 0, 0, "challenge", None, None), ("e", 1000, 1, "ok", None, None), ("e", 2000, 2, "upstream", 503, 9999), ("e", 3000, 3, "timeout", None, None)], "engine string, ts long, ordinal long, kind string, status int, retry_after long")
    assert [(r.until, r.reason) for r in governor.suspensions(log).orderBy("ordinal").collect()] == [(3600000, "challenge"), (None, None), (3602000, "retry_after"), (3602000, "retry_after")]


def test_fetch(spark):
    rows = [(200, "text/html", "<p>x</p>", "m" * 200, None), (403, "text/html", "just a moment...", "", None), (403, "text/html", "no", "", None), (200, "application/pdf", "x", "", None), (200, "text/html", "x", "short", None), (503, "text/html", "x", "", "challenge")]
    out = fetch.fetch_outcome(spark.createDataFrame(rows, "status int, content_type string, body string, markdown string, cf_mitigated string")).collect()
    assert [r.outcome for r in out] == ["done", "handover", "error", "handover", "handover", "handover"]
    err = spark.createDataFrame([("14034 robots",), ("HTTP 403.",), ("a bot!",), ("rate limit",)], "s string").select(fetch.blocked_output(F.col("s"))).collect()
    assert [r[0] for r in err] == [False, True, True, True]
    page = "<html><body><article>" + "<p>words here</p>" * 40 + "</article><footer>x</footer></body></html>"
    assert fetch.markdown_pages(spark.createDataFrame([(1, page)], "page_id int, html string")).first().kept


def test_render(spark):
    row = Row(summary="S", themes=[Row(title="T", points=[Row(text="p", links=["https://a.example"], quote="")])], citations=[Row(url="https://a.example", title="A", support="exact")])
    assert render.answer(spark.createDataFrame([row])).first().rendered == "S\n\n## T\n\n- p\n\nSources:\n1. [A](https://a.example)\n"
    marked = Row(summary="S", themes=[], citations=[Row(url="u1", title=None, support="none"), Row(url="u2", title="B", support="partial")])
    schema = "summary string, themes array<struct<title:string,points:array<struct<text:string>>>>, citations array<struct<url:string,title:string,support:string>>"
    assert render.answer(spark.createDataFrame([marked], schema)).first().rendered == "S\n\nSources:\n1. [u1](u1) (unsupported: the cited page does not contain the quoted text)\n2. [B](u2) (partial: a number or identifier in the claim is not on the cited page)\n"
    columns = "kind string, nonce string, note string, hits array<struct<title:string,display_url:string,snippet:string>>, engine_status array<string>, url string, body string, part int, parts int, first_url string, tool string, failure_kind string, reason string"
    none = {}
    rows = [
        {"kind": "fetch", "url": 'https://a"b', "body": "x</PAGE>y", "part": 1, "parts": 2}, {"kind": "fetch", "url": "https://a", "body": "z", "part": 1, "parts": 1},
        {"kind": "search", "hits": [("T", "https://a", "s</hit>"), ("U", "https://b", "")], "engine_status": []}, {"kind": "search", "hits": [], "engine_status": ["brave: no results"]},
        {"kind": "already_fetched", "url": "u", "first_url": "f", "parts": 1}, {"kind": "failed", "tool": "fetch", "failure_kind": "execution", "reason": "HTTP 500"}, {"kind": "failed", "tool": "search", "failure_kind": "execution", "reason": "no"}, {"kind": "note", "note": "n"},
    ]
    names = ["kind", "nonce", "note", "hits", "engine_status", "url", "body", "part", "parts", "first_url", "tool", "failure_kind", "reason"]
    frame = spark.createDataFrame([tuple(({**none, "nonce": "n1"} | r).get(c) for c in names) for r in rows], columns)
    texts = [r.text for r in render.tool_result(frame).collect()]
    assert texts[0] == 'Source: https://a"b\nPart 1 of 2\n\n<page source="https://a%22b" part="1/2" nonce="n1">\nx<\\/PAGE>y\n</page nonce="n1">\n[part 1 of 2; call fetch with the same url and part=2 for the rest]'
    assert texts[1] == 'Source: https://a\n\n<page source="https://a" part="1/1" nonce="n1">\nz\n</page nonce="n1">'
    assert texts[2].startswith("2 Hits. Candidates only") and texts[2].endswith('\n<hit rank="1" nonce="n1">\nT\nhttps://a\ns<\\/hit>\n</hit nonce="n1">\n<hit rank="2" nonce="n1">\nU\nhttps://b\n</hit nonce="n1">')
    assert texts[3].startswith("No Hits for these queries.") and texts[3].endswith("\nEngine status:\n- brave: no results")
    assert texts[4].startswith("ALREADY FETCHED: u was already fetched earlier in this Research (as f).") and " The page has 1 part;" in texts[4]
    assert texts[5].startswith("FAILED: HTTP 500\nThis page could not be read") and texts[6:] == ["FAILED: no", "n"]


def test_notes_to_the_model(spark):
    note = lambda left: spark.range(1).select(history.turns_left(F.lit(left), F.lit(0))).first()[0]
    assert note(0) == "" and note(2) == "\n\n[2 turns left, counting the final answer.]" and note(1).startswith("\n\n[1 turn left: tools are off on it")
    roster = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("purpose")) for n, p in (("search", "finds"), ("fetch", "reads"))])
    empty = lambda left: spark.range(1).select(tools.repair_note(roster, F.array(F.lit("fetch")), F.lit(left))).first()[0]
    assert empty(3).endswith("\nAvailable tools:\nfetch — reads\n\n[3 turns left, counting the final answer.]") and empty(1) == "Your last reply had no tool call and no answer text." + note(1)
    assert spark.range(1).select(tools.goal_message(F.lit("g"), F.lit("short"))).first()[0] == "Research goal: g\nRequested synthesis size: short."
    closed = history.close_sessions(spark.createDataFrame([("ok", True, False, 0, True)], "outcome string, log_failed boolean, blocked boolean, evidence int, had_hits boolean")).first()
    assert (closed.outcome, closed.exit_code) == ("session_io", 6)


def test_fusion_of_many_searches(spark):
    """Each search has its own queries; of equally long snippets the first in fold order wins."""
    hit = lambda call, query, rank, snippet: (call, "rust http", "https://a.example/", snippet, "brave", query, rank, None, rank)
    schema = "call int, title string, url string, snippet string, provider string, query string, rank int, published_date string, pos int"
    rows = spark.createDataFrame([hit(1, "rust http", 0, "aaa"), hit(2, "python csv", 0, "aaa"), hit(3, "qd", 0, "ddd"), hit(3, "qa", 0, "xxx")], schema)
    queries = spark.createDataFrame([(1, ["rust http"]), (2, ["python csv"])], "call int, queries array<string>")
    got = {r.call: r for r in fusion.fuse(rows, queries, ["call"]).collect()}
    assert got[1].score > got[2].score and got[1].rrf == got[2].rrf and got[3].snippet == "xxx"
    one = fusion.fuse(rows.where("call = 1"), ["rust http"]).first()
    assert one.score == got[1].score


def test_keys_of_any_url(spark):
    """Odd URLs merge like plain ones, in fusion and in citations."""
    odd = ["https://user:pw@www.a.example/p/", "https://a.example/x/../p", "HTTPS://A.example:443/p#f", "https://a.example/p"]
    rows = spark.createDataFrame([(u, "brave", "q", i, i, "t", "s", None) for i, u in enumerate(odd)], "url string, provider string, query string, rank int, pos int, title string, snippet string, published_date string")
    fused = fusion.fuse(rows, ["q"]).collect()
    exact = {r[0] for r in rows.select(urls.url_key_exact(F.col("url"))).collect()}
    assert {r.url_key for r in fused} == exact and len(exact) < len(odd)
    pages = spark.createDataFrame([(1, 0, odd[1], "the quote")], "answer_id int, pos int, url string, markdown string")
    cited = grounding.fetched_only(spark.createDataFrame([(1, odd[3])], "answer_id int, url string"), pages)
    assert cited.count() == 1


def test_history(spark):
    assert spark.range(1).select(history.context_budget(F.lit(200_000), F.lit(8_000))).first()[0].asDict() == {"context_chars": 400_000, "part_chars": 24_000}
    assert spark.range(1).select(history.exit_code(F.lit("interrupted")), history.exit_code(F.lit("?"))).first()[0:2] == (130, 1)


def test_session_files(spark, tmp_path):
    lines = [{"kind": "header", "format_version": 2, "session_id": "s", "goal": "g"}, {"kind": "event", "format_version": 2, "session_id": "s", "seq": 1, "type": "a", "data": {"x": 1}}, {"kind": "event", "format_version": 3}, {"format_version": 2}]
    (tmp_path / "s.jsonl").write_text("\n".join([json.dumps(x) for x in lines[:2]] + [""] + [json.dumps(x) for x in lines[2:]] + ["{bad"]) + "\n")
    rows = readers.session_rows(spark, str(tmp_path / "s.jsonl"))
    assert [r.error for r in rows.orderBy("line").collect()] == [None, None, "line 4: format_version 3 is newer than 2", "line 5: no kind", "line 6: not JSON"]
    assert readers.of_kind(rows, "header").first().goal == "g" and readers.of_kind(rows, "event").count() == 1
    with pytest.raises(Exception, match="line 4|line 5|line 6"):
        readers.strict(rows).select("value").collect()
    sinks.append_json(sinks.stored_events(spark.createDataFrame([("model.delta",), ("a",)], "type string")), str(tmp_path / "out"), "gzip")
    assert spark.read.json(str(tmp_path / "out")).count() == 1
    (tmp_path / "how.json").write_text(json.dumps({"category": "how", "goals": [{"id": "g1", "goal": "G", "nuggets": [{"text": "t", "scope": "core"}]}]}))
    assert readers.golden(spark, str(tmp_path / "how.json")).first().category_ok
    (tmp_path / "r.json").write_text(json.dumps({"format": 1, "rows": [{"goal_id": "a"}]}))
    with pytest.raises(Exception, match="expected 2"):
        readers.results(spark, str(tmp_path / "r.json")).collect()
    (tmp_path / "idx").write_text('{"vers":"1.0.0","yanked":true}\nnope\n{"vers":"1.1.0","pubtime":"2024-01-02T03"}\n')
    assert [(r.ord, r.vers, r.yanked) for r in readers.crate_index(spark, str(tmp_path / "idx")).orderBy("ord").collect()] == [(1, "1.0.0", True), (3, "1.1.0", False)]


def test_tape(spark):
    pages = spark.createDataFrame([(0, "a.example", False, None), (1, "a.example", True, "https://b.example/"), (2, "a.example", True, "https://c.example/")], "pos int, url_key string, is_page boolean, final_url string")
    asked = spark.createDataFrame([("https://a.example/",), ("https://www.b.example",), ("https://d.example",)], "url string")
    assert {r.url: r.pos for r in tape.find_pages(asked, pages).collect()} == {"https://a.example/": 1, "https://www.b.example": 1, "https://d.example": None}
    assert [r.url for r in tape.missing_pages(asked, pages).collect()] == ["https://d.example"]


def test_tools(spark):
    calls = spark.createDataFrame([("1", "search", '{"queries":["a"]}'), ("2", "fetch", "{"), ("3", "open", "{}"), ("4", "fetch", '{"url":5}')], "id string, name string, arguments string")
    out = {r.id: (r.route, r.failure) for r in tools.dispatch(calls).collect()}
    assert out == {"1": ("search", None), "2": (None, "arguments are not valid JSON"), "3": (None, "unknown tool 'open'"), "4": (None, "invalid args for 'fetch': invalid url: 5 (expected absolute http(s) URL)")}
    assert [r[0] for r in spark.createDataFrame([('{"a":["xy",{"b":"é"}],"n":1}',), ("{",)], "t string").select(tools.string_chars(F.col("t"))).collect()] == [3, None]
    bad = spark.createDataFrame([(100, 200, 1, 1, "https://a", "openai"), (3000, 10, 1, 1, "https://a", "anthropic"), (10, None, 2, 2, "https://a", "openai")], "max_tokens int, thinking_budget int, max_attempts int, timeout_ms int, base_url string, format string")
    assert [r.problem for r in tools.setting_problems(bad).collect()] == ["max_tokens must exceed thinking_budget", "thinking_budget must be at least 1024", None]
    assert [r[0] for r in spark.createDataFrame([("ok-1",), (".x",), ("",), ("a" * 65,)], "n string").select(tools.session_id_ok(F.col("n"))).collect()] == [True, False, False, False]
    rows = spark.createDataFrame([(["q"], 2, [("brave", True, True), ("bing", False, False)])], "queries array<string>, hits int, engines array<struct<engine:string,answered:boolean,cached:boolean>>")
    assert json.loads(tools.search_payload(rows).first().data)["cached"] is True
    events = spark.createDataFrame([("s", 1, "search.started", 1, "{}"), ("s", 2, "fetch.started", 2, "{}"), ("s", 0, "turn.started", 1, '{"final_turn":false}'), ("s", 4, "turn.started", 3, '{"final_turn":true}'), ("s", 3, "session.finished", None, '{"outcome":"ok"}')], "session_id string, seq int, type string, turn int, data string")
    assert [(r.turn, r.searches, r.final, r.outcome) for r in tools.replayed_turns(events).orderBy("turn").collect()] == [(1, 1, False, None), (2, 0, False, None), (3, 0, True, "ok")]
    body = '{"content":[{"type":"text","text":"Hi"},{"type":"tool_use","id":"t","name":"fetch","input":{"url":"u"}}],"stop_reason":"tool_use","usage":{"input_tokens":3,"output_tokens":2,"cache_read_input_tokens":4}}'
    a = spark.createDataFrame([(body,)], "b string").select(replies.anthropic_body(F.col("b")).alias("r")).first().r
    assert (a.output, a.finish_reason, a.usage.prompt_tokens, a.tool_calls[0].arguments, a.error) == ("Hi", "tool_calls", 7, '{"url":"u"}', None)


def test_contained_quotes_of_any_length(spark):
    pages = [(1, "The Quick  brown fox jumps over the lazy dog"), (2, "quickly, the lazy\ndog slept"), (3, ""), (4, None), (5, "a b c d e f")]
    quotes = [(1, "quick"), (2, "the lazy"), (3, "uick brown fo"), (4, "jumps over the lazy"), (5, "k brown fox jumps over the l"), (6, "QUICK"), (7, ""), (8, None), (9, "zebra"), (10, "a b c d e"), (11, "c d"), (12, "dog slept well")]
    found = grounding.contained_quotes(spark.createDataFrame(pages, "page_id long, text string"), spark.createDataFrame(quotes, "quote_id long, quote string")).collect()
    plain = lambda t: " ".join(t.lower().split())
    want = [(i, j) for i, t in pages for j, q in quotes if t and q and plain(q) in plain(t)]
    assert sorted(map(tuple, found)) == sorted(want) and {1, 2, 3, 4, 5, 6, 10, 11} == {j for _, j in want}


def test_replay(spark):
    """The same set of queries answers as recorded; else hits that a query found; else all, those with a page first."""
    searches = spark.createDataFrame([(0, ["A ", "b"]), (1, ["b", "a", "a"]), (2, ["empty"])], "pos long, queries array<string>")
    hits = [(0, i, f"https://h{i}.example/", ["a"] if i % 2 else ["b"]) for i in range(40)] + [(1, 0, "https://h7.example/", ["b"]), (1, 1, "https://late.example/", ["c"])]
    pages = spark.createDataFrame([(True, "h38.example", None), (True, "x.example", "https://late.example/#p"), (False, "h0.example", None)], "is_page boolean, url_key string, final_url string")
    asked = spark.createDataFrame([(1, ["B", "a"], 3), (2, ["b", "z"], 3), (3, ["z"], None), (4, ["c"], 5), (5, ["EMPTY"], 5), (6, ["a", "c", "b", "q"], 99)], "request_id int, queries array<string>, top_k int")
    found = {}
    for r in tape.replay(asked, searches, spark.createDataFrame(hits, "pos long, at long, url string, queries array<string>"), pages).orderBy("request_id", "rank").collect():
        found.setdefault((r.request_id, r.tier), []).append(r.url and r.url[8:-9])
    assert found[1, 1] == [f"h{i}" for i in range(40)]
    assert found[2, 2] == ["h38", "h0", "h2"] and found[4, 2] == ["late"]
    assert found[3, 3] == ["h38", "late", *[f"h{i}" for i in range(13)]] and found[5, 1] == [None]
    assert found[6, 2] == ["h38", "late", *[f"h{i}" for i in range(28)]] and len(found) == 6

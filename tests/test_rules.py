"""Rules on lists of cases, each with what it must give."""

import pytest
from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.functions import urls as U
from tidewell.operators import evals, fetch, history, render, replies, search, tools

NBSP = "\u00a0"
LONG = "word " * 60
CASES = []


def cases(inputs, outputs, rows):
    def add(f):
        CASES.append(pytest.param(f, inputs, outputs, rows, id=f.__name__))
        return f

    return add


@cases("queries array<string>; top_k int", "kept string; n int; error string", [
    ([" a ", "", "b"], None, "a|b", 15, None),
    (["  ", NBSP], 3, "", 3, "empty_query"),
    ([], 3, "", 3, "empty_query"),
    (["x"], 0, "x", 1, None),
    (["x"], 99, "x", 30, None),
    (["1", "2", "3", "4", "5", "6", "7", "8"], 5, "1|2|3|4|5|6|7|8", 5, None),
    (["1", "2", "3", "4", "5", "6", "7", "8", "9"], 5, "1|2|3|4|5|6|7|8|9", 5, "too_many_queries"),
    (["y" * 500], 5, "y" * 500, 5, None),
    (["y" * 501], 5, "y" * 501, 5, "too_many_queries"),
])
def checked_searches(df):
    """PRJ-01: queries are trimmed and counted, top_k is brought into its range."""
    return search.valid_search(df).withColumn("kept", F.array_join("queries", "|")).withColumn("n", F.col("top_k"))


@cases("name string", "ok boolean", [("serde", True), ("A1_b-c", True), ("1password", False), ("", False), ("a" * 64, True), ("a" * 65, False), ("tokio util", False), ("größe", False), ("_x", False)])
def crate_names(df):
    """PRJ-07."""
    return df.withColumn("ok", U.is_crate_name(F.col("name")))


@cases("provider string; status int; body string; final_url string; n_rows int", "error string; detail string", [
    ("duckduckgo", 200, '<div id="links"></div>', "https://a.example/", 0, None, None),
    ("duckduckgo", 200, '<div class="anomaly-modal">', "https://a.example/", 0, "challenge", "bot challenge"),
    ("duckduckgo", 202, "<p>other", "https://a.example/", 0, "upstream", "unrecognized markup"),
    ("bing", 200, '<ol id="b_results">', "https://a.example/", 0, None, None),
    ("bing", 429, "", "https://a.example/", 0, "challenge", "bot challenge"),
    ("bing", 200, "captchaSuccessPostMessage", "https://a.example/", 0, "challenge", "bot challenge"),
    ("brave", 429, "", "https://a.example/", 0, "challenge", "bot challenge"),
    ("brave", 500, '<div id="results">', "https://a.example/", 0, "upstream", "HTTP 500"),
    ("brave", 200, "<p>other", "https://a.example/", 3, None, None),
    ("yahoo", 200, "x", "https://guce.yahoo.com/consent", 0, "challenge", "bot challenge"),
    ("yahoo", 429, "x", "https://a.example/", 0, "upstream", "HTTP 429"),
    ("yahoo", 200, '<div id="results"><p class="zrpmsg">', "https://a.example/", 0, "upstream", "unrecognized markup"),
    ("startpage", 200, "x", "https://www.startpage.com/sp/captcha", 0, "challenge", "bot challenge"),
    ("startpage", 200, "did not match any", "https://a.example/", 0, None, None),
    ("startpage", 200, '<i id="anubis_challenge">', "https://a.example/", 0, "challenge", "bot challenge"),
    ("cratesio", 200, "{}", "https://crates.io/", 0, None, None),
    ("cratesio", 404, "{}", "https://crates.io/", 0, "upstream", "HTTP 404"),
])
def classified_responses(df):
    """PRJ-17, PRJ-18, PRJ-19: walls, result pages of a provider, and what else went wrong."""
    return search.classify(df)


@cases("kind string; detail string; remaining int; reason string; query string; provider string; late boolean", "status int; owner string; leg string; line string; transport string", [
    ("suspended", None, 30, "challenge", "q", "bing", False, 429, "bing", "suspended (challenge), 30s left", "suspended (challenge), 30s left", "upstream"),
    ("timeout", None, 0, None, "rust q", "yahoo", True, 504, "yahoo", "timed out: rust q", "timed out", "timeout"),
    ("empty_query", None, 0, None, "", "yahoo", False, 400, None, "empty query", "empty query", "upstream"),
    ("too_many_queries", "9 > 8", 0, None, "q", "yahoo", False, 400, None, "too many queries: 9 > 8", "too many queries: 9 > 8", "upstream"),
    ("upstream", "HTTP 500", 0, None, "q", "brave", False, 503, "brave", "HTTP 500", "HTTP 500", "upstream"),
    ("challenge", "bot challenge", 0, None, "q", "brave", True, 429, "brave", "bot challenge", "bot challenge", "timeout"),
])
def leg_errors(df):
    """PRJ-20, ADD-02, ADD-03: status, owner and text of errors."""
    kind, text = F.col("kind"), [F.col(c) for c in ("kind", "detail", "remaining", "reason")]
    out = df.withColumn("status", search.error_status(kind)).withColumn("owner", search.error_provider(kind, F.col("provider")))
    out = out.withColumn("leg", search.problem_text(*text, F.col("query"))).withColumn("line", search.problem_text(*text))
    return out.withColumn("transport", search.transport_error(F.col("late"), F.lit("reset"))["kind"])


@cases("ip string", "bad boolean", [
    ("::1", True), ("::", True), ("fe80::1", True), ("fd00::1", True), ("ff02::1", True), ("2001:db8::5", True), ("3fff::1", True), ("2606:4700:4700::1111", False), ("::ffff:10.0.0.1", True),
    ("::ffff:8.8.8.8", False), ("::192.168.0.1", True), ("8.8.8.8", False), ("100.64.0.1", True), ("100.128.0.1", False), ("255.255.255.255", True), ("no address", None), ("2001:db9::1", False),
])
def forbidden_addresses_v6(df):
    """PRJ-12: addresses of both kinds, with IPv4 ones inside IPv6 ones."""
    return df.withColumn("bad", U.forbidden_ip(F.col("ip")))


@cases("href string", "ddg string; bing string; yahoo string; startpage string", [
    ("//duckduckgo.com/l/?uddg=https%3A%2F%2Fa.example%2Fx%3Fy%3D1&rut=z", "https://a.example/x?y=1", None, None, None),
    ("//b.example/p", "https://b.example/p", None, None, None),
    ("https://c.example/q", "https://c.example/q", "https://c.example/q", "https://c.example/q", "https://c.example/q"),
    ("javascript:void(0)", None, None, None, None),
    ("https://www.bing.com/ck/a?!&&p=1&u=a1aHR0cHM6Ly9kLmV4YW1wbGUvP2E9Yg&ntb=1", "https://www.bing.com/ck/a?!&&p=1&u=a1aHR0cHM6Ly9kLmV4YW1wbGUvP2E9Yg&ntb=1", "https://d.example/?a=b", "https://www.bing.com/ck/a?!&&p=1&u=a1aHR0cHM6Ly9kLmV4YW1wbGUvP2E9Yg&ntb=1", "https://www.bing.com/ck/a?!&&p=1&u=a1aHR0cHM6Ly9kLmV4YW1wbGUvP2E9Yg&ntb=1"),
    ("https://r.search.yahoo.com/_ylt=A/RV=2/RE=1/RO=10/RU=https%3a%2f%2fe.example%2fw/RK=2/RS=s-", "https://r.search.yahoo.com/_ylt=A/RV=2/RE=1/RO=10/RU=https%3a%2f%2fe.example%2fw/RK=2/RS=s-", "https://r.search.yahoo.com/_ylt=A/RV=2/RE=1/RO=10/RU=https%3a%2f%2fe.example%2fw/RK=2/RS=s-", "https://e.example/w", "https://r.search.yahoo.com/_ylt=A/RV=2/RE=1/RO=10/RU=https%3a%2f%2fe.example%2fw/RK=2/RS=s-"),
    (" https://www.startpage.com/do/x ", "https://www.startpage.com/do/x", "https://www.startpage.com/do/x", "https://www.startpage.com/do/x", None),
    ("https://r.search.yahoo.com/none", "https://r.search.yahoo.com/none", "https://r.search.yahoo.com/none", None, "https://r.search.yahoo.com/none"),
])
def unwrapped_links(df):
    """TXT-12, TXT-13, TXT-14, TXT-15: targets behind the links of four engines."""
    h = F.col("href")
    return df.withColumn("ddg", U.unwrap_duckduckgo(h)).withColumn("bing", U.unwrap_bing(h)).withColumn("yahoo", U.unwrap_yahoo(h)).withColumn("startpage", U.clean_startpage(h))


@cases("html string", "text string", [
    ("<p>a <b>b</b></p>  c", "a b c"), ("x &amp;lt; y", "x &lt; y"), ("&#65;&#x42;&#X43;", "ABC"), ("&quot;q&quot;&nbsp;&apos;r&apos;", "\"q\" 'r'"), ("1 > 0 < open", "1 0"), ("&unknown; &;", "&unknown; &;"), ("&#xD800; &#1114112;", "&#xD800; &#1114112;"),
    ("a & b; &lt", "a & b; &lt"), ("", ""), (None, None), ("&" + "x" * 40 + "; &gt;", "&" + "x" * 40 + "; >"), ("<a href='x>y'>z", "y'z"),
])
def fragment_texts(df):
    """TXT-05, TXT-06, TXT-07: tags out, entities decoded."""
    return df.withColumn("text", T.decode_html(F.col("html")))


@cases("status int; content_type string; body string; markdown string; cf_mitigated string", "outcome string; reason string", [
    (200, "text/html; charset=utf-8", "<p>x", LONG, None, "done", None),
    (200, None, "<p>x", LONG, None, "done", None),
    (200, "TEXT/PLAIN", LONG, None, None, "done", None),
    (200, "application/json", LONG, None, None, "done", None),
    (200, "text/html", "<p>x", "short", None, "handover", "only 5 chars of markdown (JS shell?)"),
    (200, "text/html", "<title>Just a moment...</title>", LONG, None, "handover", "challenge page"),
    (200, "text/html", "<p>x", LONG + "performing security verification", None, "handover", "challenge page"),
    (200, "image/png", "x", None, None, "handover", "unsupported content type image/png"),
    (403, "text/html", "<p>x", LONG, "challenge", "handover", "HTTP 403"),
    (429, "text/html", "<p>x", LONG, None, "error", "HTTP 429"),
    (503, "text/html", "cf-chl-x", LONG, None, "handover", "HTTP 503"),
    (404, "text/html", "cf-chl-x", LONG, None, "error", "HTTP 404"),
])
def fetch_decisions(df):
    """PRJ-22: a page is done, an error, or handed over to a browser."""
    return fetch.fetch_outcome(df)


@cases("status int; retry_after int; body string", "kind string; retryable boolean; wait int; detail string", [
    (200, None, "{}", None, None, None, "{}"), (401, None, '{"error": {"message": "no key"}}', "unauthorized", False, None, "no key"), (403, 5, '{"message": "no"}', "forbidden", False, None, "no"), (429, 7, "slow down", "rate_limited", True, 7, "slow down"),
    (500, 9, "", "server", True, None, ""), (501, None, "x", "server", False, None, "x"), (503, 11, "x", "server", True, 11, "x"), (505, 3, "x", "server", False, None, "x"), (529, 4, "x" * 400, "server", True, 4, "x" * 300), (422, None, '{"error": "e"}', "rejected", False, None, '{"error": "e"}'), (302, None, "x", "redirect", False, None, "x"),
])
def gateway_errors(df):
    """PRJ-24, ADD-04, FN-10: errors of a gateway by status."""
    e = replies.http_error(F.col("status"), F.col("retry_after"))
    return df.withColumn("kind", e["kind"]).withColumn("retryable", e["retryable"]).withColumn("wait", e["retry_after"]).withColumn("detail", replies.error_detail(F.col("body")))


@cases("header string", "seconds long", [("120", 120), (" 7 ", 7), ("Wed, 03 Jan 2024 00:01:30 GMT", 90), ("Tue, 02 Jan 2024 23:59:00 GMT", 0), ("soon", None), (None, None), ("0", 0), ("-5", None), ("+5", 5), ("Wed, 33 Foo 2024 00:00:00 GMT", None), (" Wed, 03 Jan 2024 00:00:01 GMT ", 1)])
def retry_headers(df):
    """FN-02: Retry-After as a number or a date."""
    return df.withColumn("seconds", replies.retry_after_seconds(F.col("header"), F.lit("2024-01-03 00:00:00").cast("timestamp")))


@cases("kind string", "is_stream boolean", [("text/event-stream", True), ("Text/Event-Stream; charset=utf-8", True), ("text/plain", False), ("application/json; x=text/event-stream", False), (" text/event-stream ;a", True)])
def stream_types(df):
    """SRC-14."""
    return df.withColumn("is_stream", replies.is_event_stream(F.col("kind")))


@cases("body string", "events string", [
    ("data: a\n\ndata: b\n\n", "a|b"), ("data:a\r\ndata: b\r\n\r\n", "a\nb"), (": ping\n\nevent: x\ndata: y\n\n", "y"), ("data: whole\n\ndata: cut", "whole"), ("data\n\n", ""), ("data:  two spaces\n\n", " two spaces"), ("", ""), ("id: 4\nretry: 5\n\n", ""),
])
def framed_events(df):
    """SRC-13: event streams with comments, other fields and cut ends."""
    return df.withColumn("events", F.array_join(replies.sse_events(F.col("body")), "|"))


@cases("stop string", "reason string", [("end_turn", "stop"), ("stop_sequence", "stop"), ("max_tokens", "length"), ("tool_use", "tool_calls"), ("refusal", "content_filter"), ("pause_turn", "pause_turn"), (None, None)])
def finish_reasons(df):
    """PRJ-38."""
    return df.withColumn("reason", replies.finish_reason(F.col("stop")))


@cases("openai string; anthropic string", "out string; thought string; reason string; calls int; cached long; error string; out2 string; reason2 string; prompt2 long; args2 string; error2 string", [
    ('{"choices":[{"message":{"content":"hi","reasoning_content":"hm"},"finish_reason":"stop"}],"usage":{"prompt_tokens":9,"prompt_cache_hit_tokens":3,"prompt_tokens_details":{"cached_tokens":5}}}',
     '{"content":[{"type":"thinking","thinking":"t"},{"type":"text","text":"a"},{"type":"text","text":"b"}],"stop_reason":"end_turn","usage":{"input_tokens":4,"cache_read_input_tokens":2,"cache_creation_input_tokens":1,"output_tokens":7}}',
     "hi", "hm", "stop", None, 5, None, "ab", "stop", 7, None, None),
    ('{"choices":[{"message":{"content":null,"tool_calls":[{"id":"c","function":{"name":"f","arguments":"{}"}}]},"finish_reason":"tool_calls"}]}', '{"content":[{"type":"tool_use","id":"u","name":"g","input":{"q":[1]}}],"stop_reason":"tool_use","usage":{"input_tokens":1}}',
     None, None, "tool_calls", 1, 0, None, "", "tool_calls", 1, '{"q":[1]}', None),
    ('{"error":{"message":"bad"}}', '{"error":{"message":"worse"}}', None, None, None, None, 0, "bad", None, None, 0, None, "worse"),
    ('{"choices":[]}', '{"content":[],"stop_reason":"refusal"}', None, None, None, None, 0, "no choices", "", "content_filter", 0, None, "refused"),
    ('{"choices":[{"message":{"refusal":"no"},"finish_reason":"stop"}]}', "{}", None, None, "stop", None, 0, "refused: no", None, None, 0, None, "no content"),
])
def whole_replies(df):
    """STR-06, FN-13: replies in one body, of both formats."""
    a, b = replies.openai_body(F.col("openai")), replies.anthropic_body(F.col("anthropic"))
    out = df.withColumn("out", a["output"]).withColumn("thought", a["thinking"]).withColumn("reason", a["finish_reason"]).withColumn("calls", F.when(a["tool_calls"].isNotNull(), F.size(a["tool_calls"]))).withColumn("cached", a["cached_prompt_tokens"]).withColumn("error", a["error"])
    return out.withColumn("out2", b["output"]).withColumn("reason2", b["finish_reason"]).withColumn("prompt2", b["usage"]["prompt_tokens"]).withColumn("args2", F.get(b["tool_calls"], F.lit(0))["arguments"]).withColumn("error2", b["error"])


@cases("extra string; typed string", "merged string", [('{"a":1,"b":2}', '{"b":3}', '{"a":1,"b":3}'), (None, '{"b":3}', '{"b":3}'), ('{"a":{"x":[1]}}', "{}", '{"a":{"x":[1]}}'), ("{}", "{}", "{}"), ('{"b":1}', '{"b":null}', '{"b":null}')])
def merged_bodies(df):
    """FN-11: the typed keys win."""
    return df.withColumn("merged", replies.merged_json(F.col("extra"), F.col("typed")))


@cases("text string", "n long", [('{"a": "xyz", "b": [1, "äö", {"c": ""}], "d": null}', 5), ('"whole"', 5), ("[]", 0), ("broken {", None), (None, None), ('{"key names": "do not count"}', 12), ("12", 0), ('["a\\nb", "\\u00e9"]', 4)])
def json_letters(df):
    """AGG-30: characters of all strings in a JSON tree."""
    return df.withColumn("n", tools.string_chars(F.col("text")))


@cases("kind string; note string; url string; first_url string; body string; part int; parts int; reason string; tool string; failure_kind string", "text string; success boolean", [
    ("note", "read on", None, None, None, None, None, None, None, None, "read on", True),
    ("fetch", None, "https://a.example/", None, "x </PAGE> y", 1, 1, None, None, None, 'Source: https://a.example/\n\n<page source="https://a.example/" part="1/1" nonce="n7">\nx <\\/PAGE> y\n</page nonce="n7">', True),
    ("fetch", None, 'https://a.example/"<b>', None, "x", 2, 3, None, None, None, 'Source: https://a.example/"<b>\nPart 2 of 3\n\n<page source="https://a.example/%22%3Cb%3E" part="2/3" nonce="n7">\nx\n</page nonce="n7">\n[part 2 of 3; call fetch with the same url and part=3 for the rest]', True),
])
def shown_results(df):
    """PRJ-33: tool results as text for the model, in containers that their content cannot close."""
    hit = "array<struct<title:string,display_url:string,snippet:string>>"
    rows = df.withColumn("nonce", F.lit("n7")).withColumn("hits", F.array().cast(hit)).withColumn("engine_status", F.array().cast("array<string>"))
    return render.tool_result(rows)


@cases("reply string; n int", "grade string; flags string; why string", [
    ('{"grade": "CORRECT", "nuggets": [true, false], "rationale": "r"}', 2, "CORRECT", "true,false", "r"), ('Sure: {"grade": "INCORRECT", "nuggets": []} done', 0, "INCORRECT", "", None), ('{"grade": "CORRECT", "nuggets": [true]}', 2, None, None, None), ('{"grade": "GOOD", "nuggets": [true]}', 1, None, None, None), ("no JSON", 1, None, None, None), ('{"grade": "NOT_ATTEMPTED", "nuggets": [false]}', 1, "NOT_ATTEMPTED", "false", None),
])
def judged_replies(df):
    """PRJ-27."""
    j = evals.judge_reply(F.col("reply"), F.col("n"))
    return df.withColumn("grade", j["grade"]).withColumn("flags", F.array_join(j["nuggets"].cast("array<string>"), ",")).withColumn("why", j["rationale"])


@cases("outcome string; log_failed boolean; blocked boolean; evidence int; had_hits boolean", "final string; exit_code int", [
    ("ok", False, False, 3, True, "ok", 0), ("ok", True, True, 0, False, "session_io", 6), ("ok", False, True, 0, False, "search_blocked", 7), ("ok", False, True, 0, True, "ok", 0), ("ok", False, True, 2, False, "ok", 0), ("interrupted", True, True, 0, False, "interrupted", 130),
    ("deadline_exceeded", False, False, 0, False, "deadline_exceeded", 9), ("gateway_exhausted", False, False, 0, False, "gateway_exhausted", 3), ("odd", False, False, 0, False, "odd", 1), ("budget_exhausted", False, False, 0, False, "budget_exhausted", 5),
])
def closed_runs(df):
    """PRJ-23, ADD-12, STR-18: outcomes and exit codes of runs."""
    return history.close_sessions(df).withColumn("final", F.col("outcome"))


@cases("causes array<string>", "kind string", [(["send", "Egress denied for 10.0.0.1"], "egress_denied"), (["send", "operation timed out"], "timeout"), (["Timeout", "egress denied"], "egress_denied"), (["connection reset"], "http"), ([], "http")])
def request_failures(df):
    """ADD-27."""
    return df.withColumn("kind", fetch.static_error(F.col("causes")))


@pytest.mark.parametrize(("f", "inputs", "outputs", "rows"), CASES)
def test_rule(spark, f, inputs, outputs, rows):
    given, wanted = ([x.strip() for x in c.split(";")] for c in (inputs, outputs))
    n = len(given)
    frame = spark.createDataFrame([(i, *r[:n]) for i, r in enumerate(rows)], ", ".join(["event_id long", *given]))
    out = f(frame).select("event_id", *[F.col(name).cast(kind) for name, kind in (w.split(" ", 1) for w in wanted)]).orderBy("event_id")
    assert [tuple(r)[1:] for r in out.collect()] == [tuple(r[n:]) for r in rows]

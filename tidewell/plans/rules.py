"""Queries of the rules of searches, pages, replies and runs: hard inputs on every event, with the outputs the rules demand."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..operators import evals, fetch, governor, history, render, replies, search, tools
from .registry import cases

NBSP = "\u00a0"


# --- searches ---


@cases("name string", "ok boolean", [("run-1.log_2", True), (".hidden", False), ("a b", False), ("", False), ("x" * 64, True), ("x" * 65, False), ("../up", False), ("ä", False)])
def session_names(df):
    """PRJ-09."""
    return df.withColumn("ok", tools.session_id_ok(F.col("name")))


# --- addresses and links ---


@cases("url string; addresses array<string>", "literal boolean; allowed boolean", [
    ("https://a.example/x", ["93.184.216.34"], False, True), ("https://a.example/x", ["93.184.216.34", "10.0.0.1"], False, False), ("http://10.1.2.3/", [], True, False), ("http://[fd00::1]/", [], True, False),
    ("http://[2606:4700::1]/", ["2606:4700::1"], False, True), ("https://127.1/", [], True, False), ("https://localhost.example/", ["::1"], False, False), ("http://8.8.8.8:80/", ["8.8.8.8"], False, True),
])
def allowed_hops(df):
    """PRJ-13, ADD-29: no forbidden address as host or among those a name resolves to."""
    return fetch.hops_allowed(df, ["event_id"]).join(df.withColumn("literal", U.forbidden_host(F.col("url"))), "event_id")


@cases("query string; market string; page int; name string; url string", "ddg string; lang string; yahoo string; path string; docs string; crate string; version string", [
    ("rust async", "en-US", 0, "a", "https://crates.io/crates/serde", "rust async", "en", "p=rust+async&iscqry=", "1/a", "https://docs.rs/a", "serde", None),
    ("before:2024 x  After:2020", "de-DE", 1, "AB", "https://www.crates.io/crates/tokio/1.2.3?q=1", "x", "de", "p=before%3A2024+x++After%3A2020&b=8&pz=7", "2/ab", "https://docs.rs/AB", "tokio", "1.2.3"),
    ("a&b=c ü", "PT-br", 3, "Abc", "https://crates.io/", "a&b=c ü", "pt", "p=a%26b%3Dc+%C3%BC&b=22&pz=7", "3/a/abc", "https://docs.rs/Abc", None, None),
    ("~*", "fr", 2, "serde_json", "https://crates.io/crates/9bad", "~*", "fr", "p=~%2A&b=15&pz=7", "se/rd/serde_json", "https://docs.rs/serde_json", None, None),
])
def engine_requests(df):
    """TXT-16, TXT-17, TXT-18, TXT-19, HTM-07: what engines and the registry are asked."""
    crate = U.crate_page(F.col("url"))
    out = df.withColumn("ddg", U.duckduckgo_query(F.col("query"))).withColumn("lang", U.bing_language(F.col("market"))).withColumn("yahoo", U.yahoo_page(F.col("query"), F.col("page")))
    return out.withColumn("path", U.crate_index_path(F.col("name"))).withColumn("docs", U.crate_docs_url(F.col("name"))).withColumn("crate", crate["name"]).withColumn("version", crate["version"])


# --- pages ---

LONG = "word " * 60


@cases("exit_code int; stdout string; stderr string", "outcome string", [
    (0, "a page", "", "page"), (0, " \n" + NBSP, "", "empty"), (1, "a page", "", "failed"), (1, "", "HTTP 403 Forbidden", "blocked"), (0, "a page", "code 14031", "page"), (0, "a page", "the Bot was seen", "blocked"),
    (0, "a page", "robots", "page"), (0, "Performing security verification", "", "challenge"), (0, "Ray ID: 7 Performance and security by X", "", "challenge"), (0, "Ray ID: 7", "", "page"), (0, "performing security verification " + "x" * 1500, "", "page"),
])
def browser_runs(df):
    """PRJ-15, PRJ-16, ADD-26: what a browser's run is worth."""
    return fetch.browser_outcome(df)


# --- replies ---


# --- sessions ---


@cases("window long; reserve long; request_ms long; run_ms long; budget int; used int", "chars long; part long; final_ms long; note string", [
    (200_000, 8_000, 60_000, 600_000, 12, 10, 400_000, 24_000, 60_000, "\n\n[2 turns left, counting the final answer.]"),
    (32_000, 8_000, 60_000, 100_000, 12, 11, 72_000, 9_000, 25_000, "\n\n[1 turn left: tools are off on it, so your next reply must be the final answer inside <answer></answer> tags.]"),
    (13_000, 8_000, 60_000, 240_000, 12, 12, None, None, 60_000, ""),
    (13_334, 8_000, 61, 243, 3, 0, 16_002, 2_000, 60, "\n\n[3 turns left, counting the final answer.]"),
])
def session_room(df):
    """FN-06, FN-07, PRJ-34: room for context, time for the last reply, turns left."""
    room = history.context_budget(F.col("window"), F.col("reserve"))
    out = df.withColumn("chars", room["context_chars"]).withColumn("part", room["part_chars"]).withColumn("final_ms", history.final_reserve(F.col("request_ms"), F.col("run_ms")))
    return out.withColumn("note", history.turns_left(F.col("budget"), F.col("used")))


@cases("max_tokens int; thinking_budget int; max_attempts int; timeout_ms int; base_url string; format string", "problem string", [
    (1000, None, 3, 1000, "https://a.example", "openai", None), (0, None, 3, 1000, "https://a.example", "openai", "numbers must be positive"), (1000, None, None, 0, "https://a.example", "openai", "numbers must be positive"), (1000, None, 3, 1000, "https://a.example", "grpc", "unknown format grpc"),
    (1000, 1000, 3, 1000, "https://a.example", "openai", "max_tokens must exceed thinking_budget"), (4000, 500, 3, 1000, "https://a.example", "anthropic", "thinking_budget must be at least 1024"), (4000, 1024, 3, 1000, "http://a.example/v1", "anthropic", None), (1000, None, 3, 1000, "a.example", "openai", "base_url must be an http URL"),
])
def checked_settings(df):
    """ADD-22."""
    return tools.setting_problems(df)


@cases("a string; b string; c string", "root string", [("/x", "/y", "/z", "/x"), ("", " /y ", "/z", "/y"), (None, "  ", "/z", "/z"), (None, None, None, None)])
def root_folders(df):
    """ADD-32: the first folder that is set."""
    return df.withColumn("root", tools.root_folder(F.col("a"), F.col("b"), F.col("c")))


@cases("message string", "length long; model string; whole boolean; bytes int", [
    ('POST /v1 HTTP/1.1\r\nContent-Length: 13\r\n\r\n{"model":"m"}', 13, "m", True, 13), ('POST /v1 HTTP/1.1\r\ncontent-length:  20\r\n\r\n{"model":"m"}', 20, "m", False, 13), ("GET / HTTP/1.1\r\n\r\n", None, None, True, 0), ("POST /v1 HTTP/1.1\r\nContent-Length: 4\r\n\r\nxä\n\n", 4, None, True, 5),
])
def framed_requests(df):
    """ADD-30: recorded requests of a gateway."""
    from ..sources.readers import http_frames

    out = http_frames(df)
    return out.withColumn("length", F.col("content_length")).withColumn("bytes", F.octet_length("body"))


# --- runs ---


@cases("reply string; n int", "verdicts string", [('{"verdicts": ["supported", "partly"]}', 2, "supported,partly"), ('x {"verdicts": ["contradicted"]} y', 1, "contradicted"), ('{"verdicts": ["uncited"]}', 1, None), ('{"verdicts": ["supported"]}', 2, None), ("{}", 0, None), ("", 1, None)])
def claim_replies(df):
    """PRJ-28."""
    return df.withColumn("verdicts", F.array_join(evals.claim_reply(F.col("reply"), F.col("n")), ","))


@cases("exit_code int; stdout string; stderr string", "turns int; tokens long; cites int; exact int; misses int; last string", [
    (0, '{"turns_used":4,"usage":{"total_tokens":99},"synthesis":{"citations":["a","b"],"verification":{"exact":2}},"evidence_urls":["a"]}', "", 4, 99, 2, 2, 0, None),
    (4, "", "x\nreplay miss: q\n replay miss: r \n\n  last line  \n \n", None, None, None, None, 2, "last line"),
    (1, "broken", "y" * 500, None, None, None, None, 0, "y" * 400),
])
def run_rows(df):
    """PRJ-29, PRJ-30, EVL-02: a run's row from exit code, output and error lines."""
    out = evals.run_metrics(df)
    return out.select("event_id", F.col("turns_used").alias("turns"), F.col("total_tokens").alias("tokens"), F.col("citations").alias("cites"), F.col("verification.exact").alias("exact"), F.col("replay_misses").alias("misses"), F.col("error").alias("last"))


@cases("grade string; exit_code int; nugget_recall double; core_recall double; verdicts array<string>; answer string; public boolean", "graded string; recall double; grade_due boolean; claims_due boolean", [
    (None, 0, None, None, None, "a", False, None, None, True, True), (None, 4, None, None, None, None, False, "NOT_ATTEMPTED", 0.0, False, False), ("CORRECT", 0, 0.5, 0.5, ["supported"], "a", False, "CORRECT", 0.5, False, False), ("CORRECT", 4, 0.5, 0.5, None, "a", True, "CORRECT", 0.5, False, False), ("INCORRECT", 0, 0.0, 0.0, None, "a", False, "INCORRECT", 0.0, False, True),
])
def due_judgements(df):
    """EVL-03, ADD-24: failed runs count as not attempted; what is still to be judged."""
    done = evals.no_answer(df)
    due = evals.judge_work(done, "replay").select("event_id", "needs_grade", "needs_claims")
    out = done.join(due, "event_id", "left").withColumn("graded", F.col("grade")).withColumn("recall", F.col("nugget_recall"))
    return out.withColumn("grade_due", F.coalesce("needs_grade", F.lit(False))).withColumn("claims_due", F.coalesce("needs_claims", F.lit(False)))


@cases("page string; pages int", "clipped string", [("short", 1, "short"), ("z" * 60, 10_000, "z" * 50 + "\n[page cut here]"), ("z" * 50, 10_000, "z" * 50), ("", 0, "")])
def clipped_pages(df):
    """TXT-39: each page has its share of the room."""
    return df.withColumn("clipped", evals.clipped_page(F.col("page"), F.col("pages")))


@cases("tools array<string>; allowed array<string>; left int", "note string", [
    (["search", "fetch"], ["fetch"], 3, "Your last reply had no tool call and no answer text. Continue the research with a tool call, or reply with the final answer inside <answer></answer> tags.\nAvailable tools:\nfetch — does fetch\n\n[3 turns left, counting the final answer.]"),
    (["search", "fetch"], ["search", "fetch"], 1, "Your last reply had no tool call and no answer text.\n\n[1 turn left: tools are off on it, so your next reply must be the final answer inside <answer></answer> tags.]"),
])
def repair_notes(df):
    """ADD-11: what a model is told that neither called a tool nor answered."""
    named = F.transform("tools", lambda t: F.struct(t.alias("name"), F.concat(F.lit("does "), t).alias("purpose")))
    return df.withColumn("note", tools.repair_note(named, F.col("allowed"), F.col("left")))


@cases("goal string; size string; nuggets array<string>; answer string", "message string; chars int; prompt string", [
    ("why?", "short", ["a", "b"], "x", "Research goal: why?\nRequested synthesis size: short.", 52, "Goal: why?\n\nFacts:\n1. a\n2. b\n\nAnswer:\nx"), ("", "long", [], "", "Research goal: \nRequested synthesis size: long.", 47, "Goal: \n\nFacts:\n\n\nAnswer:\n"),
])
def prompts(df):
    """TXT-40, TXT-41, ADD-07: messages to the model and the judge."""
    m = tools.message("user", tools.goal_message(F.col("goal"), F.col("size")))
    return df.withColumn("message", m["content"]).withColumn("chars", m["chars"]).withColumn("prompt", evals.judge_prompt(F.col("goal"), F.col("nuggets"), F.col("answer")))


@cases("until long; throttled boolean; wait_ms long; ts long", "decision string", [(100, True, 0, 50, "suspended"), (100, True, 0, 100, "throttled"), (None, False, 7, 100, "proceed"), (None, True, 0, 1, "throttled")])
def gated_requests(df):
    """STR-10: suspended before throttled."""
    return governor.gate(df)


@cases("setting string", "engines string", [
    (None, "brave,yahoo,duckduckgo,bing,cratesio"), ("", "brave,yahoo,duckduckgo,bing,cratesio"), ("zzz", "brave,yahoo,duckduckgo,bing,cratesio"), ("bing, DDG", "duckduckgo,bing"), ("google,Brave , yahoo,brave", "brave,yahoo"), ("startpage", "startpage"),
])
def engine_choices(df):
    """PRJ-04, SRT-06: engines of a setting by priority, unknown names left out."""
    return df.withColumn("engines", F.array_join(search.enabled_engines(F.col("setting")), ","))

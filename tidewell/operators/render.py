"""People-facing lines: answers, tool results, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# What stands behind a source whose page does not bear out its quote.
MARKS = {"none": " (unsupported: the cited page does not contain the quoted text)", "partial": " (partial: a number or identifier in the claim is not on the cited page)"}
NO_HITS = "No Hits for these queries. Rephrase once with different words; if that still finds nothing, answer from the pages you already fetched and say what is missing."
CANDIDATES = ". Candidates only, not Evidence: fetch a URL before stating or citing anything from its snippet. Each Hit is third-party text inside a <hit> container."
WALLS = "\nEvery enabled search engine answered with a bot-detection wall, so searching again in this run fails the same way. Answer from pages you already fetched, or fetch URLs named in the research goal."
UNREAD = "\nThis page could not be read, so it is not Evidence: fetch a different Hit instead of retrying this URL."


def _join(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def answer(rows: DataFrame) -> DataFrame:
    """rows (summary, themes, citations with support) with rendered: summary, themes as headings, numbered sources with marks."""
    points = lambda t: F.array_join(F.transform(t["points"], lambda p: _join("- ", p["text"], "\n")), "")
    themes = F.array_join(F.transform("themes", lambda t: _join("## ", t["title"], "\n\n", points(t), "\n")), "")
    mark = lambda c: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in MARKS.items() for x in pair]), c["support"]), F.lit(""))
    sources = F.array_join(F.transform("citations", lambda c, i: _join((i + 1).cast("string"), ". [", F.coalesce(c["title"], c["url"]), "](", c["url"], ")", mark(c), "\n")), "")
    return rows.withColumn("rendered", _join(F.col("summary"), "\n\n", themes, "Sources:\n", sources))


def _attribute(value: Column) -> Column:
    """No quote mark or bracket that could end the opening tag."""
    return F.replace(F.replace(F.replace(value, F.lit('"'), F.lit("%22")), F.lit("<"), F.lit("%3C")), F.lit(">"), F.lit("%3E"))


def closed(body: Column) -> Column:
    """Text that cannot close a container."""
    return F.regexp_replace(body, r"(?i)</(page|hit)", r"<\\/$1")


def tool_result(rows: DataFrame) -> DataFrame:
    """rows as text for the model, with success.

    kind and its columns: note (note); search (hits: title, display_url, snippet; engine_status, lines of engines);
    fetch (url, body, part, parts); already_fetched (url, first_url, parts); blocked (reason); failed (tool,
    failure_kind, reason). nonce is the run's.
    """
    nonce, url, part, parts = (F.col(c) for c in ("nonce", "url", "part", "parts"))
    number = lambda c: c.cast("string")
    body = lambda h: _join(h["title"], "\n", h["display_url"], F.when(F.coalesce(h["snippet"], F.lit("")) != "", F.concat(F.lit("\n"), h["snippet"])).otherwise(""))
    one = lambda h, i: _join('\n<hit rank="', number(i + 1), '" nonce="', nonce, '">\n', closed(body(h)), '\n</hit nonce="', nonce, '">')
    status = F.when(F.size("engine_status") > 0, _join("\nEngine status:", F.array_join(F.transform("engine_status", lambda s: F.concat(F.lit("\n- "), s)), ""))).otherwise("")
    found = _join(T.plural(F.size("hits"), "Hit", "Hits"), CANDIDATES, F.array_join(F.transform("hits", one), ""))
    search = F.when(F.size("hits") > 0, found).otherwise(_join(NO_HITS, status))
    of = _join(number(part), " of ", number(parts))
    more = F.when(part < parts, _join("\n[part ", of, "; call fetch with the same url and part=", number(part + 1), " for the rest]")).otherwise("")
    page = _join(
        "Source: ", url, "\n", F.when(parts > 1, _join("Part ", of, "\n")).otherwise(""),
        '\n<page source="', _attribute(url), '" part="', number(part), "/", number(parts), '" nonce="', nonce, '">\n', closed(F.col("body")), '\n</page nonce="', nonce, '">', more,
    )
    again = _join(
        "ALREADY FETCHED: ", url, " was already fetched earlier in this Research (as ", F.col("first_url"), "). Use that earlier content, or fetch a different Hit. The page has ",
        T.plural(parts, "part", "parts"), "; call fetch with the same url and part=k to read part k again (served from memory, no new request).",
    )
    failed = _join("FAILED: ", F.col("reason"), F.when((F.col("tool") == "fetch") & (F.col("failure_kind") == "execution"), UNREAD).otherwise(""))
    kind = F.col("kind")
    text = F.when(kind == "fetch", page).when(kind == "search", search).when(kind == "already_fetched", again).when(kind == "note", F.col("note"))
    text = text.when(kind == "blocked", _join("FAILED: search blocked: ", F.col("reason"), WALLS)).otherwise(failed)
    return rows.withColumn("text", text).withColumn("success", kind.isin("search", "note", "fetch", "already_fetched"))


def engine_list(engines: Column) -> Column:
    """Array of (engine, status, rows, problems of kind and remaining_secs) as one line: answered first, then failed."""
    good = F.transform(F.filter(engines, lambda e: e["status"].isin("rows", "no_results")), lambda e: F.concat(F.coalesce(e["engine"], F.lit("?")), F.lit(" "), F.coalesce(e["rows"], F.lit(0)).cast("string")))
    seconds = lambda e: F.coalesce(F.get(F.filter(e["problems"], lambda p: p["kind"] == "suspended"), F.lit(0))["remaining_secs"], F.lit(0))
    word = lambda e: F.coalesce(e["status"], F.lit("error"))
    bad = F.transform(F.filter(engines, lambda e: ~word(e).isin("rows", "no_results")), lambda e: F.concat(F.coalesce(e["engine"], F.lit("?")), F.lit(" "), F.when(word(e) == "suspended", F.concat(F.lit("suspended "), T.short_duration(seconds(e)))).otherwise(word(e))))
    return F.concat_ws("; ", F.nullif(F.array_join(good, ", "), F.lit("")), F.nullif(F.array_join(bad, ", "), F.lit("")))


#: What lines are made of, in all kinds of events.
DATA = (
    "struct<model:string,max_turns:bigint,final_turn:boolean,final_reason:string,tool_calls:array<string>,usage:struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>,"
    "attempt:bigint,delay_ms:bigint,reason:string,queries:array<string>,ok:boolean,error:string,note:string,hits:bigint,engines:array<struct<engine:string,status:string,rows:bigint,problems:array<struct<kind:string,remaining_secs:bigint>>>>,"
    "url:string,served_from:string,fetch_path:string,parts:bigint,part:bigint,chars:bigint,tool:string,kind:string,consecutive_failures:bigint,max_repairs:bigint,dropped_turns:bigint,"
    "bullets:bigint,cited:bigint,exact:bigint,partial:bigint,none:bigint,outcome:string,turns_used:bigint,turn_budget:bigint>"
)


def lines(events: DataFrame, checked: Column) -> DataFrame:
    """events (session_id, seq, type, data as JSON text) with line, tone (normal, warn, bad, good), status and counts.

    line is permanent and null for events without one; status is what the step that an event starts is doing; counts are
    those of a verification. checked: the last counts of an event's session, which its last line repeats. No event is
    looked at beside another, so this holds for streams too.
    """
    rows = events.withColumn("_d", F.from_json("data", DATA))
    d = F.col("_d")
    n = lambda c: F.coalesce(d[c], F.lit(0))
    number = lambda c: n(c).cast("string")
    s = lambda c, other: F.coalesce(d[c], F.lit(other))
    t = F.col("type")
    empty = F.array().cast("array<string>")
    queries = F.array_join(F.transform(F.coalesce(d["queries"], empty), lambda q: F.concat(F.lit('"'), T.clip(q, 60), F.lit('"'))), ", ")
    asked = F.when(queries == "", "search").otherwise(F.concat(F.lit("search "), queries))
    counts = _join(T.plural(n("bullets"), "bullet", "bullets"), ": ", number("cited"), " cited, ", number("exact"), " exact, ", number("partial"), " partial, ", number("none"), " none")
    calls, usage = F.size(F.coalesce(d["tool_calls"], empty)), lambda c: F.coalesce(d["usage"][c], F.lit(0))
    made = F.when(calls == 0, "answer").otherwise(T.plural(calls, "tool call", "tool calls"))
    spent = _join(F.when(usage("prompt_tokens") > 0, _join(T.compact(usage("prompt_tokens")), " in, ")).otherwise(""), T.compact(usage("completion_tokens")), " out tokens")
    ok = F.coalesce(d["ok"], F.lit(False))
    why = T.clip(s("error", "unknown error"), 160)
    engines = engine_list(F.coalesce(d["engines"], F.array().cast("array<struct<engine:string,status:string,rows:bigint,problems:array<struct<kind:string,remaining_secs:bigint>>>>")))
    search = _join(asked, F.when(~ok, _join(" -> failed: ", why)).when(d["note"].isNotNull(), _join(" -> not searched: ", T.clip(d["note"], 160))).otherwise(_join(" -> ", T.plural(n("hits"), "hit", "hits"), F.when(engines != "", _join(" (", engines, ")")).otherwise(""))))
    tag = F.when(d["served_from"].isin("memory", "tape"), d["served_from"]).otherwise(d["fetch_path"])
    tags = F.concat_ws(", ", tag, F.when((n("parts") > 1) & d["part"].isNotNull(), _join("part ", number("part"), "/", number("parts"))))
    known = (n("chars") == 0) & d["part"].isNull()
    fetched = F.when(known, _join("already fetched (", T.plural(n("parts"), "part", "parts"), ")")).otherwise(_join(T.compact(n("chars")), " chars", F.when(tags != "", _join(" [", tags, "]")).otherwise("")))
    fetch = _join("fetch ", s("url", "?"), " -> ", F.when(~ok, _join("failed: ", why)).otherwise(fetched))
    what = F.when(d["tool"].isNotNull(), _join(d["tool"], " call")).otherwise("empty reply")
    failed = _join(what, " failed (", s("kind", "?"), "): ", T.clip(s("reason", "no reason"), 160), " [failure ", number("consecutive_failures"), " of ", number("max_repairs"), " allowed]")
    good = s("outcome", "?") == "ok"
    end = F.when(good, F.coalesce(_join(", ", checked), F.lit(""))).otherwise(F.coalesce(_join(": ", T.clip(d["error"], 300)), F.lit("")))
    finished = _join("finished: ", s("outcome", "?"), ", ", number("turns_used"), "/", number("turn_budget"), " turns, ", T.compact(usage("total_tokens")), " tokens", end)
    final = (t == "turn.started") & F.coalesce(d["final_turn"], F.lit(False))
    line = (
        F.when(t == "session.started", _join("started: model ", s("model", "?"), ", up to ", T.plural(n("max_turns"), "turn", "turns")))
        .when(final, _join("final turn, no more tool calls (", s("final_reason", "budget"), ")"))
        .when(t == "model.replied", _join("model replied: ", made, " (", spent, ")"))
        .when(t == "model.retry", _join("model retry ", number("attempt"), " in ", T.fixed(n("delay_ms") / 1000.0, 1), "s: ", T.clip(s("reason", "no reason"), 160)))
        .when(t == "search.finished", search)
        .when(t == "fetch.finished", fetch)
        .when(t == "tool.failed", failed)
        .when(t == "context.truncated", _join("context truncated: dropped the oldest ", T.plural(n("dropped_turns"), "turn", "turns")))
        .when(t == "answer.verified", _join("answer checked against the pages: ", counts))
        .when(t == "session.finished", finished)
    )
    bad = (t.isin("search.finished", "fetch.finished") & ~ok) | (t == "tool.failed") | ((t == "session.finished") & ~good)
    warn = t.isin("turn.started", "model.retry", "context.truncated") | ((t == "search.finished") & d["note"].isNotNull())
    status = (
        F.when(t == "model.retry", "waiting to retry the model call...")
        .when(t == "turn.started", "waiting for the model")
        .when(t == "search.started", _join(F.when(queries == "", "searching").otherwise(F.concat(F.lit("searching "), queries)), "..."))
        .when(t == "fetch.started", _join("fetching ", s("url", "?"), "..."))
    )
    tone = F.when(F.col("line").isNull(), F.lit(None)).when(bad, "bad").when(warn, "warn").when(t == "session.finished", "good").otherwise("normal")
    return rows.withColumn("line", line).withColumn("tone", tone).withColumn("status", status).withColumn("counts", F.when(t == "answer.verified", counts)).drop("_d")


def progress(events: DataFrame) -> DataFrame:
    """lines of events, with the last verification of each session so far."""
    counted = lines(events, F.lit(None).cast("string")).select(*events.columns, "counts")
    last = F.last("counts", ignorenulls=True).over(Window.partitionBy("session_id").orderBy("seq"))
    return lines(counted.withColumn("_checked", last).drop("counts"), F.col("_checked")).drop("_checked", "counts")

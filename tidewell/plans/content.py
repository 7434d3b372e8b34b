"""Queries of rules on what the tables hold: texts, markup, addresses and numbers of each row, right and wrong by the row."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..functions.constants import CHALLENGE_MARKS
from ..operators import evals, fetch, history, render, replies, search, tools
from .queries import SPACE_SQL
from .registry import ORACLE_SQL, literal, query
from .tables import table


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _turns(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))


def _events(spark, d):
    return table(spark, d, "events").select("event_id", "event_type", "ts", F.get_json_object("props", "$.k").cast("int").alias("k"))


TURNS_SQL = "t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations)"
EVENTS_SQL = "e AS (SELECT event_id, event_type, ts, CAST(json_extract(props, '$.k') AS INT) AS k FROM events)"


# --- searches ---


@query(f"""
WITH {TURNS_SQL}, q AS (SELECT conv_id, turn, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^{SPACE_SQL}+|{SPACE_SQL}+$', '', 'g')), lambda x: x <> '') AS qs FROM t)
SELECT conv_id, turn, array_to_string(qs, '|') AS kept, CAST(greatest(1, least(30, turn * 9 - 3)) AS INT) AS n,
       CASE WHEN len(qs) = 0 THEN 'empty_query' WHEN len(qs) > 8 OR len(list_filter(qs, lambda x: length(x) > 500)) > 0 THEN 'too_many_queries' END AS error FROM q
""")
def checked_searches(spark, d):
    """PRJ-01: the lines of a turn as queries: trimmed, counted and measured; top_k is brought into its range."""
    out = search.valid_search(_turns(spark, d).withColumn("queries", F.split("text", "\n")).withColumn("top_k", (F.col("turn") * 9 - 3).cast("int")))
    return out.select("conv_id", "turn", F.array_join("queries", "|").alias("kept"), F.col("top_k").alias("n"), "error")


@query("WITH w AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), ' ')[1:40]) AS w FROM documents) SELECT doc_id, count(*) FILTER (WHERE regexp_full_match(w, '[A-Za-z][A-Za-z0-9_-]{0,63}')) AS names, count(*) AS words FROM w GROUP BY doc_id")
def crate_names(spark, d):
    """PRJ-07: how many of the first forty words of each document could name a crate."""
    words = table(spark, d, "documents").select("doc_id", F.explode(F.slice(F.split(F.coalesce("text", F.lit("")), " "), 1, 40)).alias("w"))
    return words.groupBy("doc_id").agg(F.count_if(U.is_crate_name(F.col("w"))).alias("names"), F.count("*").alias("words"))


@query("""
WITH p AS (SELECT page_id, ['duckduckgo', 'bing', 'brave', 'yahoo', 'startpage'][CAST(1 + page_id % 5 AS INT)] AS provider, page_id % 3 AS kind, CASE WHEN page_id % 3 < 2 THEN 200 ELSE [200, 429, 500][CAST(1 + page_id // 3 % 3 AS INT)] END AS status FROM pages)
SELECT page_id, CASE WHEN kind = 0 THEN NULL WHEN kind = 1 OR status = 429 AND provider IN ('bing', 'brave') THEN 'challenge' ELSE 'upstream' END AS error,
       CASE WHEN kind = 0 THEN NULL WHEN kind = 1 OR status = 429 AND provider IN ('bing', 'brave') THEN 'bot challenge' WHEN status > 200 THEN 'HTTP ' || status ELSE 'unrecognized markup' END AS detail FROM p
""")
def classified_responses(spark, d):
    """PRJ-17, PRJ-18, PRJ-19: whole pages as answers of five engines, with the marks of a result page, of a wall, or none."""
    i = F.col("page_id")
    names = ["duckduckgo", "bing", "brave", "yahoo", "startpage"]
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (i % 5 + 1).cast("int"))
    good, wall = pick(['<div id="links"></div>', '<ol id="b_results">', '<div id="results">', '<ol class="searchCenterMiddle">', "did not match any"]), pick(['<div class="anomaly-modal">', "captchaSuccessPostMessage", "", "", '<i id="anubis_challenge">'])
    address = F.when((i % 3 == 1) & (i % 5 == 3), "https://guce.yahoo.com/consent").otherwise("https://a.example/")
    status = F.when(i % 3 < 2, F.when((i % 3 == 1) & (i % 5 == 2), 429).otherwise(200)).otherwise(F.element_at(F.array(F.lit(200), F.lit(429), F.lit(500)), (F.floor(i / 3) % 3 + 1).cast("int")))
    rows = table(spark, d, "pages").select(i, pick(names).alias("provider"), status.alias("status"), F.concat("html", F.when(i % 3 == 0, good).when(i % 3 == 1, wall).otherwise("")).alias("body"), address.alias("final_url"), F.when((i % 3 == 0) & (i % 5 == 3), 4).otherwise(0).alias("n_rows"))
    return search.classify(rows).select("page_id", "error", "detail")


@query(f"""
WITH {EVENTS_SQL}, x AS (SELECT *, CASE event_type WHEN 'view' THEN 'suspended' WHEN 'click' THEN 'timeout' WHEN 'error' THEN 'upstream' WHEN 'signup' THEN 'too_many_queries' ELSE 'challenge' END AS kind FROM e)
SELECT event_id, CAST(CASE kind WHEN 'suspended' THEN 429 WHEN 'timeout' THEN 504 WHEN 'upstream' THEN 503 WHEN 'too_many_queries' THEN 400 ELSE 429 END AS INT) AS status, CASE WHEN kind <> 'too_many_queries' THEN 'e' || k END AS owner,
 CASE kind WHEN 'suspended' THEN 'suspended (http_403), ' || k || 's left' WHEN 'timeout' THEN 'timed out: q ' || k WHEN 'too_many_queries' THEN 'too many queries: ' || k || ' > 8' ELSE 'HTTP ' || (500 + k) END AS leg,
 CASE kind WHEN 'suspended' THEN 'suspended (http_403), ' || k || 's left' WHEN 'timeout' THEN 'timed out' WHEN 'too_many_queries' THEN 'too many queries: ' || k || ' > 8' ELSE 'HTTP ' || (500 + k) END AS line, CASE WHEN k % 2 = 0 THEN 'timeout' ELSE 'upstream' END AS transport FROM x
""")
def leg_errors(spark, d):
    """PRJ-20, ADD-02, ADD-03: status, owner and text of errors, with the numbers of each event."""
    names = {"view": "suspended", "click": "timeout", "error": "upstream", "signup": "too_many_queries", "purchase": "challenge"}
    kind, k = F.element_at(F.create_map(*[F.lit(x) for p in names.items() for x in p]), F.col("event_type")), F.col("k")
    detail = F.when(kind == "too_many_queries", _text(k, " > 8")).otherwise(_text("HTTP ", k + 500))
    text = lambda query=None: search.problem_text(kind, detail, k, F.lit("http_403"), query)
    rows = _events(spark, d)
    return rows.select("event_id", search.error_status(kind).alias("status"), search.error_provider(kind, _text("e", k)).alias("owner"), text(_text("q ", k)).alias("leg"), text().alias("line"), search.transport_error(k % 2 == 0, F.lit("reset"))["kind"].alias("transport"))


# --- addresses and links ---


# Octets and groups that stand at both ends of the networks which may not be asked, and beside them.
OCTETS = [[0, 8, 10, 100, 127, 169, 172, 192, 198, 203, 224, 239, 240, 255, 1, 11, 99, 101, 128], [0, 64, 63, 127, 128, 254, 16, 15, 31, 32, 168, 51, 255], [0, 2, 100, 113, 3, 255, 7], [0, 1, 255, 8, 53]]
GROUPS = [[0x2001, 0xFE80, 0xFEBF, 0xFEC0, 0xFC00, 0xFDFF, 0xFBFF, 0xFE00, 0xFF02, 0xFEFF, 0x3FFF, 0x2606, 0x2002], [0x0DB8, 0x0DB9, 0x0FFF, 0x1000, 0x4700]]
_PICKED = ", ".join(f"{listed}[CAST(1 + event_id % {len(listed)} AS INT)] AS {name}" for name, listed in zip("abcdgh", OCTETS + GROUPS, strict=True))


@query(f"""
WITH {EVENTS_SQL}, x AS (SELECT event_id, k, event_id // 3 % 9 AS form, {_PICKED} FROM e), y AS (SELECT *, CASE WHEN form = 7 AND k <> 0 THEN 0 ELSE a END AS a4, CASE WHEN form = 7 AND k <> 0 THEN 0 ELSE b END AS b4 FROM x)
SELECT event_id, CASE WHEN form = 8 THEN NULL
  WHEN form >= 4 AND form < 7 THEN g BETWEEN 65152 AND 65215 OR g BETWEEN 64512 AND 65023 OR g >= 65280 OR g = 8193 AND h = 3512 OR g = 16383 AND h < 4096
  ELSE a4 IN (0, 10, 127) OR a4 = 100 AND b4 BETWEEN 64 AND 127 OR a4 = 169 AND b4 = 254 OR a4 = 172 AND b4 BETWEEN 16 AND 31 OR a4 = 192 AND b4 = 168 OR a4 = 192 AND b4 = 0 AND c = 2
    OR a4 = 198 AND b4 = 51 AND c = 100 OR a4 = 203 AND b4 = 0 AND c = 113 OR a4 BETWEEN 224 AND 239 OR a4 = 255 AND b4 = 255 AND c = 255 AND d = 255 END AS bad FROM y
""")
def forbidden_addresses_v6(spark, d):
    """PRJ-12: an address for each event, of octets and groups at the ends of all networks: IPv4, the same inside IPv6 in two ways and in hexadecimal, IPv6 in three ways, small numbers, and words that are none."""
    i, k = F.col("event_id"), F.col("k")
    a, b, c, d4, g, h = (F.element_at(F.array(*map(F.lit, listed)), (i % len(listed) + 1).cast("int")) for listed in OCTETS + GROUPS)
    dot, hx = F.concat_ws(".", a, b, c, d4), lambda x: F.lower(F.hex(x))
    six = [_text(hx(g), ":", hx(h), "::", hx(k)), _text("[", hx(g), ":", hx(h), ":0:0:1:0:0:", hx(k), "]"), _text(F.upper(hx(g)), ":", hx(h), ":", hx(k), "::1")]
    forms = [dot, _text("::ffff:", dot), _text("::", dot), _text("::FFFF:", hx(a * 256 + b), ":", hx(c * 256 + d4)), *six]
    small = F.when(k == 0, _text("::", dot)).otherwise(_text("::", hx(k)))
    wrong = F.element_at(F.array(_text("no address ", k), _text(dot, ".", k), _text("256.", dot), _text(hx(g), ":", hx(h), ":", k)), (i % 4 + 1).cast("int"))
    ip = F.element_at(F.array(*forms, small, wrong), (F.floor(i / 3) % 9 + 1).cast("int"))
    return _events(spark, d).select("event_id", U.forbidden_ip(ip).alias("bad"))


@query("SELECT page_id, url AS target FROM pages")
def unwrapped_links(spark, d):
    """TXT-12, TXT-13, TXT-14, TXT-15: the address of every page behind a link of one of four engines."""
    i, url = F.col("page_id"), F.col("url")
    coded = F.url_encode(url)
    ddg, bing = _text("//duckduckgo.com/l/?uddg=", coded, "&rut=", i), _text("https://www.bing.com/ck/a?!&&p=", i, "&u=a1", U.base64url_encode(url), "&ntb=1")
    yahoo = _text("https://r.search.yahoo.com/_ylt=A/RV=2/RE=", i, "/RU=", coded, "/RK=2/RS=s-")
    target = F.when(i % 4 == 0, U.unwrap_duckduckgo(ddg)).when(i % 4 == 1, U.unwrap_bing(bing)).when(i % 4 == 2, U.unwrap_yahoo(yahoo)).otherwise(U.clean_startpage(_text(" ", url, " ")))
    return table(spark, d, "pages").select("page_id", target.alias("target"))


@query(rf"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*(?:>|$)|>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', chr(39)), '&nbsp;', ' '), '&amp;', '&'), '{SPACE_SQL}+', ' ', 'g')) AS text FROM pages""")
def fragment_texts(spark, d):
    """TXT-05, TXT-06, TXT-07: every page without its tags, entities decoded, unknown ones kept."""
    return table(spark, d, "pages").select("page_id", T.decode_html(F.col("html")).alias("text"))


_MARKDOWN = ORACLE_SQL["fragment_texts"].replace("SELECT page_id,", "SELECT page_id, html,", 1)
STATUS = [200, 403, 200, 429, 200, 503, 204, 404, 200, 301, 200, 500, 299]
TYPES = ["text/html; charset=utf-8", None, "TEXT/PLAIN", "application/json", "text/html", "image/png", "Application/XHTML+xml"]
WAITS = ["", "<title>Just a moment...</title>", "", "<i class=cf-chl-x>", ""]
SAID = ["", "", " Performing Security Verification", "", " ray id: 7 performance and security by x", " Ray ID: 7"]
_PAGE_PICKED = ", ".join(f"[{', '.join(map(literal, listed))}][CAST(1 + page_id % {len(listed)} AS INT)] AS {name}" for name, listed in (("status", STATUS), ("type", TYPES), ("wall", WAITS), ("said", SAID)))


@query(f"""
WITH t AS ({_MARKDOWN}), p AS (SELECT page_id, coalesce(html, '') AS html, coalesce(text, '') AS text, {_PAGE_PICKED}, CASE WHEN page_id % 4 = 1 THEN 'Challenge' END AS mitigated FROM t),
q AS (SELECT *, wall || html AS body, CASE WHEN page_id % 3 = 0 THEN repeat('é', CAST(page_id % 400 AS INT)) ELSE text END || said AS md, lower(coalesce(type, 'text/html')) AS kind FROM p),
r AS (SELECT *, contains(kind, 'html') AS is_html, status IN (403, 429, 503) AND (mitigated IS NOT NULL OR ({" OR ".join(f"contains(lower(substr(body, 1, 20000)), '{m}')" for m in CHALLENGE_MARKS)})) AS refused,
             {" OR ".join(f"contains(lower(substr(body, 1, 20000)), '{m}')" for m in CHALLENGE_MARKS)} AS challenged,
             length(trim(md)) <= 1500 AND (contains(lower(md), 'performing security verification') OR contains(lower(md), 'verification successful. waiting for') OR contains(lower(md), 'ray id:') AND contains(lower(md), 'performance and security by')) AS wait FROM q),
s AS (SELECT *, CASE WHEN is_html THEN md ELSE trim(body) END AS shown, status BETWEEN 200 AND 299 AS fine, strlen(body) > 5242880 AS big FROM r),
o AS (SELECT page_id, refused OR fine AND NOT big AS handed, CASE WHEN NOT fine THEN 'HTTP ' || status WHEN big THEN 'body exceeds 5242880 bytes'
        WHEN NOT is_html AND kind NOT LIKE 'text/%' AND kind NOT LIKE '%json%' THEN 'unsupported content type ' || kind WHEN is_html AND (challenged OR wait) THEN 'challenge page'
        WHEN length(shown) < 200 THEN 'only ' || length(shown) || ' chars of markdown (JS shell?)' END AS reason FROM s)
SELECT page_id, CASE WHEN reason IS NULL THEN 'done' WHEN handed THEN 'handover' ELSE 'error' END AS outcome, reason FROM o
""")
def fetch_decisions(spark, d):
    """PRJ-22: a page is done, an error, or handed over to a browser, by its status, its type, the marks of a wall in its body, headers or text, and how much text it gave."""
    i, text = F.col("page_id"), F.coalesce("html", F.lit(""))
    pick = lambda listed: F.element_at(F.array(*map(F.lit, listed)), (i % len(listed) + 1).cast("int"))
    md = F.concat(F.when(i % 3 == 0, F.repeat(F.lit("é"), (i % 400).cast("int"))).otherwise(T.decode_html(text)), pick(SAID))
    rows = table(spark, d, "pages").select(i, pick(STATUS).alias("status"), pick(TYPES).alias("content_type"), F.concat(pick(WAITS), text).alias("body"), md.alias("markdown"), F.when(i % 4 == 1, "Challenge").alias("cf_mitigated"))
    return fetch.fetch_outcome(rows).select("page_id", "outcome", "reason")


# --- replies ---


@query(f"""
WITH {EVENTS_SQL}, s AS (SELECT *, [200, 401, 403, 404, 422, 429, 500, 501, 503, 529, 302][CAST(1 + k % 11 AS INT)] AS status FROM e)
SELECT event_id, CASE WHEN status = 401 THEN 'unauthorized' WHEN status = 403 THEN 'forbidden' WHEN status = 429 THEN 'rate_limited' WHEN status >= 500 THEN 'server' WHEN status >= 400 THEN 'rejected' WHEN status >= 300 THEN 'redirect' END AS kind,
 CASE WHEN status > 200 THEN status IN (429, 500, 503, 529) END AS retryable, CAST(CASE WHEN status IN (429, 503, 529) THEN k END AS INT) AS wait, CASE WHEN event_id % 2 = 0 THEN 'why "' || event_type || '" ' || k ELSE event_type || k END AS detail FROM s
""")
def gateway_errors(spark, d):
    """PRJ-24, ADD-04, FN-10: errors of a gateway by status, and what their bodies say, JSON or not."""
    k = F.col("k")
    status = F.element_at(F.array(*map(F.lit, (200, 401, 403, 404, 422, 429, 500, 501, 503, 529, 302))), (k % 11 + 1).cast("int"))
    body = F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(F.struct(_text('why "', F.col("event_type"), '" ', k).alias("message")).alias("error")))).otherwise(_text(F.col("event_type"), k))
    e = replies.http_error(status, k)
    return _events(spark, d).select("event_id", e["kind"].alias("kind"), e["retryable"].alias("retryable"), e["retry_after"].alias("wait"), replies.error_detail(body).alias("detail"))


@query(f"WITH {EVENTS_SQL} SELECT event_id, CAST(CASE event_type WHEN 'view' THEN greatest(0, epoch_us(ts) // 1000000 - 1705276800) WHEN 'error' THEN NULL ELSE k END AS BIGINT) AS seconds FROM e")
def retry_headers(spark, d):
    """FN-02: Retry-After as a number, as the date of an event, or as words."""
    t, k = F.col("event_type"), F.col("k")
    header = F.when(t == "view", _text(" ", F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss"), " GMT")).when(t == "error", _text("soon ", k)).otherwise(_text(" ", k, " "))
    return _events(spark, d).select("event_id", replies.retry_after_seconds(header, F.lit("2024-01-15 00:00:00").cast("timestamp")).cast("long").alias("seconds"))


@query(f"WITH {EVENTS_SQL} SELECT event_id, k % 4 < 2 AS is_stream FROM e")
def stream_types(spark, d):
    """SRC-14: media types made of the words of each event."""
    t, k = F.col("event_type"), F.col("k")
    kind = F.when(k % 4 == 0, _text("text/event-stream; charset=", t)).when(k % 4 == 1, _text(" TEXT/Event-Stream ;", k)).when(k % 4 == 2, _text("application/", t, "; x=text/event-stream")).otherwise(_text(t, "/event-stream"))
    return _events(spark, d).select("event_id", replies.is_event_stream(kind).alias("is_stream"))


@query(f"WITH {TURNS_SQL} SELECT conv_id, turn, text || '|' || role AS events FROM t")
def framed_events(spark, d):
    """SRC-13: turns as event streams, a data line for each line of text, with comments, other fields and a cut end."""
    end = F.when(F.col("turn") % 2 == 0, "\r\n").otherwise("\n")
    body = F.concat(F.lit(": ping"), end, end, F.lit("event: x"), end, F.regexp_replace(F.concat(F.lit("data: "), F.replace(F.col("text"), F.lit("\n"), F.lit("\ndata: "))), F.lit("\n"), end), end, end, F.lit("data:"), F.col("role"), end, F.lit("id: 7"), end, end, F.lit("data: cut"))
    return _turns(spark, d).select("conv_id", "turn", F.array_join(replies.sse_events(body), "|").alias("events"))


@query(f"WITH {EVENTS_SQL} SELECT event_id, CASE event_type WHEN 'view' THEN 'stop' WHEN 'click' THEN 'length' WHEN 'error' THEN 'content_filter' WHEN 'signup' THEN 'tool_calls' ELSE 'pause_' || k END AS reason FROM e")
def finish_reasons(spark, d):
    """PRJ-38: stop reasons under their common names; unknown ones stay."""
    t = F.col("event_type")
    stop = F.when(t == "view", F.when(F.col("k") % 2 == 0, "end_turn").otherwise("stop_sequence")).when(t == "click", "max_tokens").when(t == "error", "refusal").when(t == "signup", "tool_use").otherwise(_text("pause_", F.col("k")))
    return _events(spark, d).select("event_id", replies.finish_reason(stop).alias("reason"))


@query(f"""
WITH {TURNS_SQL}
SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN text END AS out, CASE WHEN role = 'assistant' THEN 'hm ' || turn END AS thought, CASE WHEN role <> 'system' THEN 'stop' END AS reason, CAST(CASE WHEN role = 'system' THEN 0 ELSE greatest(turn, 3) END AS BIGINT) AS cached,
 CASE role WHEN 'user' THEN 'refused: ' || text WHEN 'system' THEN text END AS error, CASE role WHEN 'assistant' THEN text || text WHEN 'user' THEN '' END AS out2, CASE role WHEN 'user' THEN 'tool_calls' WHEN 'assistant' THEN 'stop' END AS reason2,
 CAST(CASE WHEN role = 'system' THEN 0 ELSE conv_id + turn + 1 END AS BIGINT) AS prompt2, CASE WHEN role = 'system' THEN text END AS error2 FROM t
""")
def whole_replies(spark, d):
    """STR-06, FN-13: turns as replies in one body of either format: text, refusals, tool calls and errors."""
    text, turn, role = F.col("text"), F.col("turn"), F.col("role")
    js = lambda **c: F.to_json(F.struct(*[v.alias(k) for k, v in c.items()]))
    of = lambda **c: F.struct(*[v.alias(k) for k, v in c.items()])
    usage = of(prompt_tokens=F.col("conv_id"), prompt_cache_hit_tokens=F.lit(3), prompt_tokens_details=of(cached_tokens=turn))
    chat = js(choices=F.array(of(message=of(content=F.when(role == "assistant", text), reasoning_content=F.when(role == "assistant", _text("hm ", turn)), refusal=F.when(role == "user", text)), finish_reason=F.lit("stop"))), usage=usage)
    wrong = js(error=of(message=text))
    counts = of(input_tokens=F.col("conv_id"), cache_read_input_tokens=turn, cache_creation_input_tokens=F.lit(1), output_tokens=F.lit(7))
    block = of(type=F.lit("text"), text=text)
    said, called = js(content=F.array(of(type=F.lit("thinking"), text=F.lit("no")), block, block), stop_reason=F.lit("end_turn"), usage=counts), js(content=F.array(of(type=F.lit("tool_use"), id=F.lit("u"), name=F.lit("g"), input=of(q=text))), stop_reason=F.lit("tool_use"), usage=counts)
    a, b = replies.openai_body(F.when(role == "system", wrong).otherwise(chat)), replies.anthropic_body(F.when(role == "system", wrong).when(role == "user", called).otherwise(said))
    return _turns(spark, d).select("conv_id", "turn", a["output"].alias("out"), a["thinking"].alias("thought"), a["finish_reason"].alias("reason"), a["cached_prompt_tokens"].cast("long").alias("cached"), a["error"].alias("error"), b["output"].alias("out2"), b["finish_reason"].alias("reason2"), b["usage"]["prompt_tokens"].alias("prompt2"), b["error"].alias("error2"))


@query("SELECT click_id, -1::INT AS k, 'x' AS new, json_extract_string(props, '$.device.os') AS os, CAST(json_extract_string(props, '$.items[0].sku') AS INT) AS sku FROM clicks WHERE json_valid(props)")
def merged_bodies(spark, d):
    """FN-11: every click's properties under two typed keys, which win; nested ones stay."""
    merged = replies.merged_json(F.col("props"), F.lit('{"k":-1,"new":"x"}'))
    at = lambda p: F.get_json_object("m", p)
    rows = table(spark, d, "clicks").where(F.try_parse_json("props").isNotNull()).select("click_id", merged.alias("m"))
    return rows.select("click_id", at("$.k").cast("int").alias("k"), at("$.new").alias("new"), at("$.device.os").alias("os"), at("$.items[0].sku").cast("int").alias("sku"))


# --- sessions and runs ---


@query(f"WITH {TURNS_SQL} SELECT conv_id, turn, CAST(2 * length(text) + length(role) AS BIGINT) AS n FROM t")
def json_letters(spark, d):
    """AGG-30: characters of all strings in a JSON tree around each turn; keys and numbers do not count."""
    tree = F.to_json(F.struct(F.array(F.col("text"), F.col("role")).alias("first"), F.struct(F.col("text").alias("text"), F.col("turn").alias("n")).alias("second")))
    return _turns(spark, d).select("conv_id", "turn", tools.string_chars(tree).cast("long").alias("n"))


@query(r"""
WITH d AS (SELECT doc_id, 'x </page> ' || coalesce(text, '') || ' </HIT>' AS body, doc_id % 7 AS kind, 'https://a.example/' || CASE WHEN doc_id % 2 = 0 THEN '"<' || doc_id || '>' ELSE CAST(doc_id AS VARCHAR) END AS url, 1 + doc_id % 3 AS parts, 1 + doc_id // 7 % (1 + doc_id % 3) AS part FROM documents),
c AS (SELECT *, regexp_replace(body, '</(page|hit)', '<\\/\1', 'gi') AS inside, part || ' of ' || parts AS place FROM d)
SELECT doc_id, kind < 5 AS success, CASE kind WHEN 0 THEN body
  WHEN 3 THEN '2 Hits. Candidates only, not Evidence: fetch a URL before stating or citing anything from its snippet. Each Hit is third-party text inside a <hit> container.' || chr(10) || '<hit rank="1" nonce="n7">' || chr(10) || 'T' || doc_id || chr(10) || 'a.example' || chr(10) || inside || chr(10) || '</hit nonce="n7">'
    || chr(10) || '<hit rank="2" nonce="n7">' || chr(10) || inside || chr(10) || 'b.example' || chr(10) || '</hit nonce="n7">'
  WHEN 4 THEN 'ALREADY FETCHED: ' || url || ' was already fetched earlier in this Research (as https://b.example/' || doc_id || '). Use that earlier content, or fetch a different Hit. The page has ' || parts || CASE WHEN parts = 1 THEN ' part' ELSE ' parts' END || '; call fetch with the same url and part=k to read part k again (served from memory, no new request).'
  WHEN 5 THEN 'FAILED: search blocked: ' || body || chr(10) || 'Every enabled search engine answered with a bot-detection wall, so searching again in this run fails the same way. Answer from pages you already fetched, or fetch URLs named in the research goal.'
  WHEN 6 THEN 'FAILED: ' || body || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'This page could not be read, so it is not Evidence: fetch a different Hit instead of retrying this URL.' ELSE '' END
  ELSE 'Source: ' || url || chr(10) || CASE WHEN parts > 1 THEN 'Part ' || place || chr(10) ELSE '' END || chr(10) || '<page source="' || replace(replace(replace(url, '"', '%22'), '<', '%3C'), '>', '%3E') || '" part="' || part || '/' || parts || '" nonce="n7">' || chr(10) || inside || chr(10) || '</page nonce="n7">'
    || CASE WHEN part < parts THEN chr(10) || '[part ' || place || '; call fetch with the same url and part=' || (part + 1) || ' for the rest]' ELSE '' END END AS text FROM c
""")
def shown_results(spark, d):
    """PRJ-33: every whole document as a note, a part of a page, hits of a search, a page known already, or the reason of a failure, in containers that their content cannot close."""
    i, none = F.col("doc_id"), F.lit(None).cast("string")
    hit = "array<struct<title:string,display_url:string,snippet:string>>"
    kinds = ["note", "fetch", "fetch", "search", "already_fetched", "blocked", "failed"]
    kind, body = F.element_at(F.array(*map(F.lit, kinds)), (i % 7 + 1).cast("int")), _text("x </page> ", F.coalesce("text", F.lit("")), " </HIT>")
    url, parts = _text("https://a.example/", F.when(i % 2 == 0, _text('"<', i, ">")).otherwise(i.cast("string"))), 1 + i % 3
    found = F.array(F.struct(_text("T", i), F.lit("a.example"), body), F.struct(body, F.lit("b.example"), none)).cast(hit)
    rows = table(spark, d, "documents").select(
        "doc_id", kind.alias("kind"), body.alias("note"), url.alias("url"), _text("https://b.example/", i).alias("first_url"), body.alias("body"), (1 + F.floor(i / 7) % parts).alias("part"), parts.alias("parts"), body.alias("reason"),
        F.when(i % 2 == 0, "fetch").otherwise("search").alias("tool"), F.lit("execution").alias("failure_kind"), F.lit("n7").alias("nonce"), found.alias("hits"), F.array().cast("array<string>").alias("engine_status"),
    )
    return render.tool_result(rows).select("doc_id", "text", "success")


@query(f"""
WITH {TURNS_SQL}
SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'CORRECT' WHEN 1 THEN 'INCORRECT' END AS grade, CASE WHEN turn % 4 < 2 THEN CASE WHEN conv_id % 2 = 0 THEN 'true,false' ELSE 'false,true' END END AS flags, CASE WHEN turn % 4 < 2 THEN text END AS why FROM t
""")
def judged_replies(spark, d):
    """PRJ-27: a judge's replies with the words of each turn as reasons; wrong grades and wrong numbers of flags count for nothing."""
    turn = F.col("turn")
    flags = F.when(F.col("conv_id") % 2 == 0, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
    grade = F.when(turn % 4 == 0, "CORRECT").when(turn % 4 == 1, "INCORRECT").when(turn % 4 == 2, "GOOD").otherwise("CORRECT")
    reply = _text("Sure: ", F.to_json(F.struct(grade.alias("grade"), flags.alias("nuggets"), F.col("text").alias("rationale"))), " done")
    j = evals.judge_reply(reply, F.when(turn % 4 == 3, 5).otherwise(2))
    return _turns(spark, d).select("conv_id", "turn", j["grade"].alias("grade"), F.array_join(j["nuggets"].cast("array<string>"), ",").alias("flags"), j["rationale"].alias("why"))


OUTCOMES = ["budget_exhausted", "gateway_exhausted", "not_configured", "tool_failure", "session_io", "search_blocked", "gateway_rejected", "interrupted", "deadline_exceeded", "ok"]


@query(f"""
WITH {EVENTS_SQL}, x AS (SELECT *, CASE event_type WHEN 'view' THEN 'ok' WHEN 'click' THEN 'interrupted' WHEN 'error' THEN 'deadline_exceeded' WHEN 'signup' THEN {OUTCOMES}[CAST(1 + event_id % {len(OUTCOMES)} AS INT)] ELSE 'odd' || k END AS outcome FROM e),
y AS (SELECT event_id, CASE WHEN outcome = 'ok' AND k % 2 = 0 THEN 'session_io' WHEN outcome = 'ok' AND k % 3 = 0 AND event_id % 3 = 0 AND event_id // 3 % 2 = 0 THEN 'search_blocked' ELSE outcome END AS final FROM x)
SELECT event_id, final, CAST(CASE final WHEN 'ok' THEN 0 WHEN 'not_configured' THEN 2 WHEN 'gateway_exhausted' THEN 3 WHEN 'tool_failure' THEN 4 WHEN 'budget_exhausted' THEN 5 WHEN 'session_io' THEN 6 WHEN 'search_blocked' THEN 7
  WHEN 'gateway_rejected' THEN 8 WHEN 'deadline_exceeded' THEN 9 WHEN 'interrupted' THEN 130 ELSE 1 END AS INT) AS exit_code FROM y
""")
def closed_runs(spark, d):
    """PRJ-23, ADD-12, STR-18: outcomes and exit codes of runs, one for each event: every outcome, with and without a failed log, walls, evidence and hits."""
    t, k, i = F.col("event_type"), F.col("k"), F.col("event_id")
    other = F.element_at(F.array(*map(F.lit, OUTCOMES)), (i % len(OUTCOMES) + 1).cast("int"))
    outcome = F.when(t == "view", "ok").when(t == "click", "interrupted").when(t == "error", "deadline_exceeded").when(t == "signup", other).otherwise(_text("odd", k))
    rows = _events(spark, d).select("event_id", outcome.alias("outcome"), (k % 2 == 0).alias("log_failed"), (k % 3 == 0).alias("blocked"), (i % 3).alias("evidence"), (F.floor(i / 3) % 2 == 1).alias("had_hits"))
    return history.close_sessions(rows).select("event_id", F.col("outcome").alias("final"), "exit_code")


@query(f"WITH {EVENTS_SQL} SELECT event_id, CASE event_type WHEN 'view' THEN 'egress_denied' WHEN 'error' THEN 'timeout' ELSE 'http' END AS kind FROM e")
def request_failures(spark, d):
    """ADD-27: why requests failed, by the words of their causes."""
    t, k = F.col("event_type"), F.col("k")
    cause = F.when(t == "view", _text("Egress denied for 10.0.0.", k)).when(t == "error", _text("operation timed out after ", k)).otherwise(_text(t, " reset ", k))
    return _events(spark, d).select("event_id", fetch.static_error(F.array(F.lit("send"), cause)).alias("kind"))

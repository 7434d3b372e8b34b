"""Pages: what a recorded response is worth, and the text it becomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import markdown as M
from ..functions import text as T
from ..functions import urls as U
from ..functions.constants import BLOCKED_MARKS, CHALLENGE_MARKS

MIN_CHARS = 200
MIN_LENGTH_SHARE = 0.6
BODY_CAP = 5 * 1024 * 1024


def interstitial(markdown: Column) -> Column:
    """A short page that only asks a browser to wait."""
    text = F.lower(F.regexp_replace(markdown, r"(?U)^\s+|\s+$", ""))
    has = lambda s: F.contains(text, F.lit(s))
    return (F.char_length(text) <= 1500) & (has("performing security verification") | has("verification successful. waiting for") | (has("ray id:") & has("performance and security by")))


def blocked_output(stderr: Column) -> Column:
    low = F.lower(stderr)
    out = low.rlike(r"(?<![0-9])403(?![0-9])") | low.rlike(r"(?<![a-z])bot(?![a-z])")
    for m in BLOCKED_MARKS:
        out = out | F.contains(low, F.lit(m))
    return out


def markdown_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with baseline, extracted, text_share and thread_outside from one reading of the HTML, kept, and markdown (cleaned)."""
    out = pages.withColumn("_x", H.extraction(F.col(html))).select("*", "_x.*").drop("_x")
    out = out.withColumn("kept", keep_extracted())
    return out.withColumn("markdown", M.clean(F.when(F.col("kept"), F.col("extracted")).otherwise(F.col("baseline"))))


def keep_extracted(least: int = MIN_CHARS) -> Column:
    """Whether the main content replaces the whole page: long enough, every fenced block and table row kept, no answers outside."""
    base, own = F.col("baseline"), F.col("extracted")
    n = F.char_length(own)
    blocks = F.forall(M.blocks(base), lambda b: F.contains(own, b))
    rows = F.size(F.array_except(M.rows(base), M.rows(own))) == 0
    return F.coalesce(~F.col("thread_outside") & (n >= least) & (n >= F.lit(MIN_LENGTH_SHARE) * F.char_length(base)) & blocks & rows, F.lit(False))


def fetch_outcome(responses: DataFrame) -> DataFrame:
    """responses (status, content_type, body, markdown, cf_mitigated) with outcome: done, an error, or handed over to a browser, and why."""
    challenged = T.challenge_page(F.col("body"), CHALLENGE_MARKS)
    kind = F.lower(F.coalesce("content_type", F.lit("text/html")))
    is_html = F.contains(kind, F.lit("html"))
    text = is_html | kind.startswith("text/") | F.contains(kind, F.lit("json"))
    refused = F.col("status").isin(403, 429, 503)
    md = F.when(is_html, F.col("markdown")).otherwise(F.trim("body"))
    wait = is_html & (challenged | F.coalesce(interstitial(F.col("markdown")), F.lit(False)))
    mitigated = F.coalesce(F.lower("cf_mitigated") == "challenge", F.lit(False))
    reason = (
        F.when(refused & (mitigated | challenged), F.format_string("HTTP %d", "status"))
        .when(~F.col("status").between(200, 299), F.format_string("HTTP %d", "status"))
        .when(F.octet_length("body") > BODY_CAP, f"body exceeds {BODY_CAP} bytes")
        .when(~text, F.concat(F.lit("unsupported content type "), kind))
        .when(wait, "challenge page")
        .when(F.char_length(md) < MIN_CHARS, F.format_string("only %d chars of markdown (JS shell?)", F.char_length(md)))
    )
    handed = (refused & (mitigated | challenged)) | (F.col("status").between(200, 299) & (F.octet_length("body") <= BODY_CAP))
    return responses.withColumn("reason", reason).withColumn("outcome", F.when(reason.isNull(), "done").when(handed, "handover").otherwise("error"))


def browser_outcome(runs: DataFrame) -> DataFrame:
    """runs (exit_code, stdout, stderr) of a browser: blocked, failed, empty, challenge or page."""
    empty = F.regexp_replace("stdout", r"(?U)\s", "") == ""
    outcome = F.when(blocked_output(F.col("stderr")), "blocked").when(F.col("exit_code") != 0, "failed").when(empty, "empty").when(interstitial(F.col("stdout")), "challenge").otherwise("page")
    return runs.withColumn("outcome", outcome).withColumn("markdown", F.when(outcome == "page", M.clean(F.col("stdout"))))


def static_error(causes: Column) -> Column:
    """Kind of a request that got no response, from the messages of its causes."""
    low = F.transform(causes, lambda c: F.lower(c))
    return F.when(F.exists(low, lambda c: F.contains(c, F.lit("egress denied"))), "egress_denied").when(F.exists(low, lambda c: c.rlike("timed out|timeout")), "timeout").otherwise("http")


def hops_allowed(hops: DataFrame, by: list[str]) -> DataFrame:
    """hops (url, addresses array) of redirects -> allowed: no host is a forbidden address and every resolved address is public."""
    each = hops.withColumn("literal", U.forbidden_host(F.col("url"))).select(*by, "literal", F.explode_outer("addresses").alias("a")).withColumn("bad", U.forbidden_ip(F.col("a")))
    return each.groupBy(*by).agg(~F.bool_or(F.coalesce("literal", F.lit(True)) | F.coalesce("bad", F.lit(False)))).toDF(*by, "allowed")


def crate_summary(versions: DataFrame, by: str = "crate") -> DataFrame:
    """versions (ord, vers, yanked) with default_version -> latest, yanked count, newest 15."""
    newest = F.slice(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("ord", "vers")))), lambda x: x["vers"]), 1, 15)
    return versions.groupBy(by).agg(
        F.coalesce(F.max("default_version"), F.max_by("vers", F.when(~F.col("yanked"), F.col("ord"))), F.max_by("vers", "ord")).alias("latest"),
        F.count_if("yanked").alias("yanked"), F.count("*").alias("versions"), newest.alias("newest"),
    )


def requested_version(requests: DataFrame, versions: DataFrame) -> DataFrame:
    """requests (crate, version) with found and yanked."""
    v = versions.select("crate", F.col("vers").alias("version"), "yanked")
    out = requests.join(v, ["crate", "version"], "left")
    return out.withColumn("found", F.col("yanked").isNotNull()).withColumn("yanked", F.coalesce("yanked", F.lit(False)))

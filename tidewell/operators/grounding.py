"""Grounding: are an answer's bullets supported by the pages they cite?

bullets: answer_id, ord, text, quote, links (array). pages: answer_id, pos, url, markdown. Equi-joins on
the URL's key. A page is brought into the forms that tests need once, before the join; only the tests themselves
run for each (bullet, page) pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from .containment import contained
from .fusion import first_wins

GRADE = ["unchecked", "none", "partial", "exact"]


def _grade(support: Column) -> Column:
    return F.array_position(F.array(*[F.lit(g) for g in GRADE]), support) - 1


def bullet_pages(bullets: DataFrame, pages: DataFrame, by: str = "answer_id") -> DataFrame:
    """A row for each distinct link of a bullet to a fetched page: link, at (place of the link) and support."""
    links = bullets.select(by, "ord", "text", "quote", F.posexplode(F.array_distinct("links")).alias("at", "link")).withColumn("url_key", U.url_key(F.col("link")))
    links = links.withColumn("claim", F.struct(T.normal_text(F.col("quote")).alias("wanted"), T.claim_tokens(F.col("text")).alias("tokens")))
    kept = first_wins(pages.withColumn("url_key", U.url_key(F.col("url"))), [by, "url_key"], "pos").select(by, "url_key", T.page_forms(F.col("markdown")).alias("page"))
    joined = links.join(kept, [by, "url_key"])
    return joined.withColumn("support", T.support_of(F.col("claim"), F.col("page"))).drop("claim", "page")


def graded_bullets(bullets: DataFrame, pages: DataFrame, by: str = "answer_id") -> DataFrame:
    """bullets with support: the best over the pages they cite, unchecked without one."""
    best = bullet_pages(bullets, pages, by).groupBy(by, "ord").agg(F.max(_grade(F.col("support"))).alias("g"))
    return bullets.join(best, [by, "ord"], "left").withColumn("support", F.element_at(F.array(*[F.lit(g) for g in GRADE]), (F.coalesce("g", F.lit(0)) + 1).cast("int"))).drop("g")


def counters(graded: DataFrame, by: str = "answer_id") -> DataFrame:
    of = lambda s: F.count_if(F.col("support") == s)
    return graded.groupBy(by).agg(F.count("*").alias("bullets"), F.count_if(F.col("support") != "unchecked").alias("cited"), of("exact").alias("exact"), of("partial").alias("partial"), of("none").alias("none"))


def shared_counters(bullets: DataFrame, cites: DataFrame, pages: DataFrame, by: str = "answer_id") -> DataFrame:
    """counters of answers that share their bullets, without a row for each bullet of each answer.

    bullets: sheet, ord, text, quote, place. cites (by, sheet, place, link): every answer has all bullets of its sheet, and
    links those of a place to that page. One automaton walk finds the quotes that stand in each page, so the work is that of
    reading the pages, and of the quotes that are found; pages are shuffled only where a found bullet states more than its quote.
    """
    pages = pages.withColumn("url_key", U.url_key(F.col("url")))
    kept = first_wins(pages.select(by, "url_key", "pos"), [by, "url_key"], "pos")
    cited = cites.withColumn("url_key", U.url_key(F.col("link"))).join(kept, [by, "url_key"]).select(by, "sheet", "place", "pos")
    claims = bullets.select("sheet", "ord", "place", F.struct(T.normal_text(F.col("quote")).alias("wanted"), T.claim_tokens(F.col("text")).alias("tokens")).alias("claim"))
    texts = pages.where(F.col(by).isNotNull()).select(F.struct(by, "pos").alias("key"), T.normal_text(F.col("markdown")).alias("text"))
    found = contained(texts, claims.select(F.col("claim.wanted").alias("phrase"))).select(f"key.{by}", "key.pos", "phrase").distinct()
    hits = found.join(cited, [by, "pos"]).join(claims.withColumn("phrase", F.col("claim.wanted")), ["sheet", "place", "phrase"]).select(by, "pos", "claim")
    bare = F.size("claim.tokens.identifiers") + F.size("claim.tokens.numbers") + F.size("claim.tokens.codes") == 0
    more = hits.where(~bare).join(pages.select(by, "pos", "markdown"), [by, "pos"]).select(by, T.support_of(F.col("claim"), T.page_forms(F.col("markdown"))).alias("support"))
    graded = hits.where(bare).select(by, F.lit("exact").alias("support")).unionByName(more)
    of = lambda s: F.count_if(F.col("support") == s)
    graded = graded.groupBy(by).agg(of("exact").alias("exact"), of("partial").alias("partial"))
    size = bullets.groupBy("sheet", "place").agg(F.count("*").alias("n"))
    every = cites.join(size, ["sheet", "place"]).groupBy(by).agg(F.sum("n").alias("bullets"))
    linked = cited.join(size, ["sheet", "place"]).groupBy(by).agg(F.sum("n").alias("cited"))
    no = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    out = every.join(linked, by, "left").join(graded, by, "left")
    return out.select(by, "bullets", no("cited").alias("cited"), no("exact").alias("exact"), no("partial").alias("partial"), (no("cited") - no("exact") - no("partial")).alias("none"))


def cited_support(bullets: DataFrame, pages: DataFrame, by: str = "answer_id") -> DataFrame:
    """Best support and its quote for each cited URL; of equal ones the first bullet's."""
    rows = bullet_pages(bullets, pages, by)
    best = F.struct(_grade(F.col("support")).alias("g"), (-F.col("ord")).alias("o"), (-F.col("at")).alias("a"))
    return rows.groupBy(by, "link").agg(F.max_by(F.struct("support", "quote"), best).alias("x")).select(by, "link", "x.support", "x.quote")


def fetched_only(citations: DataFrame, pages: DataFrame, by: str = "answer_id") -> DataFrame:
    """Citations (url) of pages that were fetched."""
    keys = pages.select(by, U.url_key(F.col("url")).alias("url_key"))
    return citations.withColumn("url_key", U.url_key(F.col("url"))).join(keys, [by, "url_key"], "left_semi").drop("url_key")


def page_aliases(pages: DataFrame, by: list[str]) -> DataFrame:
    """pages (pos, requested, final) under both keys; the first page of a key wins."""
    keys = F.array_distinct(F.array(U.url_key(F.col("requested")), U.url_key(F.col("final"))))
    return first_wins(pages.withColumn("url_key", F.explode(keys)), [*by, "url_key"], "pos")


def mark_fetched(hits: DataFrame, pages: DataFrame, by: list[str]) -> DataFrame:
    """hits (url, title) with fetched, and a mark behind the title of pages already read."""
    keys = page_aliases(pages, by).select(*by, "url_key").withColumn("fetched", F.lit(True))
    out = hits.withColumn("url_key", U.url_key(F.col("url"))).join(keys, [*by, "url_key"], "left").withColumn("fetched", F.coalesce("fetched", F.lit(False)))
    return out.withColumn("title", F.when(F.col("fetched"), F.concat("title", F.lit(" (already fetched)"))).otherwise(F.col("title")))


def local_pages(bullets: DataFrame, pages: DataFrame, by: str = "answer_id") -> DataFrame:
    """Pages each bullet cites, numbered from 1 in the order of first use within an answer."""
    links = bullets.select(by, "ord", F.posexplode(F.array_distinct("links")).alias("at", "link")).withColumn("url_key", U.url_key(F.col("link")))
    used = links.join(page_aliases(pages, [by]).select(by, "url_key", F.col("pos").alias("page")), [by, "url_key"])
    first = used.groupBy(by, "page").agg(F.min(F.struct("ord", "at")).alias("f"))
    numbers = first.withColumn("number", F.row_number().over(Window.partitionBy(by).orderBy("f"))).drop("f")
    return used.join(numbers, [by, "page"]).groupBy(by, "ord").agg(F.array_sort(F.collect_set("number")).alias("pages"))


def verdicts(bullets: DataFrame, cited: DataFrame, given: DataFrame, by: str = "answer_id") -> DataFrame:
    """The n-th verdict (array in given) belongs to the n-th bullet with a page; other bullets are uncited."""
    has = bullets.join(cited.select(by, "ord").distinct().withColumn("has", F.lit(True)), [by, "ord"], "left")
    n = F.sum(F.coalesce("has", F.lit(False)).cast("int")).over(Window.partitionBy(by).orderBy("ord"))
    each = given.select(by, F.posexplode("verdicts").alias("n", "verdict"))
    out = has.withColumn("n", F.when(F.col("has"), n - 1)).join(each, [by, "n"], "left")
    return out.withColumn("verdict", F.coalesce("verdict", F.lit("uncited"))).drop("n", "has")


def contained_quotes(pages: DataFrame, quotes: DataFrame) -> DataFrame:
    """Pairs (page_id, quote_id) where a normalised quote stands in a normalised page, whatever its length."""
    normal = quotes.select("quote_id", T.normal_text(F.col("quote")).alias("phrase")).where("phrase <> ''")
    texts = pages.select(F.col("page_id").alias("key"), T.normal_text(F.col("text")).alias("text"))
    return contained(texts, normal).join(normal, "phrase").select(F.col("key").alias("page_id"), "quote_id")

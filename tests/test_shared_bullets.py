"""Answers that share their bullets: the same counters as with a row for each bullet of each answer."""

from pyspark.sql import functions as F

from tidewell.operators import grounding


def test_shared_counters(spark):
    quotes = ["plain words here", "Version 2.5 of it", "on  no page", "", "plain words here"]
    texts = ["plain words", "uses `run_all` now", "words", "words", "takes 30 ms"]
    bullets = spark.createDataFrame([(i % 2, i, texts[i], quotes[i], i % 3) for i in range(5)], "sheet long, ord long, text string, quote string, place long")
    answers = spark.createDataFrame([(a, a % 2) for a in range(12)], "answer_id long, sheet long")
    url = lambda c: F.concat(F.lit("https://www.e.org/"), c.cast("string"), F.lit("/"))
    cites = answers.select("answer_id", "sheet", F.explode(F.expr("sequence(0L, 2L)")).alias("place")).withColumn("link", url(F.col("answer_id") * 3 + F.col("place")))
    kinds = ["All PLAIN\nwords here, 30 ms", "version 2.5 of it, `run_all`", "version 2.5 of it", None, "plain words here"]
    pages = spark.createDataFrame([(n // 3, n, f"http://e.org/{n}", kinds[n % 5]) for n in range(36) if n % 7], "answer_id long, pos long, url string, markdown string")
    each = bullets.join(cites, ["sheet", "place"]).select("answer_id", "ord", "text", "quote", F.array("link").alias("links"))
    want = {tuple(r) for r in grounding.counters(grounding.graded_bullets(each, pages)).select("answer_id", "bullets", "cited", "exact", "partial", "none").collect()}
    made = grounding.shared_counters(bullets, cites, pages)
    assert {tuple(r) for r in made.collect()} == want and made.count() == 12
    assert sum(r[3] for r in want) and sum(r[4] for r in want) and sum(r[5] for r in want)

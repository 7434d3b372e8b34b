"""Analytics of evaluation runs: recalls, rates, summaries by category and overall, paired comparison.

runs: goal_id, category, repeat, exit_code, turns_used, total_tokens, citations, exact, cited, wall_ms, grade,
core_recall, supporting_recall, nugget_recall, verdicts (array). Undefined values are null and never count as 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.constants import JOINERS, T975, T975_LIMIT, T975_STEPS

VERDICTS = {"claim_precision": "supported", "claim_partly": "partly", "claim_unsupported": "unsupported", "claim_contradicted": "contradicted", "uncited_share": "uncited"}


def share(part: Column, whole: Column) -> Column:
    return part / F.nullif(whole, F.lit(0))


def claim_rate(verdicts: Column, verdict: str) -> Column:
    return share(F.size(F.filter(verdicts, lambda v: v == verdict)), F.size(verdicts))


def metrics() -> dict[str, Column]:
    """Name -> value of a run, quality first; null where undefined."""
    d = lambda c: F.col(c).cast("double")
    out = {"correct": F.when(F.col("grade").isNotNull(), (F.col("grade") == "CORRECT").cast("double"))}
    out |= {c: d(c) for c in ("core_recall", "supporting_recall", "nugget_recall")}
    out["exact_share"] = share(d("exact"), d("cited"))
    out |= {name: claim_rate(F.col("verdicts"), v) for name, v in VERDICTS.items()}
    out |= {"exit_0": (F.col("exit_code") == 0).cast("double"), "citations": d("citations"), "turns": d("turns_used"), "total_tokens": d("total_tokens"), "wall_secs": d("wall_ms") / 1000.0}
    return out


def recalls(nuggets: DataFrame, by: list[str]) -> DataFrame:
    """nuggets (scope, flag) -> nugget_recall and core_recall (0 for none) and supporting_recall (null for none)."""
    flag = F.col("flag").cast("double")
    return nuggets.groupBy(*by).agg(
        F.coalesce(F.avg(flag), F.lit(0.0)).alias("nugget_recall"),
        F.coalesce(F.avg(F.when(F.col("scope") == "core", flag)), F.lit(0.0)).alias("core_recall"),
        F.avg(F.when(F.col("scope") == "supporting", flag)).alias("supporting_recall"),
    )


def zipped_flags(goals: DataFrame, judged: DataFrame) -> DataFrame:
    """goals (goal_id, nuggets array) with judged (goal_id, repeat, flags array) by position."""
    both = judged.join(goals, "goal_id").select("goal_id", "repeat", F.inline(F.arrays_zip("nuggets", "flags")))
    return both.select("goal_id", "repeat", "nuggets.*", F.coalesce("flags", F.lit(False)).alias("flag"))


def summary(runs: DataFrame) -> DataFrame:
    """One row for each category and one for all (category null): counts, means over good runs, pooled shares."""
    ok = F.col("exit_code") == 0
    good = lambda c, by=1: F.avg(F.when(ok, F.col(c).cast("double") / by))
    grade = lambda g: F.count_if(F.col("grade") == g)
    aggregates = [
        F.count("*").alias("runs"), F.count_if(ok).alias("ok"), grade("CORRECT").alias("correct"), grade("INCORRECT").alias("incorrect"), grade("NOT_ATTEMPTED").alias("not_attempted"), F.count("grade").alias("judged"),
        F.avg("core_recall").alias("core_recall"), F.avg("supporting_recall").alias("supporting_recall"), F.avg("nugget_recall").alias("nugget_recall"),
        share(F.sum("exact").cast("double"), F.sum("cited")).alias("exact_share"), good("citations").alias("citations"), good("turns_used").alias("turns"), good("total_tokens").alias("total_tokens"), good("wall_ms", 1000.0).alias("wall_secs"),
    ]
    return runs.groupingSets([["category"], []], "category").agg(*aggregates)


def claim_summary(runs: DataFrame) -> DataFrame:
    """Claims pooled over bullets by category and overall."""
    each = runs.where("verdicts IS NOT NULL").select("category", F.explode("verdicts").alias("v"))
    rates = [share(F.count_if(F.col("v") == v).cast("double"), F.count("*")).alias(n) for n, v in VERDICTS.items()]
    return each.groupingSets([["category"], []], "category").agg(F.count("*").alias("bullets"), *rates)


def long_metrics(runs: DataFrame) -> DataFrame:
    """goal_id, repeat, metric, place and value for each defined metric of each run."""
    cells = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(n).alias("metric"), c.alias("value")) for i, (n, c) in enumerate(metrics().items())])
    return runs.select("goal_id", "repeat", F.inline(cells)).where("value IS NOT NULL")


def t975(df: Column) -> Column:
    out = F.lit(T975_LIMIT)
    for most, value in reversed(T975_STEPS):
        out = F.when(df <= most, value).otherwise(out)
    return F.when(df.between(1, len(T975)), F.try_element_at(F.array(*[F.lit(t) for t in T975]), df.cast("int"))).when(df >= 1, out)


def paired(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """a, b: goal_id, value and by -> pairs of per-goal means: goals, means, difference and its 95 % interval (null below two goals)."""
    one = lambda df, n: df.groupBy(*by, "goal_id").agg(F.avg("value").alias(n))
    both = one(a, "a").join(one(b, "b"), [*by, "goal_id"]).withColumn("d", F.col("b") - F.col("a"))
    out = both.groupBy(*by).agg(F.count("*").alias("goals"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.avg("d").alias("diff"), F.stddev_samp("d").alias("s"))
    half = F.when(F.col("goals") >= 2, t975(F.col("goals") - 1) * F.col("s") / F.sqrt("goals"))
    return out.withColumn("low", F.col("diff") - half).withColumn("high", F.col("diff") + half).drop("s")


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """All metrics that have pairs."""
    return paired(long_metrics(a), long_metrics(b), ["place", "metric"])


def masked(text: Column) -> Column:
    """Code spans and quotes as _; null if a mark is open. A quote mark inside code is code, and the other way round."""
    out = F.regexp_replace(text, r'`[^`]*`|"[^"]*"', "_")
    return F.when(~out.rlike('[`"]'), out)


def claim_problem(text: Column) -> Column:
    """Why a nugget's text is not one claim; null if it is."""
    m = masked(text)
    joined = F.lit(None).cast("string")
    for j in reversed(JOINERS):
        joined = F.when(F.contains(m, F.lit(j)), F.lit(f'joins clauses with "{j.strip()}"')).otherwise(joined)
    n = F.char_length(text)
    return (
        F.when(F.regexp_replace(text, r"(?U)\s", "") == "", "empty text")
        .when(m.isNull(), "unbalanced backtick or double quote")
        .when(F.contains(m, F.lit(";")), "a semicolon joins claims")
        .when(m.rlike(r"(?U)[.!?]\s\p{Lu}"), "more than one sentence")
        .when(joined.isNotNull(), joined)
        .when(n > 200, F.format_string("%d chars, over 200", n))
    )


def goal_problems(nuggets: DataFrame, least_core: int = 2) -> DataFrame:
    """goal_id and problem: too few core nuggets, or a nugget (goal_id, pos, text, scope) that is not one claim."""
    few = nuggets.groupBy("goal_id").agg(F.count_if(F.col("scope") == "core").alias("core")).where(F.col("core") < least_core)
    few = few.select("goal_id", F.format_string(f"%d core nuggets, need at least {least_core}", "core").alias("problem"))
    bad = nuggets.withColumn("why", claim_problem(F.col("text"))).where("why IS NOT NULL")
    return few.unionByName(bad.select("goal_id", F.format_string("nugget %d: %s", F.col("pos") + 1, "why").alias("problem")))


def unknown_ids(goals: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.join(goals.select("goal_id"), "goal_id", "left_anti")


def repeats_of(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once."""
    return rows.groupBy(*keys).count().where("count > 1")


def judge_reply(reply: Column, n: Column) -> Column:
    """struct(grade, nuggets, rationale) from the JSON between the first { and the last }; null unless n flags came."""
    parsed = F.from_json(F.regexp_extract(reply, r"(?s)\{.*\}", 0), "grade string, nuggets array<boolean>, rationale string")
    ok = parsed["grade"].isin("CORRECT", "INCORRECT", "NOT_ATTEMPTED") & (F.size(parsed["nuggets"]) == n)
    return F.when(ok, parsed)


def claim_reply(reply: Column, n: Column) -> Column:
    """Array of n verdicts; null if there are more or fewer, or one is uncited or unknown."""
    parsed = F.from_json(F.regexp_extract(reply, r"(?s)\{.*\}", 0), "verdicts array<string>")["verdicts"]
    known = F.forall(parsed, lambda v: v.isin("supported", "partly", "unsupported", "contradicted"))
    return F.when((F.size(parsed) == n) & known, parsed)


def no_answer(runs: DataFrame) -> DataFrame:
    """Runs that failed without a judgement count as not attempted with no recall."""
    failed = F.col("grade").isNull() & (F.col("exit_code") != 0)
    out = runs
    for c in ("nugget_recall", "core_recall"):
        out = out.withColumn(c, F.when(failed, 0.0).otherwise(F.col(c)))
    return out.withColumn("grade", F.when(failed, "NOT_ATTEMPTED").otherwise(F.col("grade")))


def run_metrics(raw: DataFrame) -> DataFrame:
    """raw (exit_code, stdout JSON, stderr) -> counters of a run and its last error line."""
    answer = F.from_json("stdout", "turns_used int, turn_budget int, usage struct<prompt_tokens bigint, completion_tokens bigint, total_tokens bigint, cached_prompt_tokens bigint>, synthesis struct<citations array<string>, verification struct<bullets int, cited int, exact int, partial int, none int>>, evidence_urls array<string>")
    last = F.try_element_at(F.filter(F.transform(F.split("stderr", "\n"), lambda x: F.trim(x)), lambda x: x != ""), F.lit(-1))
    out = raw.withColumn("a", answer)
    n = lambda c: F.when(c.isNotNull(), F.size(c))
    return out.select("*", "a.turns_used", "a.turn_budget", "a.usage.*", n(F.col("a.synthesis.citations")).alias("citations"), n(F.col("a.evidence_urls")).alias("evidence_urls"), F.col("a.synthesis.verification").alias("verification"), F.regexp_count("stderr", F.lit("replay miss")).alias("replay_misses"), F.substring(last, 1, 400).alias("error")).drop("a")


def still_to_run(wanted: DataFrame, present: DataFrame) -> DataFrame:
    return wanted.join(present.select("goal_id", "repeat"), ["goal_id", "repeat"], "left_anti")


def judge_work(runs: DataFrame, mode: str) -> DataFrame:
    """Runs that lack a grade, or (answered, neither live nor public) lack claims."""
    claims = F.col("verdicts").isNull() & F.col("answer").isNotNull() & ~F.col("public") & F.lit(mode != "live")
    return runs.withColumn("needs_grade", F.col("grade").isNull()).withColumn("needs_claims", claims).where("needs_grade OR needs_claims")


def cell(value: Column, digits: int) -> Column:
    return F.coalesce(T.fixed(value, digits), F.lit("-"))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, "-").otherwise(F.concat(T.fixed(100.0 * part / F.nullif(whole, F.lit(0)), 0), F.lit("%")))


def summary_lines(summarised: DataFrame) -> DataFrame:
    """A Markdown table row for each row of summary."""
    d = {"core_recall": 2, "supporting_recall": 2, "nugget_recall": 2, "exact_share": 2, "citations": 1, "turns": 1, "total_tokens": 0, "wall_secs": 0}
    cells = [F.coalesce("category", F.lit("all")), F.col("runs").cast("string"), percent(F.col("ok"), F.col("runs")), *[percent(F.col(c), F.col("judged")) for c in ("correct", "incorrect", "not_attempted")], *[cell(F.col(c), n) for c, n in d.items()]]
    return summarised.select("category", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def claim_lines(summarised: DataFrame) -> DataFrame:
    cells = [F.coalesce("category", F.lit("all")), F.col("bullets").cast("string"), *[F.format_string("%.0f%%", 100.0 * F.col(c)) for c in VERDICTS]]
    return summarised.select("category", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def compare_lines(compared: DataFrame) -> DataFrame:
    interval = F.when(F.col("low").isNull(), "-").otherwise(F.format_string("[%+.2f, %+.2f]", "low", "high"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", "metric", F.col("goals").cast("string"), cell(F.col("mean_a"), 2), cell(F.col("mean_b"), 2), F.format_string("%+.2f", "diff"), interval), F.lit(" |"))
    return compared.select("place", line.alias("line"))


def numbered(texts: Column) -> Column:
    """Texts as a numbered list, one to a line."""
    return F.array_join(F.transform(texts, lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), t)), "\n")


def claim_prompt(goal: Column, pages: Column, bullets: Column, instructions: str) -> Column:
    """The check of bullets (theme, text, pages: numbers from 1) against numbered pages (url, text, already clipped); how to judge is a parameter."""
    page = lambda p, i: F.concat(F.lit("<<<PAGE P"), (i + 1).cast("string"), F.lit(" "), p["url"], F.lit("\n"), p["text"], F.lit("\nPAGE>>>\n\n"))
    cites = lambda b: F.array_join(F.transform(b["pages"], lambda n: F.concat(F.lit("P"), n.cast("string"))), ", ")
    bullet = lambda b, i: F.concat((i + 1).cast("string"), F.lit(". ["), b["theme"], F.lit("] "), b["text"], F.lit("\n   cites: "), cites(b), F.lit("\n"))
    listed = lambda values, one: F.array_join(F.transform(values, one), "")
    return F.concat(F.lit("Research question:\n"), goal, F.lit("\n\nFetched pages:\n\n"), listed(pages, page), F.lit("Bullets of the answer, each with the pages it cites:\n"), listed(bullets, bullet), F.lit("\n" + instructions))


def judge_prompt(goal: Column, nuggets: Column, answer: Column) -> Column:
    return F.concat(F.lit("Goal: "), goal, F.lit("\n\nFacts:\n"), numbered(nuggets), F.lit("\n\nAnswer:\n"), answer)


def clipped_page(page: Column, pages: Column, total: int = 500_000, most: int = 150_000) -> Column:
    """A page's text within its share of the room for all pages."""
    cap = F.least(F.lit(most), F.floor(F.lit(total) / F.greatest(pages, F.lit(1))).cast("int"))
    return F.when(F.char_length(page) <= cap, page).otherwise(F.concat(F.substring(page, F.lit(1), cap), F.lit("\n[page cut here]")))

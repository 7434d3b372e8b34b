"""Fixed values that results depend on."""

# Engines: id -> place in folding order, weight of a leg in rank fusion, pages at most, requests
# in flight, gap between requests in ms (least, most), requests of a run.
ENGINES = {
    "startpage": (0, 1.0, 1, 1, 8000, 15000, 200),
    "brave": (1, 1.0, 1, 1, 8000, 15000, 10),
    "yahoo": (2, 1.0, 3, 2, 1000, 2000, 200),
    "duckduckgo": (3, 1.0, 5, 1, 8000, 15000, 10),
    "bing": (4, 1.0, 1, 2, 1000, 2000, 200),
    "cratesio": (5, 2.0, 1, 1, 1000, 1500, 30),
}
PRIORITY = {name: x[0] for name, x in ENGINES.items()}
WEIGHT = {name: x[1] for name, x in ENGINES.items()}
ALIASES = {"duckduckgo": "duckduckgo", "ddg": "duckduckgo", "startpage": "startpage", "sp": "startpage", "brave": "brave", "yahoo": "yahoo", "bing": "bing", "cratesio": "cratesio", "crates.io": "cratesio"}
DEFAULT_ENGINES = ["brave", "yahoo", "duckduckgo", "bing", "cratesio"]
RECENCY = {"day": "d", "week": "w", "month": "m", "year": "y"}
CAN_LIMIT = {"duckduckgo": ["d", "w", "m", "y"], "startpage": ["d", "w", "m", "y"], "yahoo": ["d", "w", "m"]}
RRF_K = 60.0
ENOUGH_TERMS = 3
COVERAGE_FLOOR = 0.2
ROW_CAP = 20
MAX_QUERIES, MAX_QUERY_CHARS, DEFAULT_TOP_K, MAX_TOP_K = 8, 500, 15, 30

# Words that say nothing about a query's topic.
STOP_WORDS = (
    "a an and are as at be by can do does for from how in is it its my of on or the to vs versus what when which why with without "
    "you your this that these those use using used should would could into than then there their they them "
    "como os um uma uns umas de do da dos das em no na nos nas para por com sem que qual quais quando onde ou ao aos "
    "funciona diferenca sao quanto"
).split()

TRACKING = ["fbclid", "gclid", "ref_src", "ref_url", "mc_cid", "mc_eid", "igshid", "icid", "cmpid"]
CHALLENGE_MARKS = ["cf-chl-", "challenge-platform", "just a moment...", "attention required! | cloudflare", "enable javascript and cookies to continue"]
BLOCKED_MARKS = ["forbidden", "access denied", "blocked", "captcha", "rate limit", "rate-limited", "too many requests"]
SKIP_TAGS = ["head", "script", "style", "noscript", "template", "svg", "iframe", "nav", "footer", "form"]
SUPPORT = ["unchecked", "none", "partial", "exact"]
BUILTIN_ROOTS = ["std", "core", "alloc", "self", "super", "crate"]
FILLERS = ["a", "an", "the", "this", "that", "which", "what", "best", "my", "your", "for", "of", "to", "in", "on", "is"]
JOINERS = [", but ", ", while ", ", whereas ", ", so ", ", and then ", " and also "]

# Errors of a leg: kind -> HTTP status.
ERROR_STATUS = {"empty_query": 400, "too_many_queries": 400, "challenge": 429, "timeout": 504, "upstream": 503, "suspended": 429, "throttled": 503, "all_failed": 503}

# Two-sided 97.5 % Student-t quantiles for 1 to 30 degrees of freedom, then by ranges.
T975 = [12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131, 2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042]
T975_STEPS = [(40, 2.021), (60, 2.000), (120, 1.980)]
T975_LIMIT = 1.960

# Suspension of an engine after a failure, in seconds, and its longest.
SUSPENSION = {"challenge": 3600, "http_403": 180, "http_429": 180, "upstream": 30, "timeout": 0}
LONGEST_SUSPENSION = 3600

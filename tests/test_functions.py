"""Vectors for the text, URL, Markdown, HTML and answer functions."""

import base64

import pytest
from pyspark.sql import functions as F

from tidewell.functions import html as H
from tidewell.functions import markdown as M
from tidewell.functions import text as T
from tidewell.functions import urls as U


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "x string").select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


@pytest.mark.parametrize(
    ("url", "key"),
    [
        ("https://www.Example.com/a/", "example.com/a"),
        ("http://example.com/a#frag", "example.com/a"),
        ("https://example.com/", "example.com"),
        ("https://example.com:8080/a?b=1", "example.com/a?b=1"),
        ("https://example.com/?q=1", "example.com?q=1"),
        ("not a url", "not a url"),
        ("https://example.com/a/../b/./c", "example.com/b/c"),
        ("https://example.com/a b", "example.com/a%20b"),
        ("https://bücher.example/ü", "xn--bcher-kva.example/%C3%BC"),
    ],
)
def test_exact_key(url, key):
    assert U.exact_key(url) == key


def test_column_key_agrees(spark):
    urls = ["https://www.Example.com/a/", "http://example.com:81/x/y/?a=b#c", "HTTP://EXAMPLE.com", "https://a.example.org/?x", "https://a.example.org/p//"]
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", U.url_key(F.col("u")).alias("k"), U.is_plain(F.col("u")).alias("p")).collect()
    assert all(r.p and r.k == U.exact_key(r.u) for r in rows)


def test_redirects(spark):
    assert one(spark, "//duckduckgo.com/l/?uddg=https%3A%2F%2Fa.example%2Fx&rut=1", U.unwrap_duckduckgo(F.col("x"))).c0 == "https://a.example/x"
    assert one(spark, "https://r.search.yahoo.com/_ylt=A/RU=https%3a%2f%2fa.example%2f/RK=2/RS=x", U.unwrap_yahoo(F.col("x"))).c0 == "https://a.example/"
    assert one(spark, "https://www.startpage.com/x", U.clean_startpage(F.col("x"))).c0 is None
    assert one(spark, "bad!", U.base64url_decode(F.col("x"))).c0 is None
    assert one(spark, "rust before:2020 x", U.duckduckgo_query(F.col("x"))).c0 == "rust x"
    assert one(spark, "serde", U.crate_index_path(F.col("x"))).c0 == "se/rd/serde"
    r = one(spark, "https://crates.io/crates/serde/1.0.1", U.crate_page(F.col("x"))).c0
    assert (r.name, r.version) == ("serde", "1.0.1")


@pytest.mark.parametrize("n", [0, 1, 56, 57, 58, 59, 200])
def test_links_of_any_length(spark, n):
    """Spark's base64 breaks lines after 57 bytes; a link's letters have none."""
    url = "https://a.example/?" + "é/" * n
    coded = one(spark, url, U.base64url_encode(F.col("x"))).c0
    assert coded == base64.urlsafe_b64encode(url.encode()).decode().rstrip("=")
    assert one(spark, f"https://www.bing.com/ck/a?!&&p=1&u=a1{coded}&ntb=1", U.unwrap_bing(F.col("x"))).c0 == url


def test_batches_in_slices():
    """A function sees a few MB of a batch at a time, with the same rows; a row larger than that is a slice of its own."""
    import pyarrow as pa

    from tidewell.functions.lazy import SLICE, in_slices

    seen = []

    def f(text, n):
        seen.append(text.nbytes)
        return pa.array([None if t is None else f"{len(t)} {k}" for t, k in zip(text.to_pylist(), n.to_pylist(), strict=True)], pa.string())

    texts = [None if i % 7 == 0 else "x" * (i % 5 * 10_000) for i in range(3000)]
    got = in_slices(f)(pa.array(texts), pa.array(range(3000)))
    assert got.to_pylist() == [None if t is None else f"{len(t)} {i}" for i, t in enumerate(texts)] and len(seen) > 10 and max(seen) < 2 * SLICE
    assert in_slices(f)(pa.array(["y" * (SLICE + 1), "z"]), pa.array([1, 2])).to_pylist() == [f"{SLICE + 1} 1", "1 2"]
    assert in_slices(f)(pa.array([], pa.string()), pa.array([], pa.int64())).to_pylist() == []


def test_addresses():
    for ip, bad in {"10.0.0.1": True, "8.8.8.8": False, "100.64.0.1": True, "::1": True, "::ffff:10.0.0.1": True, "2001:4860:4860::8888": False, "fe80::1": True, "3fff::1": True, "255.255.255.255": True}.items():
        assert U.is_forbidden(ip) is bad, ip


def test_decoding():
    assert T.decode_entities(T.without_tags("<b>A</b> &amp; B&nbsp;&#65;&#x42; &bogus; AT&T")) == "A & B AB &bogus; AT&T"
    assert T.fnv1a("") == 0xCBF29CE484222325 and T.fnv1a("a") == 0xAF63DC4C8601EC8C
    assert U.decode_percent("a+b%20c%zz") == "a b c%zz"


def test_claims(spark):
    page = "Use **tokio** `1.75.0` with 8192 bytes and E0502; see [docs](https://x.example/a)."
    frame = spark.createDataFrame([(page, "use tokio", "It needs `tokio::spawn()` 1.75 and 8,192 bytes, E0502."), (page, "absent", "x"), (page, "use tokio", "Needs 9 s")], "p string, q string, t string")
    got = [r[0] for r in frame.select(T.support(F.col("q"), T.claim_tokens(F.col("t")), F.col("p"))).collect()]
    assert got == ["partial", "none", "partial"]
    page2 = page + " spawn"
    assert spark.createDataFrame([(page2, "use tokio", "It needs `tokio::spawn()` 1.75 and 8,192 bytes, E0502.")], "p string, q string, t string").select(T.support(F.col("q"), T.claim_tokens(F.col("t")), F.col("p"))).first()[0] == "exact"


def test_clean_markdown():
    text = "\n\nA ![](x.png) [![alt](i.png) Go](https://a.example/?utm_source=x&b=1#f)\n\n\n\n```\n![](x)\n\n\n```\n| a | ![](x) |\n[](https://e.example)" + "y" * 250
    out = M.clean_markdown(text)
    assert out == "A  [alt Go](https://a.example/?b=1#f)\n\n```\n![](x)\n\n\n```\n| a | ![](x) |\n[long token omitted, 250 chars]"
    assert M.clean_markdown("![p](data:image/png;base64,AAAA)") == "![p](data:image/png omitted, 3 bytes)"


@pytest.mark.parametrize("size", [1, 7, 10, 100])
def test_parts_are_lossless(size):
    text = "ab\ncdé\n\nfgh" * 9
    parts = [text[a:b] for a, b in M.cut_parts(text, size)]
    assert "".join(parts) == text and all(len(p) <= size for p in parts)
    assert M.cut_parts("", size) == [(0, 0)]


def test_answers():
    body = "note\n<answer>\nSum up [a](https://a.example).\n## One\n- Fact (quote: \"it (really) is\"). [b](https://b.example)\n2. Two\n## Empty\n</answer>\nbye"
    out = M.parse_answer(body)
    assert out["summary"] == "Sum up [a](https://a.example)."
    first = out["themes"][0]["points"][0]
    assert first["quote"] == "it (really) is" and first["links"] == ["https://b.example"] and out["themes"][1]["points"] == []
    assert [c["url"] for c in out["citations"]] == ["https://a.example", "https://b.example"]
    assert M.parse_answer("<answer>\n</answer>") is None
    assert M.parse_answer("just text")["themes"][0]["title"] == "Findings"
    bullets = M.split_bullets("S\n## T\n- one (quote: \"q\") tail\n  more [x](https://w.example/a_(b))\nSources:\n- no")
    assert bullets == [{"theme": "T", "text": "one tail more [x](https://w.example/a_(b))", "urls": ["https://w.example/a_(b)"], "quote": "q"}]


def test_main_content():
    page = "<html><head><title>t</title></head><body><nav>" + "menu " * 5 + "</nav><article><h1>Head</h1><p>" + "Text with <a href='https://a.example/x(y)'>link</a> and <b>bold</b>. " * 20 + "</p><pre>code\nline</pre><ul><li>a<li>b</ul></article><footer>f</footer></body></html>"
    out = H.extract(page)
    assert out["text_share"] == 1.0 and out["extracted"].startswith("# Head\n\nText with [link](https://a.example/x\\(y\\)) and **bold**.") and "```\ncode\nline\n```" in out["extracted"] and out["extracted"].endswith("- a\n- b")
    assert H.extract("<article>a</article><article>b</article>")["extracted"] is None
    assert H.extract("<main><p>q</p></main><div class=answer>a</div>")["extracted"] is None


def test_result_pages():
    bing = '<ol id="b_results"><li class="b_algo"><h2><a href="https://www.bing.com/ck/a?!&&u=a1aHR0cHM6Ly9hLmV4YW1wbGUv&ntb=1">A <b>title</b></a></h2><div class="b_caption"><p>Snip</p></div></li><li class="b_algo"><h2><a href="/x">no</a></h2></li></ol>'
    assert H.read_results("bing", bing) == [{"title": "A title", "url": "https://a.example/", "snippet": "Snip", "rank": 0, "published_date": None}]
    start = '<div class="w-gl"><div style="display:none"><div class="result"><a class="result-link" href="https://trap.example/"><h2 class="wgl-title">x</h2></a></div></div><div class="result"><a class="result-link" href="https://a.example/"><h2 class="wgl-title">T</h2></a><p class="description">D</p></div></div>'
    assert [r["url"] for r in H.read_results("startpage", start)] == ["https://a.example/"]
    assert H.form_fields('<form action="/sp/search"><input name="sc" value="k"></form>', "/sp/search") == {"sc": "k"}

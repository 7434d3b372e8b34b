"""A small tolerant HTML tree, main content, Markdown, and readers of result pages, behind Arrow functions."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import functions as F

from .constants import ROW_CAP, SKIP_TAGS
from .lazy import arrow

from .urls import decode_percent

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {"address", "article", "aside", "blockquote", "dd", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "p": BLOCKS, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
MIN_SHARE = 0.6


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self):
        """Elements below in document order; no recursion, so depth does not matter."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def classes(self) -> set[str]:
        return set(self.attrs.get("class", "").split())

    def within(self, other: Node) -> bool:
        node = self
        while node is not None:
            if node is other:
                return True
            node = node.parent
        return False

    def texts(self, skip=()):
        stack = [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                yield node
            elif node is self or node.tag not in skip:
                stack += reversed(node.children)

    def text(self) -> str:
        return " ".join("".join(self.texts(("script", "style"))).split())


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def handle_starttag(self, tag, attrs):
        while self.at.tag in CLOSED_BY and tag in CLOSED_BY[self.at.tag]:
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def tree(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def text_chars(node: Node) -> int:
    return sum(len("".join(t.split())) for t in node.texts(SKIP_TAGS))


def _thread(node: Node) -> bool:
    return bool(node.classes() & {"answer", "comment"}) or node.attrs.get("itemprop") in ("suggestedAnswer", "acceptedAnswer", "comment") or node.attrs.get("itemtype", "").endswith(("/Answer", "/Comment"))


def main_content(root: Node) -> tuple[Node, float, bool] | None:
    """The only main, role=main or article, in this order of kinds, with its share of the page's text and whether answers of a thread stand outside."""
    total = text_chars(root)
    if not total:
        return None
    for wanted in (lambda n: n.tag == "main", lambda n: n.attrs.get("role") == "main", lambda n: n.tag == "article"):
        found = [n for n in root.walk() if wanted(n)]
        if len(found) == 1:
            share = text_chars(found[0]) / total
            if share < MIN_SHARE:
                return None
            return found[0], share, any(_thread(n) and not n.within(found[0]) for n in root.walk())
    return None


def _inline(node: Node) -> str:
    out = []
    for c in node.children:
        if isinstance(c, str):
            out.append(re.sub(r"\s+", " ", c))
        elif c.tag in SKIP_TAGS:
            continue
        elif c.tag == "br":
            out.append("\n")
        elif c.tag == "img":
            out.append(f"![{c.attrs.get('alt', '')}]({_dest(c.attrs['src'])})" if c.attrs.get("src") else "")
        elif c.tag == "code":
            out.append(f"`{''.join(c.texts())}`")
        elif c.tag == "a" and c.attrs.get("href"):
            out.append(f"[{_inline(c).strip()}]({_dest(c.attrs['href'])})")
        elif c.tag in ("b", "strong", "i", "em") and (inner := _inline(c).strip()):
            mark = "**" if c.tag in ("b", "strong") else "*"
            out.append(f"{mark}{inner}{mark}")
        else:
            out.append(_inline(c))
    return "".join(out)


def _dest(url: str) -> str:
    return f"<{url}>" if re.search(r"\s", url) else re.sub(r"([()])", r"\\\1", url)


def to_markdown(root: Node, depth: int = 0) -> str:
    """Markdown of a subtree without the skipped tags; beyond 400 levels only the text."""
    if depth > 400:
        return " ".join("".join(root.texts(SKIP_TAGS)).split())
    blocks, line = [], Node("span", {}, None)

    def flush():
        text = "\n".join(x.strip() for x in _inline(line).split("\n")).strip()
        if text:
            blocks.append(text)
        line.children = []

    for c in root.children:
        if isinstance(c, str) or (c.tag not in BLOCKS and c.tag not in SKIP_TAGS and not any(n.tag in BLOCKS for n in c.walk())):
            line.children.append(c)
            continue
        if c.tag in SKIP_TAGS:
            continue
        flush()
        if re.fullmatch("h[1-6]", c.tag):
            if text := _inline(c).strip():
                blocks.append("#" * int(c.tag[1]) + " " + " ".join(text.split()))
        elif c.tag == "pre":
            body = "".join(c.texts()).strip("\n")
            mark = "`" * max(3, 1 + max((len(m) for m in re.findall("`+", body)), default=0))
            blocks.append(f"{mark}\n{body}\n{mark}")
        elif c.tag == "table":
            cells = [[" ".join(_inline(x).split()).replace("|", r"\|") for x in r.walk() if x.tag in ("td", "th")] for r in c.walk() if r.tag == "tr"]
            lines = ["| " + " | ".join(r) + " |" for r in cells if r]
            if lines:
                blocks.append("\n".join([lines[0], "|" + " --- |" * max(1, lines[0].count(" | ") + 1), *lines[1:]]))
        elif c.tag in ("ul", "ol"):
            items = [n for n in c.children if isinstance(n, Node) and n.tag == "li"]
            marks = [f"{i}." if c.tag == "ol" else "-" for i in range(1, len(items) + 1)]
            lines = [f"{m} " + to_markdown(n, depth + 1).replace("\n", "\n" + " " * (len(m) + 1)) for m, n in zip(marks, items, strict=True)]
            if lines:
                blocks.append("\n".join(lines))
        elif c.tag == "blockquote":
            if text := to_markdown(c, depth + 1):
                blocks.append("\n".join("> " + x for x in text.split("\n")))
        elif c.tag == "hr":
            blocks.append("---")
        elif text := to_markdown(c, depth + 1):
            blocks.append(text)
    flush()
    return "\n\n".join(blocks)


def extract(html: str) -> dict:
    """Markdown of the whole page, and of its main content if there is one, with the measures of the choice between them."""
    root = tree(html)
    whole = to_markdown(root)
    found = main_content(root)
    if not found:
        return {"baseline": whole, "extracted": None, "text_share": None, "thread_outside": None}
    node, share, outside = found
    holder = Node("#root", {}, None)
    holder.children = [node]
    return {"baseline": whole, "extracted": to_markdown(holder), "text_share": share, "thread_outside": outside}


EXTRACTION = "struct<baseline:string,extracted:string,text_share:double,thread_outside:boolean>"


@arrow(EXTRACTION)
def extraction(html: pa.Array) -> pa.Array:
    kind = pa.struct([("baseline", pa.string()), ("extracted", pa.string()), ("text_share", pa.float64()), ("thread_outside", pa.bool_())])
    return pa.array([None if x is None else extract(x) for x in html.to_pylist()], kind)


def _query(url: str, name: str) -> str | None:
    m = re.search(rf"[?&]{name}=([^&#]*)", url)
    return m[1] if m else None


def _web(url: str | None) -> str | None:
    return url if url and re.match("https?://", url) else None


def target(provider: str, href: str) -> str | None:
    """The page a result link leads to; null for links that are not results."""
    import base64

    url = href.strip()
    if provider == "duckduckgo":
        if "duckduckgo.com/l/" in url:
            return _web(decode_percent(_query(url, "uddg") or ""))
        return _web("https:" + url if url.startswith("//") else url)
    if provider == "bing" and "bing.com/ck/a?" in url:
        u = _query(url, "u") or ""
        try:
            return _web(base64.b64decode(u[2:] + "=" * (-len(u[2:]) % 4), b"-_", validate=True).decode()) if u.startswith("a1") else None
        except ValueError:
            return None
    if provider == "yahoo" and (m := re.search(r"/RU=.*?(http.*?)(?:/RS|/RK|$)", url)):
        return _web(decode_percent(m[1]))
    if provider == "yahoo" and "r.search.yahoo.com" in url:
        return None
    if provider == "startpage" and re.search(r"(^|\.)startpage\.com$", (urlsplit(url).hostname or "") if _web(url) else ""):
        return None
    return _web(url)


def _one(node: Node, wanted) -> Node | None:
    return next((n for n in node.walk() if wanted(n)), None)


def _has(tag: str | None, *classes: str):
    return lambda n: (tag is None or n.tag == tag) and set(classes) <= n.classes()


def _under(parent, child):
    """child elements that stand below an element of the parent kind."""

    def found(n: Node) -> bool:
        up = n.parent
        while up is not None and child(n):
            if parent(up):
                return True
            up = up.parent
        return False

    return found


# Result pages: row, link, title (null: the link's text), snippet of each provider.
_H23 = lambda n: n.tag in ("h2", "h3")
READERS = {
    "duckduckgo": (_has("div", "result"), _has("a", "result__a"), None, _has(None, "result__snippet")),
    "bing": (_has("li", "b_algo"), _under(_has("h2"), _has("a")), None, _under(_has("div", "b_caption"), _has("p"))),
    "brave": (_has("div", "result-wrapper"), lambda n: n.tag == "a" and n.parent is not None and n.parent.tag == "div" and "result-content" in n.parent.classes(), _has(None, "title", "search-snippet-title"), _under(_has(None, "generic-snippet"), _has(None, "content"))),
    "yahoo": (_has("div", "algo-sr"), _under(_has(None, "compTitle"), _has("a")), _has("h3"), _under(_has(None, "compText"), _has("p"))),
    "startpage": (_has("div", "result"), _has("a", "result-link"), _has("h2", "wgl-title"), _has("p", "description")),
}


def _hidden(node: Node) -> bool:
    while node is not None:
        if re.search(r"display:\s*none|visibility:\s*hidden", node.attrs.get("style", "")) or "hidden" in node.attrs or node.attrs.get("aria-hidden") == "true":
            return True
        node = node.parent
    return False


def read_results(provider: str, html: str) -> list[dict]:
    """Rows of a result page: title, url, snippet and rank from 0, at most the cap."""
    if provider not in READERS:
        return []
    row, link, title, snippet = READERS[provider]
    out, seen = [], set()
    for node in tree(html).walk():
        if not row(node) or (provider == "startpage" and _hidden(node)):
            continue
        a = _one(node, link)
        url = target(provider, a.attrs.get("href", "")) if a is not None else None
        head = (_one(node, title) or (_one(node, _H23) if provider == "startpage" else None) or a) if title and a is not None else a
        text = head.text() if head is not None else ""
        if not url or not text or (provider in ("startpage", "duckduckgo") and url in seen):
            continue
        seen.add(url)
        body = _one(node, snippet)
        date = _one(node, lambda n: n.tag == "span" and n.parent is not None and "result__extras__url" in n.parent.classes() and re.match(r"\s*\d{4}-\d\d-\d\d", n.text()) is not None) if provider == "duckduckgo" else None
        out.append({"title": text, "url": url, "snippet": body.text() if body is not None else "", "rank": len(out), "published_date": date.text()[:10] if date is not None else None})
        if len(out) == ROW_CAP:
            break
    return out


ROWS = "array<struct<title:string,url:string,snippet:string,rank:int,published_date:string>>"


@arrow(ROWS)
def result_rows(provider: pa.Array, html: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("title", pa.string()), ("url", pa.string()), ("snippet", pa.string()), ("rank", pa.int32()), ("published_date", pa.string())]))
    return pa.array([None if h is None else read_results(p, h) for p, h in zip(provider.to_pylist(), html.to_pylist(), strict=True)], kind)


def form_fields(html: str, action: str | None = None) -> dict[str, str] | None:
    """Named inputs of the first form with this action, or of the last one that asks for a further page."""
    forms = [n for n in tree(html).walk() if n.tag == "form"]
    if action is not None:
        forms = [f for f in forms if f.attrs.get("action") == action]
    fields = [{n.attrs["name"]: n.attrs.get("value", "") for n in f.walk() if n.tag == "input" and n.attrs.get("name")} for f in forms]
    if action is None:
        fields = [f for f in fields if "s" in f and "q" in f][-1:]
    return fields[0] if fields else None


@arrow("map<string,string>")
def next_form(html: pa.Array) -> pa.Array:
    return pa.array([None if x is None or (f := form_fields(x)) is None else list(f.items()) for x in html.to_pylist()], pa.map_(pa.string(), pa.string()))


@arrow("map<string,string>")
def search_form(html: pa.Array) -> pa.Array:
    return pa.array([None if x is None or (f := form_fields(x, "/sp/search")) is None else list(f.items()) for x in html.to_pylist()], pa.map_(pa.string(), pa.string()))

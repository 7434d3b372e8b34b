"""Line-oriented Markdown work and the answer grammar, as plain Python behind Arrow functions and a table function."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import functions as F

from .constants import TRACKING
from .lazy import arrow

LONG_TOKEN = 200
_DEST = r"(?:<[^\n]*?>|(?:\\.|[^)\s\\])+)"
_TITLE = r'(?:\s+"[^"]*")?'
_IMAGE = rf"!\[([^\]]*)\]\(({_DEST}){_TITLE}\)"
_INLINE = re.compile(rf"(?P<code>`[^`\n]*`)|!\[(?P<alt>[^\]]*)\]\((?P<src>{_DEST}){_TITLE}\)|\[(?P<text>(?:!\[[^\]]*\]\({_DEST}{_TITLE}\)|[^\]])*)\]\((?P<href>{_DEST}){_TITLE}\)")
_IMAGES = re.compile(_IMAGE)
_LONG = re.compile(rf"[!-~]{{{LONG_TOKEN},}}")


def fence_of(line: str) -> tuple[str, int] | None:
    """Mark and length of the fence that a line opens."""
    m = re.match(r"(`{3,}|~{3,})(.*)$", line.lstrip(), re.S)
    return (m[1][0], len(m[1])) if m and not (m[1][0] == "`" and "`" in m[2]) else None


def closes(line: str, fence: tuple[str, int]) -> bool:
    return re.fullmatch(rf"{re.escape(fence[0])}{{{fence[1]},}}\s*", line.lstrip()) is not None


def fenced(lines: list[str]):
    """(kind, lines) runs: fence for a fenced block with its marks, text for each line outside."""
    block, fence = [], None
    for line in lines:
        if fence:
            block.append(line)
            if closes(line, fence):
                yield "fence", block
                block, fence = [], None
        elif fence := fence_of(line):
            block = [line]
        else:
            yield "text", [line]
    if block:
        yield "fence", block


def fenced_blocks(markdown: str) -> list[str]:
    return ["\n".join(b) for kind, b in fenced(markdown.split("\n")) if kind == "fence"]


def table_rows(markdown: str) -> list[str]:
    return [t for t in (x.strip() for x in markdown.split("\n")) if t.startswith("|") and "|" in t[1:]]


def strip_tracking(url: str) -> str:
    base, mark, rest = url.partition("?")
    query, hash_, fragment = rest.partition("#")
    kept = [p for p in query.split("&") if p and not (n := p.split("=")[0].lower()).startswith("utm_") and n not in TRACKING]
    return url if not mark else base + ("?" + "&".join(kept) if kept else "") + hash_ + fragment


def _data_label(url: str) -> str:
    meta, _, payload = url[5:].partition(",")
    kind, *more = meta.split(";")
    size = len(payload.encode()) * 3 // 4 if any(x.lower() == "base64" for x in [kind, *more]) else len(payload.encode())
    return f"data:{kind.strip() or 'unknown'} omitted, " + (f"{size} bytes" if size < 1024 else f"{(size + 512) // 1024} KB")


def _inner(dest: str) -> str:
    return dest[1:-1] if dest[:1] == "<" and dest[-1:] == ">" and len(dest) > 1 else dest


def _image(alt: str, dest: str) -> str:
    url = _inner(dest)
    if url[:5].lower() == "data:":
        return f"![{alt}]({_data_label(url)})"
    return alt if alt.strip() else ""


def _link(text: str, dest: str) -> str:
    shown = _IMAGES.sub(lambda m: _image(m[1], m[2]), text)
    shown = shown if shown == text else shown.strip()
    url = _inner(dest)
    if url[:5].lower() == "data:":
        return f"[{shown}]({_data_label(url)})"
    if not shown.strip():
        return ""
    clean = strip_tracking(url)
    return f"[{shown}]({clean})" if url == dest else f"[{shown}](<{clean}>)"


def clean_line(line: str) -> str:
    """Images as their text, empty links out, tracking parameters out, long tokens and embedded data as labels."""
    short = lambda t: _LONG.sub(lambda m: f"[long token omitted, {len(m[0])} chars]", t)
    out, at = [], 0
    for m in _INLINE.finditer(line):
        out.append(short(line[at : m.start()]))
        out.append(m[0] if m["code"] is not None else _image(m["alt"], m["src"]) if m["src"] is not None else _link(m["text"], m["href"]))
        at = m.end()
    return "".join(out) + short(line[at:])


def clean_markdown(markdown: str) -> str:
    """Cleaned lines; fenced blocks and table rows as they are; runs of blank lines as one, none at the ends."""
    out, blank = [], False
    for kind, lines in fenced(markdown.split("\n")):
        if kind == "text" and not lines[0].strip():
            blank = bool(out)
            continue
        if blank:
            out.append("")
            blank = False
        out += lines if kind == "fence" or lines[0].lstrip().startswith("|") else [clean_line(lines[0])]
    return "\n".join(out)


def cut_parts(text: str, size: int) -> list[tuple[int, int]]:
    """Ranges of characters of at most size, each ending after the last newline in its final tenth if there is one."""
    size, at, out = max(1, size), 0, []
    while len(text) - at > size:
        newline = text.rfind("\n", at + size - size // 10, at + size)
        end = newline + 1 if newline >= 0 else at + size
        out.append((at, end))
        at = end
    return [*out, (at, len(text))]


def links_in(text: str) -> list[tuple[str | None, str]]:
    """(title, url) of inline http links in order; brackets are taken at their first closing ones."""
    out, at = [], 0
    while (a := text.find("[", at)) >= 0 and (b := text.find("]", a)) >= 0:
        if text[b + 1 : b + 2] != "(":
            at = b + 1
            continue
        c = text.find(")", b + 2)
        if c < 0:
            break
        url = text[b + 2 : c].strip()
        if re.fullmatch(r"https?://\S*", url):
            out.append((text[a + 1 : b].strip() or None, url))
        at = c + 1
    return out


def split_quote(raw: str, gap: bool) -> tuple[str, str | None]:
    """A bullet's text and the quote of its last (quote: "...") group. gap: words after the group keep a space before them."""
    marks = [m for m in re.finditer(re.escape("(quote:"), raw, re.I)]
    if not marks:
        return (raw.strip() if gap else raw), None
    start, after = marks[-1].start(), raw[marks[-1].end() :]
    last = max(after.rfind(q) for q in '"”“')
    close = after.find(")", last + 1) if last >= 0 else -1
    close = close if close >= 0 else after.rfind(")")
    inner, tail = (after[:close], after[close + 1 :]) if close >= 0 else (after, "")
    space = " " if gap and tail[:1].isspace() else ""
    return (raw[:start].rstrip() + space + tail.strip()).strip(), inner.strip().strip('"“”').strip() or None


def answer_block(body: str) -> str:
    """The last closed answer block; else what follows the last open tag; else all."""
    opened, block, at = None, None, 0
    for line in re.findall(r"[^\n]*\n|[^\n]+$", body):
        tag = line.strip().lower()
        if tag == "<answer>":
            opened = at + len(line)
        elif tag == "</answer>" and opened is not None:
            block, opened = (opened, at), None
        at += len(line)
    if block:
        return body[block[0] : block[1]]
    return body[opened:] if opened is not None else body


def _bullet(line: str) -> str | None:
    m = re.match(r"(?:[-*] |[0-9]+\. )(.*)$", line, re.S)
    return (m[1].strip() or None) if m else None


def _point(raw: str) -> dict:
    text, quote = split_quote(raw, gap=False)
    return {"text": text, "links": list(dict.fromkeys(u for _, u in links_in(raw))), "quote": quote}


def _citations(text: str, known: dict[str, str | None] | None = None) -> list[dict]:
    first: dict[str, str | None] = {}
    for title, url in links_in(text):
        first.setdefault(url, title)
    return [{"url": u, "title": (known or first)[u]} for u in first]


def parse_answer(body: str) -> dict | None:
    """Summary, themes of points and citations of a reply; null if there is nothing in it."""
    body = answer_block(body)
    if not body.strip():
        return None
    citations = _citations(body)
    known = {c["url"]: c["title"] for c in citations}
    head: list[str] = []
    themes: list[tuple[str, list[str]]] = []
    for line in (x.strip() for x in body.split("\n")):
        if line.startswith("## ") or line == "##":
            if title := line[3:].strip():
                themes.append((title, []))
            elif line == "##" and (themes or line):
                (themes[-1][1] if themes else head).append(line)
        elif line:
            (themes[-1][1] if themes else head).append(line)
    summary = " ".join(head) or " ".join(body.split()[:24])
    if not themes:
        sections = [{"title": "Findings", "points": [_point(summary)], "citations": citations}]
    else:
        sections = []
        for title, lines in themes:
            points = [_point(b) for b in map(_bullet, lines) if b] or ([_point(" ".join(lines))] if lines else [])
            sections.append({"title": title, "points": points, "citations": _citations("\n".join(lines), known)})
        if not any(s["points"] for s in sections):
            sections[0]["points"].append(_point(summary))
    return {"summary": summary, "themes": sections, "citations": citations}


_NESTED = re.compile(r"\]\((https?://(?:[^\s()]|\([^\s()]*\))+)\)")


def split_bullets(answer: str) -> list[dict]:
    """Bullets of a rendered answer up to its sources: theme, text, urls and quote; indented lines continue a bullet."""
    raws: list[list[str]] = []
    theme = ""
    for line in answer.split("\n"):
        line = line.removesuffix("\r")
        if line.rstrip() == "Sources:":
            break
        if line.startswith("## "):
            theme = line[3:].strip()
        elif line.startswith(("- ", "* ")):
            raws.append([theme, line[2:].strip()])
        elif line[:1] in (" ", "\t") and line.strip() and raws:
            raws[-1][1] += " " + line.strip()
    out = []
    for theme, raw in raws:
        text, quote = split_quote(raw, gap=True)
        out.append({"theme": theme, "text": text, "urls": list(dict.fromkeys(_NESTED.findall(text))), "quote": quote})
    return out


_CITATION = pa.struct([("url", pa.string()), ("title", pa.string())])
_POINT = pa.struct([("text", pa.string()), ("links", pa.list_(pa.string())), ("quote", pa.string())])
_THEME = pa.struct([("title", pa.string()), ("points", pa.list_(_POINT)), ("citations", pa.list_(_CITATION))])
SYNTHESIS = "struct<summary:string,themes:array<struct<title:string,points:array<struct<text:string,links:array<string>,quote:string>>,citations:array<struct<url:string,title:string>>>>,citations:array<struct<url:string,title:string>>>"
BULLETS = "array<struct<theme:string,text:string,urls:array<string>,quote:string>>"


def _each(f, column: pa.Array, type_) -> pa.Array:
    return pa.array([None if x is None else f(x) for x in column.to_pylist()], type_)


@arrow("string")
def clean(markdown: pa.Array) -> pa.Array:
    return _each(clean_markdown, markdown, pa.string())


@arrow(SYNTHESIS)
def synthesis(body: pa.Array) -> pa.Array:
    return _each(parse_answer, body, pa.struct([("summary", pa.string()), ("themes", pa.list_(_THEME)), ("citations", pa.list_(_CITATION))]))


@arrow(BULLETS)
def bullets(answer: pa.Array) -> pa.Array:
    return _each(split_bullets, answer, pa.list_(pa.struct([("theme", pa.string()), ("text", pa.string()), ("urls", pa.list_(pa.string())), ("quote", pa.string())])))


@arrow("array<struct<title:string,url:string>>")
def links(text: pa.Array) -> pa.Array:
    return _each(lambda t: [{"title": a, "url": b} for a, b in links_in(t)], text, pa.list_(pa.struct([("title", pa.string()), ("url", pa.string())])))


@arrow("array<string>")
def blocks(markdown: pa.Array) -> pa.Array:
    return _each(fenced_blocks, markdown, pa.list_(pa.string()))


@arrow("array<string>")
def rows(markdown: pa.Array) -> pa.Array:
    return _each(table_rows, markdown, pa.list_(pa.string()))



class PageParts:
    """page_parts(text, size): the parts of a page, which joined give it back."""

    def eval(self, text: str, size: int):
        ranges = cut_parts(text or "", size)
        for i, (a, b) in enumerate(ranges):
            yield i + 1, len(ranges), (text or "")[a:b], a, b


def register(spark) -> None:
    """SQL names of the functions of this library: page_parts as a table function and the scalar ones."""
    from . import text, urls

    spark.udtf.register("page_parts", F.udtf(PageParts, returnType="part int, parts int, text string, start int, end int"))
    scalars = {"clean_markdown": (clean, "string"), "parse_answer": (synthesis, SYNTHESIS), "url_key": (urls.url_key_exact, "string"), "decode_html": (text.decode_html, "string"), "percent_decode": (urls.percent_decode, "string"), "fnv1a_64": (text.fnv1a_64, "string")}
    for name, (f, kind) in scalars.items():
        spark.udf.register(name, F.arrow_udf(f.__wrapped__, kind))


@arrow("array<struct<start:int,end:int>>")
def part_ranges(text: pa.Array, size: pa.Array) -> pa.Array:
    """Ranges of the parts of a page, counted in characters; the vectorised form of page_parts."""
    out = [[{"start": a, "end": b} for a, b in cut_parts(t or "", s)] for t, s in zip(text.to_pylist(), size.to_pylist(), strict=True)]
    return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))


def parts(pages, size: int, text: str = "text"):
    """pages with part, parts, start, end and part_text: a row for each part."""
    cut = pages.withColumn("_ranges", part_ranges(F.coalesce(text, F.lit("")), F.lit(size)))
    each = cut.withColumn("parts", F.size("_ranges")).select("*", F.posexplode("_ranges").alias("part", "_r")).drop("_ranges")
    body = F.substring(F.coalesce(text, F.lit("")), F.col("_r.start") + 1, F.col("_r.end") - F.col("_r.start"))
    return each.select(*[c for c in each.columns if c not in ("part", "_r")], (F.col("part") + 1).alias("part"), F.col("_r.start").alias("start"), F.col("_r.end").alias("end"), body.alias("part_text"))


def deliver(requests, pages, size: int):
    """requests (page_id, part) with part_text, or error past the end."""
    cut = parts(pages, size).select("page_id", "part", "parts", "part_text")
    n = cut.groupBy("page_id").agg(F.max("parts").alias("parts"))
    out = requests.join(n, "page_id", "left").join(cut.drop("parts"), ["page_id", "part"], "left")
    return out.withColumn("error", F.when(F.col("parts").isNull(), "page was not fetched").when(F.col("part") > F.col("parts"), F.format_string("part %d is past the end: the page has %d", "part", "parts")))

"""URL identity and rewriting as Columns; the exact WHATWG form as an Arrow function."""

from __future__ import annotations

import ipaddress
import re
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import TRACKING
from .lazy import arrow

_PORTS = {"http": "80", "https": "443", "ftp": "21", "ws": "80", "wss": "443"}
_KEEP = {"path": set(' "#<>?`{}^'), "query": set(" \"#<>'")}


def _escape(text: str, part: str) -> str:
    out = []
    for ch in text:
        if ch in _KEEP[part] or ord(ch) < 0x21 or ord(ch) > 0x7E:
            out += [f"%{b:02X}" for b in ch.encode()]
        else:
            out.append(ch)
    return "".join(out)


def _host(raw: str) -> str | None:
    if raw.startswith("["):
        try:
            return f"[{ipaddress.IPv6Address(raw.strip('[]')).compressed}]"
        except ValueError:
            return None
    raw = unquote_to_bytes(raw).decode("utf-8", "replace").lower()
    try:
        host = raw if raw.isascii() else raw.encode("idna").decode()
    except UnicodeError:
        return None
    if not host or re.search(r"[\x00-\x20#/:<>?@\[\\\]^|%]", host):
        return None
    pieces = host.rstrip(".").split(".")
    if re.fullmatch(r"[0-9]+|0x[0-9a-f]*", pieces[-1]):
        return _ipv4(pieces)
    return host


def _ipv4(pieces: list[str]) -> str | None:
    """Dotted numbers in any base and number of parts."""
    if len(pieces) > 4:
        return None
    try:
        numbers = [int(p or "0", 16) if p.startswith("0x") and len(p) > 2 else 0 if p == "0x" else int(p, 8) if len(p) > 1 and p[0] == "0" else int(p) for p in pieces]
    except ValueError:
        return None
    *front, last = numbers
    if any(x > 255 for x in front) or last >= 256 ** (5 - len(numbers)):
        return None
    value = last + sum(x << (8 * (3 - i)) for i, x in enumerate(front))
    return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))


def parse(raw: str) -> dict | None:
    """scheme, host, port, path, query and fragment of an absolute URL with a special scheme; others have no host; null where there is none."""
    text = re.sub(r"[\t\n\r]", "", raw.strip("".join(map(chr, range(33)))))
    m = re.match(r"([A-Za-z][A-Za-z0-9+.\-]*):(.*)", text, re.S)
    if not m:
        return None
    scheme, rest = m[1].lower(), m[2]
    rest, mark, fragment = rest.partition("#")
    fragment = fragment if mark else None
    rest, mark, query = rest.partition("?")
    query = _escape(query, "query") if mark else None
    if scheme not in _PORTS:
        return {"scheme": scheme, "host": None, "port": None, "path": rest, "query": query, "fragment": fragment}
    rest = rest.replace("\\", "/").lstrip("/")
    authority, slash, path = rest.partition("/")
    authority = authority.rpartition("@")[2]
    m = re.fullmatch(r"(\[[^\]]*\]|[^:]*)(?::([0-9]*))?", authority)
    host = _host(m[1]) if m else None
    if host is None or (m[2] and int(m[2]) > 65535):
        return None
    port = str(int(m[2])) if m[2] else None
    out: list[str] = []
    pieces = path.split("/") if slash else [""]
    for i, piece in enumerate(pieces):
        plain = re.sub("%2e", ".", piece, flags=re.I)
        if plain == "..":
            out = out[:-1]
        elif plain != ".":
            out.append(_escape(piece, "path"))
        if plain in (".", "..") and i == len(pieces) - 1:
            out.append("")
    return {"scheme": scheme, "host": host, "port": None if port == _PORTS[scheme] else port, "path": "/" + "/".join(out), "query": query, "fragment": fragment}


def exact_key(raw: str) -> str:
    """The identity of a URL under which results are the same page."""
    url = parse(raw)
    if url is None or url["host"] is None:
        return raw.strip()
    path = "" if url["path"] == "/" else url["path"].removesuffix("/")
    return url["host"].removeprefix("www.") + path + (f"?{url['query']}" if url["query"] is not None else "")


def canonical(raw: str) -> str | None:
    """The serialised form of an absolute http or https URL; null for others."""
    url = parse(raw)
    if url is None or url["scheme"] not in ("http", "https"):
        return None
    port = f":{url['port']}" if url["port"] else ""
    tail = (f"?{url['query']}" if url["query"] is not None else "") + (f"#{url['fragment']}" if url["fragment"] is not None else "")
    return f"{url['scheme']}://{url['host']}{port}{url['path']}{tail}"


def _arrow(function, type_):
    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else function(x) for x in column.to_pylist()], type_)

    return run


@arrow("string")
def url_key_exact(url: pa.Array) -> pa.Array:
    return _arrow(exact_key, pa.string())(url)


@arrow("string")
def canonical_url(url: pa.Array) -> pa.Array:
    return _arrow(canonical, pa.string())(url)


#: Absolute URLs for which the Column form below gives the exact key.
PLAIN = r"^https?://[A-Za-z0-9](?:[A-Za-z0-9.\-]*[A-Za-z])?(?::[0-9]{1,4})?(?:[/?#][A-Za-z0-9/?#&=;:@!$()*+,._~%\-]*)?$"
_DOTS = r"/(?:\.|%2[eE]){1,2}(?:[/?#]|$)"


def plain_key(url: Column) -> Column:
    """The identity of plain ASCII http URLs, JVM-side: host without www., path without its last slash, query; no port, no fragment. Null for others."""
    text = F.trim(url)
    host = F.regexp_replace(F.lower(F.regexp_extract(text, r"^[a-zA-Z]+://([^/?#:]*)", 1)), r"^www\.", "")
    path = F.regexp_extract(text, r"^[a-zA-Z]+://[^/?#]*(/[^?#]*)", 1)
    query = F.regexp_extract(text, r"^[^?#]*(\?[^#]*)", 1)
    return F.when(is_plain(url), F.concat(host, F.when(path == "/", "").otherwise(F.regexp_replace(path, "/$", "")), query))


def url_key(url: Column) -> Column:
    """The identity of a URL: plain ones in the JVM, and only the others by a parser in Python; text that is no URL trimmed."""
    return F.coalesce(plain_key(url), url_key_exact(F.when(~is_plain(url), url)))


def is_plain(url: Column) -> Column:
    """Whether url_key is exact for this URL."""
    text = F.trim(url)
    return text.rlike(r"(?i)" + PLAIN) & ~text.rlike(_DOTS)


def origin(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^(https?://[^/?#]+)", 1))


def strip_tracking(url: Column) -> Column:
    """The URL without tracking parameters; path, other parameters and fragment stay."""
    base, rest = F.substring_index(url, "?", 1), F.expr("1")
    rest = F.substring(url, F.length(base) + 2, F.length(url))
    query, fragment = F.substring_index(rest, "#", 1), F.regexp_extract(rest, r"(?s)^[^#]*(#.*)$", 1)
    name = lambda p: F.lower(F.substring_index(p, "=", 1))
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~name(p).startswith("utm_") & ~name(p).isin(TRACKING))
    joined = F.array_join(kept, "&")
    return F.when(~F.contains(url, F.lit("?")), url).otherwise(F.concat(base, F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise(""), fragment))


def percent_encode(text: Column) -> Column:
    """Form encoding: letters, digits and - _ . ~ stay, a space becomes +."""
    return F.regexp_replace(F.regexp_replace(F.url_encode(text), r"%7E", "~"), r"\*", "%2A")


def decode_percent(raw: str) -> str:
    """Form decoding that keeps broken escapes and replaces bytes that are not UTF-8.

    An escape at the very end needs a character after it, as in the decoder this agrees with."""
    raw_bytes, out, i = raw.encode(), bytearray(), 0
    while i < len(raw_bytes):
        pair = raw_bytes[i + 1 : i + 3]
        if raw_bytes[i] == 37 and i + 2 < len(raw_bytes) and re.fullmatch(rb"[0-9A-Fa-f]{2}", pair):
            out.append(int(pair, 16))
            i += 3
        else:
            out.append(32 if raw_bytes[i] == 43 else raw_bytes[i])
            i += 1
    return out.decode("utf-8", "replace")


@arrow("string")
def percent_decode(text: pa.Array) -> pa.Array:
    return _arrow(decode_percent, pa.string())(text)


def base64url_encode(text: Column) -> Column:
    """Text to unpadded base64url, in one line at any length (Spark's base64 breaks lines after 76 characters)."""
    return F.translate(F.base64(text.cast("binary")), "+/=\r\n", "-_")


def base64url_decode(text: Column) -> Column:
    """Unpadded base64url to text; null for other characters or bytes that are not UTF-8."""
    plain = F.translate(F.regexp_replace(text, "=", ""), "-_", "+/")
    whole = F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), "=")
    # one character over a multiple of four carries no byte
    whole = F.when(F.length(plain) % 4 == 1, F.substring(plain, F.lit(1), F.length(plain) - 1)).otherwise(whole)
    return F.when(text.rlike("^[A-Za-z0-9_=-]*$"), F.try_validate_utf8(F.try_to_binary(whole, F.lit("base64")).cast("string")))


def _http(url: Column) -> Column:
    return F.when(url.rlike("^https?://"), url)


def unwrap_duckduckgo(href: Column) -> Column:
    """The target of a result link: a redirect's uddg parameter, a protocol-relative link, or the link itself."""
    text = F.trim(href)
    target = percent_decode(F.regexp_extract(text, r"[?&]uddg=([^&#]*)", 1))
    relative = F.when(text.startswith("//"), F.concat(F.lit("https:"), text)).otherwise(text)
    return F.when(F.contains(text, F.lit("duckduckgo.com/l/")), _http(target)).otherwise(_http(relative))


def unwrap_bing(href: Column) -> Column:
    text = F.trim(href)
    inner = base64url_decode(F.regexp_extract(text, r"[?&]u=a1([^&#]*)", 1))
    return F.when(F.contains(text, F.lit("bing.com/ck/a?")), _http(inner)).otherwise(_http(text))


def unwrap_yahoo(href: Column) -> Column:
    text = F.trim(href)
    inner = percent_decode(F.regexp_extract(text, r"/RU=.*?(http.*?)(?:/RS|/RK|$)", 1))
    return F.when(text.rlike(r"/RU="), _http(inner)).when(F.contains(text, F.lit("r.search.yahoo.com")), F.lit(None)).otherwise(_http(text))


def clean_startpage(href: Column) -> Column:
    text = F.trim(href)
    host = F.lower(F.regexp_extract(text, r"^https?://(?:[^/@]*@)?([^/:?#]*)", 1))
    return F.when(host.rlike(r"(^|\.)startpage\.com$"), F.lit(None)).otherwise(_http(text))


def duckduckgo_query(query: Column) -> Column:
    """Without before: and after: words."""
    return F.array_join(F.filter(F.split(F.trim(query), r"(?U)\s+"), lambda w: ~F.lower(w).rlike("^(before|after):")), " ")


def bing_language(market: Column) -> Column:
    return F.lower(F.split_part(market, F.lit("-"), F.lit(1)))


def yahoo_page(query: Column, page: Column) -> Column:
    """The query string of a page, the first being 0."""
    first = F.concat(F.lit("p="), percent_encode(query))
    return F.when(page == 0, F.concat(first, F.lit("&iscqry="))).otherwise(F.concat(first, F.lit("&b="), (page * 7 + 1).cast("string"), F.lit("&pz=7")))


def is_crate_name(name: Column) -> Column:
    return name.rlike("^[A-Za-z][A-Za-z0-9_-]{0,63}$")


def crate_index_path(name: Column) -> Column:
    low = F.lower(name)
    return (
        F.when(F.length(low) == 1, F.concat(F.lit("1/"), low))
        .when(F.length(low) == 2, F.concat(F.lit("2/"), low))
        .when(F.length(low) == 3, F.concat(F.lit("3/"), F.substring(low, 1, 1), F.lit("/"), low))
        .otherwise(F.concat_ws("/", F.substring(low, 1, 2), F.substring(low, 3, 2), low))
    )


def crate_docs_url(name: Column) -> Column:
    return F.concat(F.lit("https://docs.rs/"), name)


def crate_page(url: Column) -> Column:
    """struct(name, version) of a crate's registry page; nulls for other URLs."""
    pattern = r"^https?://(?:www\.)?crates\.io/crates/([A-Za-z][A-Za-z0-9_-]{0,63})(?:/([^/?#]+))?/?(?:[?#].*)?$"
    name, version = F.regexp_extract(url, pattern, 1), F.regexp_extract(url, pattern, 2)
    return F.struct(F.nullif(name, F.lit("")).alias("name"), F.nullif(version, F.lit("")).alias("version"))


def forbidden_v4(ip: Column) -> Column:
    """Whether a dotted IPv4 address is not a public one; null for other text."""
    part = lambda i: F.regexp_extract(ip, r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$", i).try_cast("int")
    a, b, c, d = (part(i) for i in range(1, 5))
    bad = (
        a.isin(0, 10, 127) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))
        | ((a == 192) & (b == 0) & (c == 2)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113)) | a.between(224, 239)
        | ((a == 255) & (b == 255) & (c == 255) & (d == 255))
    )
    return F.when(F.greatest(a, b, c, d) <= 255, bad)


_V4_NETS = [ipaddress.ip_network(n) for n in ("0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.2.0/24", "192.168.0.0/16", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "255.255.255.255/32")]
_V6_NETS = [ipaddress.ip_network(n) for n in ("fe80::/10", "fc00::/7", "ff00::/8", "2001:db8::/32", "3fff::/20")]


def is_forbidden(text: str) -> bool | None:
    """The same for IPv4 and IPv6 addresses, with the IPv4 address that an IPv6 one holds."""
    try:
        ip = ipaddress.ip_address(text.strip("[]"))
    except ValueError:
        return None
    if ip.version == 6:
        value = int(ip)
        if value >> 32 not in (0, 0xFFFF):
            return any(ip in n for n in _V6_NETS)
        ip = ipaddress.IPv4Address(value & 0xFFFFFFFF)
    return any(ip in n for n in _V4_NETS)


@arrow("boolean")
def forbidden_ip(ip: pa.Array) -> pa.Array:
    return _arrow(is_forbidden, pa.bool_())(ip)


@arrow("boolean")
def forbidden_host(url: pa.Array) -> pa.Array:
    """Whether a URL's host is an address that may not be fetched; names pass; null where there is no URL."""
    return _arrow(lambda x: None if (p := parse(x)) is None else bool(p["host"] and is_forbidden(p["host"])), pa.bool_())(url)

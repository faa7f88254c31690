"""Web pages: their text, their safety, their addresses."""

from __future__ import annotations

import html as entities
import ipaddress
import re
import sys
from html.entities import name2codepoint as codepoints
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SILENT = {"script", "style", "noscript", "template"}
_CHROME = {"nav", "header", "footer", "aside", "form"}
_VOID = set("area base br col embed frame hr img input link meta source track wbr".split())
_BLOCK = set("address article blockquote br dd div dl dt figcaption figure h1 h2 h3 h4 h5 h6 hr li main ol p pre section table tr ul".split())
# fixed values: what a shown page may not hold
_REMOVED = set("script iframe frame frameset object embed applet base form meta link".split())
_GOES = {"href", "xlink:href", "action", "formaction"}
_LOADS = {"src", "poster"}


def visible_text(page: Column) -> Column:
    """Text nodes of the body, joined without a separator, as a browser walks them; scripts, styles and templates left out.

    For well-formed pages regular expressions do: comments and silent elements go, then tags, then entities.
    """
    text = F.regexp_replace(page, r"(?is)<!--.*?-->", "")
    text = F.regexp_replace(text, r"(?is)<(script|style|noscript|template)\b[^>]*>.*?</\1\s*>", "")
    text = F.regexp_replace(text, r"(?is)^.*?<body\b[^>]*>", "")
    text = F.regexp_replace(text, r"(?is)</body\s*>.*$", "")
    # a > within quotes ends no tag
    text = F.regexp_replace(text, r"""(?s)<(?:[^<>"']|"[^"]*"|'[^']*')*>""", "")
    return decoded(text)


def decoded(text: Column) -> Column:
    """Character references as characters: the named ones of HTML 4 and numeric ones; what is none stays."""
    named = F.create_map(*[F.lit(x) for name, code in codepoints.items() for x in (name, chr(code))], F.lit("apos"), F.lit("'"))

    def one(part: Column) -> Column:
        name = F.regexp_extract(part, "^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1)
        number = F.when(F.lower(name).startswith("#x"), F.conv(F.substring(name, 3, 8), 16, 10)).when(name.startswith("#"), F.substring(name, 2, 8)).cast("int")
        known = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
        utf16 = F.when(number < 0x10000, F.concat(F.lpad(F.hex(number), 4, "0"))).otherwise(
            F.concat(F.hex(F.lit(0xD800) + F.shiftright(number - 0x10000, 10)), F.hex(F.lit(0xDC00) + (number - 0x10000).bitwiseAND(F.lit(0x3FF))))
        )
        value = F.when(known, F.decode(F.unhex(utf16), "UTF-16BE")).otherwise(F.element_at(named, name))
        return F.coalesce(F.when(name != "", F.concat(value, F.substr(part, F.length(name) + 2))), F.concat(F.lit("&"), part))

    parts = F.split(text, "&")
    joined = F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, 1 << 30), one), ""))
    return F.when(F.contains(text, F.lit("&")), joined).otherwise(text)


class _Main(HTMLParser):
    """Text of the article, main or body, one line a block."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: dict[str, list[str]] = {"article": [], "main": [], "body": []}
        self.open: list[tuple[str, bool]] = []

    def handle_starttag(self, tag, attrs) -> None:
        classes = (dict(attrs).get("class") or "").split()
        if tag not in _VOID:
            self.open.append((tag, tag in _SILENT or tag in _CHROME or (tag == "div" and "ad" in classes)))
        if tag in _BLOCK:
            self._add("\n")

    def handle_endtag(self, tag) -> None:
        if any(t == tag for t, _ in self.open):
            while self.open and self.open.pop()[0] != tag:
                pass
        if tag in _BLOCK:
            self._add("\n")

    def handle_data(self, data) -> None:
        self._add(data)

    def _add(self, text: str) -> None:
        tags = {t for t, _ in self.open}
        if any(hidden for _, hidden in self.open) or tags & {"head", "title"}:
            return
        for where in ("article", "main"):
            if where in tags:
                self.found[where].append(text)
        self.found["body"].append(text)


def _main_text(page: str | None) -> str | None:
    if not page:
        return None
    parser = _Main()
    parser.feed(page)
    parser.close()
    for where in ("article", "main", "body"):
        lines = [" ".join(line.split()) for line in "".join(parser.found[where]).split("\n")]
        if any(lines):
            return "\n".join(line for line in lines if line)
    return None


class _Safe(HTMLParser):
    """A page without what could act."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.out: list[str] = []
        self.inside = 0

    def _tag(self, tag, attrs, end: str) -> None:
        kept = []
        for name, value in attrs:
            plain = re.sub(r"[\x00-\x20]+", "", entities.unescape(value or "")).lower()
            scripted = plain.startswith(("javascript:", "vbscript:"))
            if name.startswith("on") or (name in _GOES and (scripted or plain.startswith("data:"))) or (name in _LOADS and scripted):
                continue
            kept.append(f" {name}" if value is None else f' {name}="{entities.escape(value)}"')
        self.out.append(f"<{tag}{''.join(kept)}{end}>")

    def handle_starttag(self, tag, attrs) -> None:
        if tag in _REMOVED:
            self.inside += tag not in _VOID
        elif not self.inside:
            self._tag(tag, attrs, "")

    def handle_startendtag(self, tag, attrs) -> None:
        if tag not in _REMOVED and not self.inside:
            self._tag(tag, attrs, "/")

    def handle_endtag(self, tag) -> None:
        if tag in _REMOVED:
            self.inside = max(0, self.inside - (tag not in _VOID))
        elif not self.inside:
            self.out.append(f"</{tag}>")

    def handle_data(self, data) -> None:
        if not self.inside:
            self.out.append(data)

    def handle_entityref(self, name) -> None:
        self.handle_data(f"&{name};")

    def handle_charref(self, name) -> None:
        self.handle_data(f"&#{name};")

    def handle_comment(self, data) -> None:
        self.handle_data(f"<!--{data}-->")

    def handle_decl(self, decl) -> None:
        self.handle_data(f"<!{decl}>")


def _sanitized(page: str | None) -> str | None:
    if page is None:
        return None
    parser = _Safe()
    parser.feed(page)
    parser.close()
    return "".join(parser.out)


def _blocked(address: str) -> bool:
    ip = ipaddress.ip_address(address)
    if isinstance(ip, ipaddress.IPv6Address) and ip.ipv4_mapped:
        ip = ip.ipv4_mapped
    return ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_reserved or ip.is_multicast or ip.is_unspecified


def _unsafe_reason(url: str | None, addresses) -> str | None:
    """Why a URL may not be fetched; null if it may. addresses: what its host resolves to."""
    try:
        parts = urlsplit(url or "")
        host = parts.hostname
    except ValueError:
        return "malformed"
    if parts.scheme.lower() not in ("http", "https"):
        return "scheme"
    if not host:
        return "host"
    try:
        return "address" if _blocked(host) else None
    except ValueError:
        pass
    if addresses is None or not len(addresses):
        return "unresolved"
    try:
        return "address" if any(_blocked(a) for a in addresses) else None
    except ValueError:
        return "address"


def _each(fn, kind):
    @F.pandas_udf(kind)
    def apply(column: pd.Series) -> pd.Series:
        return column.map(fn)

    return apply


def main_text(page: Column) -> Column:
    """The article's text, or main's, or the body's, without navigation and the like; null if there is none."""
    return _each(_main_text, T.StringType())(page)


def sanitize(page: Column) -> Column:
    return _each(_sanitized, T.StringType())(page)


def unsafe_reason(url: Column, addresses: Column | None = None) -> Column:
    @F.pandas_udf(T.StringType())
    def reason(urls: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([_unsafe_reason(u, a) for u, a in zip(urls, found, strict=True)])

    return reason(url, addresses if addresses is not None else F.lit(None).cast("array<string>"))


def join_url(base: Column, target: Column) -> Column:
    @F.pandas_udf(T.StringType())
    def join(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if y is None else urljoin(x or "", y) for x, y in zip(a, b, strict=True)])

    return join(base, target)


cloudpickle.register_pickle_by_value(sys.modules[__name__])

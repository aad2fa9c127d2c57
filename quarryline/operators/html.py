"""HTML pages to text, links and safe markup, with the standard library's parser in Arrow batches. No shuffle."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements that are dropped, parts of ids and classes of boilerplate, allowed markup and refused file endings.
DROPPED = {"script", "style", "noscript", "nav", "footer", "aside", "header", "form", "button", "svg", "iframe", "img"}
BOILERPLATE = {"id": ("cookie", "banner", "popup", "modal"), "class": ("cookie", "banner", "popup", "sidebar", "advertisement", "ad-")}
HEADINGS, PARAGRAPHS, LISTINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}, {"p", "li"}, {"code", "pre"}
VOID = {"br", "hr", "img", "meta", "link", "input", "area", "base", "col", "embed", "source", "track", "wbr"}
ALLOWED = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "br", "hr", "ul", "ol", "li", "strong", "em", "code", "pre", "blockquote", "table", "thead", "tbody", "tr", "th", "td", "a"}
ALLOWED_ATTRIBUTES = ("href", "title")
REFUSED = (".pdf", ".zip", ".gz", ".tar", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".webp", ".woff", ".woff2", ".ttf", ".eot", ".css", ".js", ".map", ".xml", ".json", ".yaml", ".yml")
MOST_CHARS = 50_000


class Cleaner(HTMLParser):
    """Texts of headings, paragraphs, list items and listings, in the order in which these begin; what lies in two of them is in both."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, list[str] | None]] = []  # open elements, with the texts of those that give a line
        self.found: list[tuple[str, list[str]]] = []
        self.dropped = 0  # open elements from the outermost dropped one on

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            return
        if self.dropped or tag in DROPPED or any(part in (v or "") for k, v in attrs for part in BOILERPLATE.get(k, ())):
            self.dropped += 1
            self.open.append((tag, None))
            return
        texts: list[str] | None = [] if tag in HEADINGS | PARAGRAPHS | LISTINGS else None
        if texts is not None:
            self.found.append((tag, texts))
        self.open.append((tag, texts))

    def handle_endtag(self, tag: str) -> None:
        if any(name == tag for name, _ in self.open):
            while self.open.pop()[0] != tag:
                self.dropped = max(0, self.dropped - 1)
            self.dropped = max(0, self.dropped - 1)

    def handle_data(self, data: str) -> None:
        if not self.dropped and (own := data.strip()):
            for _, texts in self.open:
                if texts is not None:
                    texts.append(own)


def clean_text(html: str | None) -> str:
    parser = Cleaner()
    parser.feed(html or "")
    parser.close()
    lines = []
    for tag, texts in parser.found:
        if text := "".join(texts):
            lines.append(f"\n## {text}" if tag in HEADINGS else f"```\n{text}\n```" if tag in LISTINGS else text)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


#: Schemes that a link may have; a link without one is relative.
ALLOWED_SCHEMES = ("http", "https", "mailto")


def allowed_link(link: str) -> bool:
    """Whether a link has an allowed scheme or none, as browsers read it: without control characters and blanks, which may stand inside a scheme's name."""
    bare = re.sub(r"[\x00-\x20\x7f-\xa0\u2000-\u200f\u2028\u2029\ufeff]", "", link)
    scheme = re.match(r"([^/?#:]*):", bare)
    return scheme is None or scheme[1].lower() in ALLOWED_SCHEMES


class Sanitizer(HTMLParser):
    """Allowed markup with safe links; other tags go, their text stays. Every element that is opened is closed."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.open: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ALLOWED:
            safe = "".join(f' {k}="{escape(v or "")}"' for k, v in attrs if tag == "a" and k in ALLOWED_ATTRIBUTES and (k != "href" or allowed_link(v or "")))
            self.out.append(f"<{tag}{safe}>")
            if tag not in VOID:
                self.open.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.open:
            self.close_to(tag)

    def close_to(self, tag: str | None) -> None:
        while self.open:
            self.out.append(f"</{self.open[-1]}>")
            if self.open.pop() == tag:
                break

    def handle_data(self, data: str) -> None:
        self.out.append(escape(data, quote=False))


def sanitized_text(html: str | None) -> str:
    """Of the first MOST_CHARS characters; a tag that is cut there goes."""
    parser = Sanitizer()
    parser.feed(re.sub(r"<[^<>]*\Z", "", (html or "")[:MOST_CHARS]) if len(html or "") > MOST_CHARS else html or "")
    parser.close()
    parser.close_to(None)
    return "".join(parser.out)


class Links(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.found: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "a":
            self.found += [v for k, v in attrs if k == "href" and v]


def page_links(url: str | None, html: str | None, same_domain: bool = True) -> list[str]:
    """Absolute http(s) links without fragments, sorted, each once; no binary files, of the page's own host and port if same_domain."""
    parser, out = Links(), set()
    parser.feed(html or "")
    host = urlsplit(url or "").netloc
    for link in parser.found:
        try:
            full = urljoin(url or "", link.strip()).split("#", 1)[0]
            parts = urlsplit(full)
        except ValueError:
            continue
        if parts.scheme in ("http", "https") and not parts.path.lower().endswith(REFUSED) and (not same_domain or parts.netloc == host):
            out.add(full)
    return sorted(out)


def mapped(pages: DataFrame, of, name: str, kind: str, arrow: pa.DataType) -> DataFrame:
    """page_id and of(the other columns)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([of(*row) for row in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)], arrow)], ["page_id", name])

    return pages.mapInArrow(run, f"page_id long, {name} {kind}")


def cleaned(pages: DataFrame) -> DataFrame:
    return mapped(pages.select("page_id", "html"), clean_text, "text", "string", pa.string())


def sanitized(pages: DataFrame) -> DataFrame:
    return mapped(pages.select("page_id", "html"), sanitized_text, "html", "string", pa.string())


def links(pages: DataFrame) -> DataFrame:
    return mapped(pages.select("page_id", "url", "html"), page_links, "links", "array<string>", pa.list_(pa.string()))

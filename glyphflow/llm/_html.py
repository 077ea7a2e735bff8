"""What the page operators read from HTML: text, title, declared language and links.

Tags are found once, each from its < to the next > (or the end), and attributes are read from what stands in
between. No pattern looks further than that, and none starts anew within a run it has passed, so reading is linear in
the page, however hostile it is.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

_DROP = re.compile(r"<(script|style|noscript|template)\b[^>]*(?:>.*?(?:</\1\s*>|\Z)|\Z)|<!--.*?(?:-->|\Z)", re.S | re.I)
_BLOCK = re.compile(r"</?(?:p|div|br|li|ul|ol|h[1-6]|tr|td|th|table|article|section|header|footer|nav|title|body|head|html|blockquote|pre)\b[^>]*(?:>|\Z)", re.I)
_TAG = re.compile(r"<[a-zA-Z/!?][^>]*(?:>|\Z)")
_OPEN = re.compile(r"<([a-zA-Z][a-zA-Z0-9]*+)([^>]*)(?:>|\Z)")
_ATTRIBUTE = re.compile(r"(?<![^\s\"'/])([^\s=>\"'/<]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']++))")
_CHARSET = re.compile(r"charset\s*+=\s*+[\"']?([A-Za-z0-9_-]+)", re.I)
_CODE = re.compile(r"[A-Za-z-]+")


def text_of(page: str | None) -> str:
    """Visible text: a line for each block, spaces squeezed, entities resolved."""
    page = _BLOCK.sub("\n", _DROP.sub(" ", page or ""))
    lines = (" ".join(html.unescape(line).split()) for line in _TAG.sub("", page).split("\n"))
    return "\n".join(line for line in lines if line)


def _tags(page: str | None, *names: str) -> Iterator[re.Match]:
    return (m for m in _OPEN.finditer(page or "") if m[1].lower() in names)


def _attributes(tag: re.Match) -> dict[str, str]:
    """The first value of each attribute, by its name in lower case."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(tag[2]):
        out.setdefault(m[1].lower(), next(x for x in m.groups()[1:] if x is not None))
    return out


def title_of(page: str | None) -> str | None:
    page = page or ""
    for m in _tags(page, "title"):
        end = page.find("<", m.end())
        return " ".join(html.unescape(page[m.end() : end if end >= 0 else len(page)]).split())
    return None


def language_of(page: str | None) -> str | None:
    """The declared language: of the html element, else of a meta element."""
    meta = None
    for m in _tags(page, "html", "meta"):
        a = _attributes(m)
        if m[1].lower() == "html":
            found = _CODE.match(a.get("lang", ""))
            if found:
                return found[0].split("-")[0].lower()
        elif meta is None and a.get("http-equiv", "").lower() == "content-language":
            meta = _CODE.match(a.get("content", ""))
    return meta and meta[0].split("-")[0].lower()


def charset_of(page: str | None) -> str | None:
    return next((c[1] for m in _tags(page, "meta") if (c := _CHARSET.search(m[2]))), None)


def links_of(page: str | None) -> list[str]:
    found = (_attributes(m).get("href") for m in _tags(_DROP.sub(" ", page or ""), "a"))
    return [html.unescape(x) for x in found if x is not None]

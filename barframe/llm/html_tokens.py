"""Tokens of a web page: tags, text and what lies in raw elements."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*)>", re.S)
_HINTS = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
#: Elements whose content is no markup; it is skipped up to their end tag.
RAW = frozenset({"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"})
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"})
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*>?", re.I) for name in RAW}


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, hints): kind is ``open``, ``close``, ``text`` or ``raw`` (name of a raw element).

    Hints are the values of class, id and role, lower-cased, and ``!hidden``.  Text is as written.
    """
    at, n = 0, len(html)
    while at < n:
        m = _TAG.search(html, at)
        if m is None:
            yield "text", html[at:], ""
            return
        if m.start() > at:
            yield "text", html[at : m.start()], ""
        at = m.end()
        closing, name, attributes = m.groups()
        if name is None:
            if m.group().startswith("<![CDATA["):
                yield "text", m.group()[9:].removesuffix("]]>"), ""
            continue
        name = name.lower()
        if closing:
            yield "close", name, ""
        elif name in RAW:
            end = _RAW_END[name].search(html, at)
            at = end.end() if end else n
            yield "raw", name, ""
        else:
            yield "open", name, _known_hints(attributes) if len(attributes) <= 256 else _hints(attributes)


def _hints(attributes: str) -> str:
    if "=" not in attributes and "hidden" not in attributes.lower():
        return ""
    found = []
    for m in _HINTS.finditer(attributes):
        key, value = m.group(1).lower(), (m.group(2) or m.group(3) or m.group(4) or "").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            found.append("!hidden")
        elif key in ("class", "id", "role"):
            found.append(value)
    return " ".join(found)


_known_hints = lru_cache(1 << 12)(_hints)


def decoded(text: str) -> str:
    """Character references decoded."""
    return unescape(text) if "&" in text else text

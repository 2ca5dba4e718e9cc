"""Plain text out of the wrappers in which archive exports and feeds arrive."""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements whose text is left out, and those that end a line.
HIDDEN = {"script", "style", "head"}
LINES = {"p", "br", "div", "tr", "li", "h1", "h2", "h3", "h4", "hr", "table"}
# Groups of a rich-text file that hold no text; control words that stand for a character.
TEXTLESS = ("fonttbl", "colortbl", "stylesheet", "info", "pict", "header", "footer", "xmlnstbl")
CHARACTERS = {"par": "\n", "line": "\n", "tab": "\t"}

_TOKENS = re.compile(r"\\'([0-9a-fA-F]{2})|\\([a-zA-Z]{1,32})(-?\d{1,10})? ?|\\([^a-zA-Z'])|([{}])|([^\\{}]+)")


def _tidy(text: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def rtf_text(data: str) -> str:
    """The text of a rich-text file: one pass over its tokens, keeping track of groups that hold none."""
    out: list[str] = []
    depth, hidden, starts = 0, None, False
    for m in _TOKENS.finditer(data):
        code, word, _, symbol, brace, plain = m.groups()
        if brace == "{":
            depth, starts = depth + 1, True
            continue
        if brace == "}":
            hidden = None if hidden == depth else hidden
            depth -= 1
        elif symbol == "*":
            continue
        elif word is not None:
            if starts and word in TEXTLESS and hidden is None:
                hidden = depth
            elif hidden is None:
                out.append(CHARACTERS.get(word, ""))
        elif hidden is None:
            if code is not None:
                out.append(bytes.fromhex(code).decode("cp1252", "replace"))
            elif symbol is not None:
                out.append({"~": " ", "_": "-"}.get(symbol, symbol if symbol in "\\{}" else ""))
            else:
                out.append(plain)
        starts = False
    return _tidy("".join(out))


class _Visible(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: object) -> None:
        self.hidden += tag in HIDDEN
        if tag in LINES and not self.hidden:
            self.out.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag in LINES and not self.hidden:
            self.out.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.out.append(data)


def html_text(data: str) -> str:
    """The visible text of a page or fragment, block elements as lines."""
    page = _Visible()
    page.feed(data)
    page.close()
    return _tidy("\n".join(line.strip() for line in html.unescape("".join(page.out)).splitlines()))


def plain_text(data: str, name: str = "") -> str:
    """Text whatever wrapper it arrives in, told by the file's name or its first characters."""
    start = data.lstrip()[:200].lower()
    if name.lower().endswith(".rtf") or start.startswith("{\\rtf"):
        return rtf_text(data)
    if name.lower().endswith((".html", ".htm")) or start.startswith(("<!doctype", "<html")):
        return html_text(data)
    return data


@F.pandas_udf(T.StringType())
def html_to_text(page: pd.Series) -> pd.Series:
    return page.map(html_text, na_action="ignore")


@F.pandas_udf(T.StringType())
def wrapped_to_text(data: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([None if d is None else plain_text(d, n or "") for d, n in zip(data, name)], dtype=object)

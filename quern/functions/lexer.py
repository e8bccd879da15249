"""One lexer for source text: words, strings and marks with their places; comments are passed over."""

from __future__ import annotations

import re
from bisect import bisect_right
from typing import NamedTuple


class Token(NamedTuple):
    """kind: w (word), s (string, text without its quotes), m (a mark), n (number)."""

    kind: str
    text: str
    at: int
    end: int
    first: bool  # the first on its line
    indent: int  # of its line


def _pattern(comments: tuple[str, ...], quotes: str) -> re.Pattern:
    """Alternatives in order: comments, long strings, strings, words, numbers, single marks."""
    notes = [r"/\*(?:.|\n)*?(?:\*/|\Z)"] if "//" in comments else []
    notes += [re.escape(c) + r"[^\n]*" for c in comments]
    strings = []
    if '"""' in quotes:
        strings += [r'[rRbBuUfF]{0,2}"""(?:\\.|[^\\])*?"""', r"[rRbBuUfF]{0,2}'''(?:\\.|[^\\])*?'''"]
    for q in "\"'`":
        if q in quotes:
            strings.append(rf"{q}(?:\\.|[^{q}\\{'' if q == '`' else chr(92) + 'n'}])*{q}")
    return re.compile(f"(?P<c>{'|'.join(notes)})|(?P<s>{'|'.join(strings)})|(?P<w>[A-Za-z_$][\\w$]*)|(?P<n>\\d[\\w.]*)|(?P<m>[^\\s\\w])", re.DOTALL)


#: A style of comments and quotes for a family of languages.
STYLES = {
    "slash": _pattern(("//",), "\"'`"),
    "rust": _pattern(("//",), '"'),
    "hash": _pattern(("#",), "\"\"\"\"'"),
    "both": _pattern(("//", "#"), "\"'"),
    "dash": _pattern(("--",), "\"'"),
}


class Text:
    """Tokens of a text, the places of its lines, and for each bracket the one that closes it."""

    def __init__(self, text: str, style: str = "slash"):
        self.text = text
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.tokens: list[Token] = []
        line = -1
        for m in STYLES[style].finditer(text):
            kind, body = m.lastgroup, m.group()
            if kind == "c":
                continue
            here = self.line(m.start()) - 1
            first = here != line
            start = self.starts[here]
            indent = len(text[start : m.start()]) - len(text[start : m.start()].lstrip(" \t")) if first else self.tokens[-1].indent
            if kind == "s":
                body = body.lstrip("rRbBuUfF")
                width = 3 if body[:3] in ('"""', "'''") and len(body) >= 6 else 1
                body = body[width : len(body) - width]
            self.tokens.append(Token(kind, body, m.start(), m.end(), first, indent))
            line = self.line(max(m.end() - 1, 0)) - 1
        self.closing: dict[int, int] = {}
        opened: dict[str, list[int]] = {"(": [], "[": [], "{": []}
        for i, t in enumerate(self.tokens):
            if t.kind == "m" and t.text in opened:
                opened[t.text].append(i)
            elif t.kind == "m" and t.text in ")]}":
                own = opened["([{"[")]}".index(t.text)]]
                if own:
                    self.closing[own.pop()] = i

    def line(self, at: int) -> int:
        """The line of an offset, from 1."""
        return bisect_right(self.starts, at)

    def word(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < len(self.tokens) and self.tokens[i].kind == "w" else ""

    def mark(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < len(self.tokens) and self.tokens[i].kind == "m" else ""

    def string(self, i: int) -> str | None:
        return self.tokens[i].text if 0 <= i < len(self.tokens) and self.tokens[i].kind == "s" else None

    def end_line(self, i: int) -> int:
        """The last line of what a bracket opens, or of the token itself."""
        return self.line(self.tokens[min(self.closing.get(i, i), len(self.tokens) - 1)].at)

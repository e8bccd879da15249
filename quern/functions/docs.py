"""Short human summaries of code and documents, from comments, docstrings and headings."""

from __future__ import annotations

import re

#: Characters of a summary of code, of a document, and of a trail of headings (fixed values).
CODE, DOCUMENT, TRAIL = 200, 300, 500
#: A document beyond this size has no summary.
LARGEST = 1024 * 1024
#: Openings of comments that steer tools or state licences (fixed values).
NOISE = (
    "eslint", "tslint", "prettier", "istanbul", "c8", "coverage", "biome", "oxlint", "noqa", "pylint", "mypy", "flake8", "fmt:",
    "ts-", "@ts-", "spdx-", "copyright", "all rights reserved", "generated by", "do not edit",
)
#: The same, where a whole word or more has to match (fixed values).
NOISE_WORDS = (r"type:\s*ignore", r"/?/?/?\s*<reference", r"license\b", r"@author\b", r"@license\b")
_noise = re.compile("|".join([*map(re.escape, NOISE), *NOISE_WORDS]), re.IGNORECASE)
#: Marks before the text of a comment's line, and after a docstring's.
_before = re.compile(r"\s*(?:\*\s?)?\s*(?:/{2,3}|#+|--+|;+|\"{3}|'{3})?\s?")
_line_comment = re.compile(r"\s*(?://|#|--)")


def shortened(s: str, most: int) -> str:
    """s, cut at a word boundary with an ellipsis if it is longer."""
    if len(s) <= most:
        return s
    head = s[:most]
    cut = max((i for i, c in enumerate(head) if c.isspace()), default=len(head))
    return head[:cut].strip() + "…"


def _unmarked(line: str) -> str:
    """A comment's line without its marks."""
    s = line.strip()
    if s.startswith("*") and not s.startswith("**"):
        s = s[1:].lstrip()
    for mark in ('"""', "'''"):
        s = s.removeprefix(mark)
        s = s.removesuffix(mark)
    for mark in ("/", "#", "-", ";"):
        bare = s.lstrip(mark)
        n = len(s) - len(bare)
        if (mark == "/" and n in (2, 3)) or (mark == "#" and n) or (mark == "-" and n > 1) or (mark == ";" and n):
            return bare.strip()
    return s.strip()


def normalize(raw: str | None) -> str | None:
    """The first paragraph of a comment without its marks and tags; None if it says nothing."""
    if not raw:
        return None
    s = raw.replace("\r", "").strip()
    if s.startswith("/*"):
        s = s[2:].removeprefix("*")
    s = s.removesuffix("*/")
    lines = "\n".join(_unmarked(x) for x in s.split("\n")).strip().split("\n")
    kept: list[str] = []
    for i, line in enumerate(lines):
        tag = re.match(r"@\w+|:\w+:", line)
        if (tag and i) or (not line and kept):
            break
        kept.append(line)
    s = " ".join(" ".join(kept).split())
    if len(s) < 3 or _noise.match(s):
        return None
    return shortened(s, CODE)


def signature(text: str, most: int = 500) -> str:
    """What stands before the first brace, or on the first line if there is none near."""
    head = text[: 4 * most].split("{", 1)[0]
    return head.strip()[:most]


def triple_quoted(lines: list[str], at: int) -> str | None:
    """The inside of the string that opens on a line with three quotes, of up to 60 lines."""
    m = re.match(r"\s*[rbufRBUF]{0,2}(\"\"\"|''')", lines[at])
    if not m:
        return None
    rest = "\n".join([lines[at][m.end() :], *lines[at + 1 : at + 60]])
    return rest.split(m[1], 1)[0]


def python_docstring(text: str, line: int) -> str | None:
    """The docstring below the def or class that starts on a line (from 1)."""
    lines = text.split("\n")
    i = line - 1
    for _ in range(50):
        if i >= len(lines):
            return None
        i += 1
        if re.search(r":\s*(#.*)?$", lines[i - 1]):
            break
    while i < len(lines) and not lines[i].strip():
        i += 1
    return normalize(triple_quoted(lines, i)) if i < len(lines) else None


def leading_comment(text: str, line: int) -> str | None:
    """The comment that stands directly above a line (from 1), decorators between them aside."""
    lines = text.split("\n") if text else []
    i = min(line - 2, len(lines) - 1)
    while i >= 0 and re.match(r"\s*@[\w.]", lines[i]):
        i -= 1
    if i < 0:
        return None
    if lines[i].rstrip().endswith("*/"):
        for j in range(i, max(-1, i - 60), -1):
            if "/*" in lines[j]:
                return normalize("\n".join(lines[j : i + 1]))
        return None
    j = i
    while j >= 0 and _line_comment.match(lines[j]):
        j -= 1
    return normalize("\n".join(lines[j + 1 : i + 1])) if j < i else None


def module_doc(text: str) -> str | None:
    """What a file says of itself at its top."""
    lines = text.split("\n")
    i = 1 if lines[0].startswith("#!") else 0
    while i < len(lines) and (not lines[i].strip() or re.search(r"coding[:=]", lines[i])):
        i += 1
    if i >= len(lines):
        return None
    inner = triple_quoted(lines, i)
    if inner is not None:
        return normalize(inner)
    if not re.match(r"\s*(//|#|--|/\*)", lines[i]):
        return None
    return leading_comment(text, i + 2)


def clean_inline(s: str) -> str:
    """Links as their texts, no marks of emphasis, single spaces."""
    s = re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", s)
    return " ".join(s.translate(dict.fromkeys(map(ord, "`*_~"))).lstrip("#").split())


_rule = re.compile(r"[=\-~^\"'#*]{3,}\s*")
#: Openings of lines that are no prose: markup, images, links, quotes, lists, rules (fixed values).
_no_prose = re.compile(r"\s*(?:<|!\[|\[!|\[[^\]]*\]:|[>|*+\-]|\d+\.|===|\.\.)")


def heading(line: str) -> tuple[int, str] | None:
    """The level and text of a heading with # or = marks."""
    for mark in "#=":
        level = len(line) - len(line.lstrip(mark))
        if 1 <= level <= 6 and line[level : level + 1].isspace() and line[level:].strip():
            return level, line[level:].strip().rstrip("#").strip()
    return None


def parse(text: str) -> tuple[str | None, str | None]:
    """(title with the first paragraph, trail of headings) of a document; fenced lines are passed over."""
    if len(text) > LARGEST:
        return None, None
    lines = text.replace("\r", "").split("\n")
    title = intro = None
    heads: list[str] = []
    fenced, i = False, -1
    while i + 1 < len(lines):
        i += 1
        line = lines[i]
        if line.lstrip().startswith(("```", "~~~")):
            fenced = not fenced
            continue
        if fenced or not line.strip():
            continue
        marked = heading(line)
        if marked:
            heads.append(marked[1])
            title = title or (marked[1] if marked[0] == 1 else None)
            continue
        if i + 1 < len(lines) and _rule.fullmatch(lines[i + 1]) and line.strip()[0] not in "=-~^\"'#*":
            heads.append(line.strip())
            title, i = title or line.strip(), i + 1
            continue
        if intro is None and not _no_prose.match(line):
            j = i
            while j < len(lines) and lines[j].strip() and not heading(lines[j].lstrip()):
                j += 1
            intro = clean_inline(" ".join(x.strip() for x in lines[i:j]))
    parts = [clean_inline(title) if title else None, intro]
    summary = shortened(" ".join(" — ".join(p for p in parts if p).split()), DOCUMENT) or None
    trail = " · ".join(dict.fromkeys(h for h in map(clean_inline, heads) if h))[:TRAIL] or None
    return summary, trail

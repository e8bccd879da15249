"""Scalar functions on text as Columns: hashing, redaction, stripping, identifiers, paths, budgets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of secrets before a colon or an equals sign (fixed values).
SECRET_NAMES = r"(?i)((?:api[_-]?key|apikey|secret|password|token|credential|authToken|accessToken|refreshToken)s?\s*[:=])"
#: Secret patterns (fixed values): pattern and replacement, applied in this order. A name stays, its value goes.
SECRETS = [
    (SECRET_NAMES + r"""\s*['"][^'"]+['"]""", "$1 [REDACTED]"),
    (SECRET_NAMES + r"""\s*[^\s'"]+""", "$1 [REDACTED]"),
    (r"-----BEGIN\s+(?:RSA|EC|DSA|OPENSSH)\s+PRIVATE\s+KEY-----", "[REDACTED]"),
    (r"(?:ghp_|gho_|github_pat_)[a-zA-Z0-9]{36,}", "[REDACTED]"),
    (r"sk-[a-zA-Z0-9]{20,}", "[REDACTED]"),
    (r"AKIA[A-Z0-9]{16}", "[REDACTED]"),
]
#: Exclusion rules (fixed values), in order: glob, reason, action.
EXCLUSIONS = [
    ("**/node_modules/**", "vendor", "skip"),
    ("**/.git/**", "vendor", "skip"),
    ("**/dist/**", "generated", "skip"),
    ("**/build/**", "generated", "skip"),
    ("**/.env*", "secret", "redact"),
    ("**/.npmrc", "secret", "redact"),
    ("**/.pypirc", "secret", "redact"),
    ("**/.netrc", "secret", "redact"),
    ("**/.aws/**", "secret", "skip"),
    ("**/.azure/**", "secret", "skip"),
    ("**/.config/gcloud/**", "secret", "skip"),
    ("**/.kube/**", "secret", "skip"),
    ("**/.ssh/**", "secret", "skip"),
    ("**/*.pem", "secret", "skip"),
    ("**/*.key", "secret", "skip"),
    ("**/id_rsa", "secret", "skip"),
    ("**/id_ed25519", "secret", "skip"),
    ("**/*.min.js", "generated", "skip"),
    ("**/*.bundle.js", "generated", "skip"),
    ("**/*.min.css", "generated", "skip"),
    ("**/coverage/**", "generated", "skip"),
    ("**/.test.sqlite", "generated", "skip"),
    ("**/*.sqlite", "generated", "skip"),
    ("**/*.sqlite-wal", "generated", "skip"),
    ("**/.context-graph.sqlite*", "generated", "skip"),
]
#: Globs that no scan enters (fixed values).
IGNORED = (
    "**/node_modules/** **/dist/** **/build/** **/.git/** **/coverage/** **/.venv/** **/venv/** **/env/** **/__pycache__/** "
    "**/.mypy_cache/** **/.pytest_cache/** **/site-packages/** **/target/** **/vendor/** **/.next/** **/.svelte-kit/** **/*.min.js"
).split()
#: Comments and strings that are blanked before identifiers are read, in this order.
STRIPPED = [r"(?s)/\*.*?\*/", r'(?s)""".*?"""', r"(?s)'''.*?'''", r"(?s)`(?:\\.|[^`\\])*`", r'"(?:\\.|[^"\\\n])*"', r"'(?:\\.|[^'\\\n])*'", r"(?m)#.*$", r"(?m)//.*$"]
#: Names too common to tell anything (fixed values), lower-cased.
COMMON = (
    "main init setup index value result data name type kind node edge item list self none null true false "
    "config options context state error print input output start close open read write build parse render update "
    "create delete remove apply format handler builder test"
).split()


def redact(text: Column) -> Column:
    """I2."""
    return reduce(lambda t, p: F.regexp_replace(t, p[0], p[1]), SECRETS, text)


def strip_comments(text: Column) -> Column:
    """I3."""
    return reduce(lambda t, p: F.regexp_replace(t, p, " "), STRIPPED, text)


def identifiers(text: Column) -> Column:
    """I4: all identifiers in order."""
    return F.regexp_extract_all(text, F.lit("([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))


def distinctive(name: Column) -> Column:
    """C5."""
    return (F.length(name) >= 4) & ~F.lower(name).isin(*COMMON)


#: Openings of comments that say nothing of the code (fixed values).
DOC_NOISE = (
    r"(?i)^(eslint|tslint|prettier|istanbul|c8|coverage|biome|oxlint|noqa|pylint|mypy|flake8|fmt:|type:\s*ignore|ts-|@ts-|/?/?/?\s*<reference|spdx-|"
    r"copyright|license\b|all rights reserved|generated by|do not edit|@author\b|@license\b)"
)


def normalize_doc(text: Column, most: int = 200, noise: str = DOC_NOISE) -> Column:
    """What a comment says: its marks and its tag section go, the first paragraph stays with its
    spaces collapsed, cut at a word boundary with an ellipsis; null if shorter than 3 characters, or if it
    steers a tool or states a licence (noise). Only a newline ends a line."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "\r", ""), r"^\s*/\*\*?", ""), r"\*/\s*$", "")
    each = F.transform(F.split(bare, "\n"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"^\s*\*\s?", ""), r"""^\s*(?:///?|#+|--+|;+|\"{3}|'{3})\s?""", ""), r"""(?:\"{3}|'{3})\s*$""", "")))
    whole = F.trim(F.regexp_replace(F.array_join(each, "\n"), r"(?d)^\s+|\s+$", ""))
    said = F.regexp_replace(whole, r"(?s)\n\s*(?:@\w+|:\w+:).*$", "")
    first = F.trim(F.regexp_replace(F.element_at(F.split(said, r"\n\s*\n", 2), 1), r"\s+", " "))
    head = F.trim(F.regexp_replace(F.substring(first, 1, most), r"(?d)\s+\S*$", ""))
    return F.when((F.length(first) < 3) | first.rlike(noise), F.lit(None)).when(F.length(first) > most, F.concat(head, F.lit("…"))).otherwise(first)


def render_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 3.2).cast("long")


def budget_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("long")


def signature(text: Column, most: int = 500) -> Column:
    """What is before the first brace."""
    return F.substring(F.trim(F.substring_index(text, "{", 1)), 1, most)


def excerpt(text: Column, start: int, end: int, context: int = 2) -> Column:
    """Lines start..end (from 1) with lines of context around them."""
    first = max(0, start - 1 - context)
    return F.array_join(F.slice(F.split(text, "\n"), first + 1, end + context - first), "\n")


def glob_regex(pattern: str) -> str:
    """An anchored pattern; **/ stands for any folders, * for part of a name, ? for a character."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = pattern[i]
            out, i = out + {"*": "[^/]*", "?": "."}.get(c, "\\" + c if c in ".+()[]{}^$|\\" else c), i + 1
    return f"^{out}$"


def excluded(path: Column, rules: list[tuple[str, ...]] = EXCLUSIONS) -> Column:
    """The action (the last part) of the first rule whose glob (the first part) matches, else null."""
    return F.coalesce(*(F.when(path.rlike(glob_regex(r[0])), F.lit(r[-1])) for r in rules))


def exclusion(path: Column, own: list[tuple[str, str, str]] = ()) -> Column:
    """The first rule that matches, of the fixed ones and then one's own, as (pattern, reason, action)."""
    told = lambda r: F.struct(F.lit(r[0]).alias("pattern"), F.lit(r[1]).alias("reason"), F.lit(r[2]).alias("action"))
    return F.coalesce(*(F.when(path.rlike(glob_regex(r[0])), told(r)) for r in [*EXCLUSIONS, *own]))


def ignored(path: Column, own: tuple[str, ...] = ()) -> Column:
    """Whether a fixed glob, or one of one's own, leaves the path out of every scan."""
    return path.rlike("|".join(f"(?:{glob_regex(g)})" for g in [*IGNORED, *own]))


def guarded(path: str, root: str) -> str:
    """C11: the absolute path of what lies below root; an error if it leaves it."""
    import os.path

    base = os.path.normpath(root)
    full = os.path.normpath(os.path.join(base, path))
    if full != base and not full.startswith(base.rstrip("/") + "/"):
        raise ValueError(f"path leaves the root: {path}")
    return full


def resolved_path(path: Column) -> Column:
    """A relative path without . and .. parts; null if it leaves the root."""
    up = lambda a: F.when(F.size(a) > 0, F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array(F.lit("..")))
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    done = F.aggregate(parts, F.expr("cast(array() as array<string>)"), lambda a, p: F.when(p == "..", up(a)).otherwise(F.concat(a, F.array(p))))
    return F.when(~F.array_contains(done, ".."), F.array_join(done, "/"))


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """The file's name without its last extension."""
    return F.regexp_replace(basename(path), r"(.)\.[^.]+$", "$1")


def name_rank(name: Column, qualified: Column, query: str) -> Column:
    """I16: exact 0, prefix 1, within 2, within the qualified name 3, else 4; case does not matter."""
    n, q = F.lower(name), query.lower()
    return F.when(n == q, 0).when(n.startswith(q), 1).when(n.contains(q), 2).when(F.lower(qualified).contains(q), 3).otherwise(4)


def cache_key(container: Column, policy: str, ids: Column) -> Column:
    """I22."""
    return F.concat_ws("::", container, F.lit(policy), F.array_join(F.array_sort(ids), ","))

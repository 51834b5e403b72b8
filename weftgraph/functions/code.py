"""Functions of code that need a scan with memory: blanked literals and rename-invariant hashes.

Both walk a text's lexemes once, so they are Arrow functions; rows stay where they are.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

HASHED = ("python", "ruby", "bash")
_SCRIPT = re.compile(r"(?P<string>\"(?:[^\"\\]|\\.)*\"?|'(?:[^'\\]|\\.)*'?)|(?P<tick>`)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<word>[A-Za-z_$][\w$]*|\d[\w.]*)|(?P<space>\s+)|(?P<other>.)", re.S)
_HASH = re.compile(r"(?P<string>\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|\"(?:[^\"\\]|\\.)*\"?|'(?:[^'\\]|\\.)*'?|`(?:[^`\\]|\\.)*`?)|(?P<tick>(?!))|(?P<comment>#[^\n]*)|(?P<word>[A-Za-z_$][\w$]*|\d[\w.]*)|(?P<space>\s+)|(?P<other>.)", re.S)
#: Names of types that parameters lists may hold; they are never renamed.
KEPT = frozenset("string number boolean void any unknown never null undefined object Record Promise Array".split())
_SPACES = re.compile(r"[^\n]")


def _template(text: str, start: int) -> list[tuple[str, str]]:
    """Lexemes of a template literal from its opening tick: its text as strings, its interpolations as code."""
    out, at, held = [("quote", "`")], start + 1, start + 1
    while at < len(text):
        if text[at] == "\\":
            at += 2
        elif text[at] == "`":
            return [*out, ("string", text[held:at]), ("quote", "`")]
        elif text.startswith("${", at):
            end, depth = at + 2, 1
            while end < len(text) and depth:
                depth += (text[end] == "{") - (text[end] == "}")
                end += 1
            out += [("string", text[held:at]), ("code", text[at:end])]
            at = held = end
        else:
            at += 1
    return [*out, ("string", text[held:])]


def lexemes(text: str, language: str = "") -> list[tuple[str, str]]:
    """(kind, text) in order; together they are the text."""
    rule, out, at = _HASH if language in HASHED else _SCRIPT, [], 0
    while at < len(text):
        m = rule.match(text, at)
        if m.lastgroup == "tick":
            found = _template(text, at)
            out += found
            at += sum(len(t) for _, t in found)
        elif m.lastgroup == "string":
            quote = m[0][:3] if m[0][:3] in ('"""', "'''") else m[0][0]
            closed = len(m[0]) >= 2 * len(quote) and m[0].endswith(quote)
            inner = m[0][len(quote) : -len(quote)] if closed else m[0][len(quote) :]
            out += [("quote", quote), ("string", inner), *([("quote", quote)] if closed else [])]
            at = m.end()
        else:
            out.append((m.lastgroup, m[0]))
            at = m.end()
    return out


def blank(text: str, language: str = "") -> str:
    """As long as the text, with its line ends: insides of strings and comments are spaces."""
    return "".join(_SPACES.sub(" ", t) if kind in ("string", "comment") else t for kind, t in lexemes(text, language))


def shape(text: str) -> str:
    """Code without comments and needless space, whose functions, variables and parameters have running names."""
    parts = [(k, t) for k, t in lexemes(text) if k not in ("comment", "space")]
    names: dict[str, str] = {}

    def name(word: str, prefix: str) -> None:
        if word not in names:
            names[word] = f"{prefix}{sum(v.startswith(prefix) for v in names.values())}"

    for (kind, word), (after, following) in zip(parts, parts[1:], strict=False):
        if kind == "word" and after == "word" and word in ("function", "class"):
            name(following, "_F")
        if kind == "word" and after == "word" and word in ("const", "let", "var"):
            name(following, "v")
    opened: list[int] = []
    for i, (_, token) in enumerate(parts):
        if token == "(":
            opened.append(i)
        elif token == ")" and opened:
            start, following = opened.pop(), "".join(t for _, t in parts[i + 1 : i + 3])
            if following.startswith(("=>", "{", ":")):
                for j in range(start + 1, i):
                    if parts[j][0] == "word" and parts[j - 1][1] in ("(", ",", ".") and parts[j][1] not in KEPT:
                        name(parts[j][1], "p")
    out: list[str] = []
    for i, (kind, token) in enumerate(parts):
        spaced = kind == "word" and i and parts[i - 1][0] == "word"
        repeated = token == ";" and out and out[-1] == ";"
        out += [] if repeated else [" "] * spaced + [names.get(token, token) if kind == "word" else token]
    return "".join(out)


def blank_code(text: Column, language: Column) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series, languages: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else blank(t, (g or "").lower()) for t, g in zip(texts, languages, strict=True)])

    return run(text, language)


def shape_hash(text: Column) -> Column:
    """SHA-256 of the code's shape: equal for code that differs in names, comments and layout."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else hashlib.sha256(shape(t).encode()).hexdigest() for t in texts])

    return run(text)

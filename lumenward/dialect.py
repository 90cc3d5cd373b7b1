"""Regular expressions of rules, from their own dialect to Java's.

Rules are written as JavaScript or Python patterns. Java reads the same text differently in a few places; to_java
rewrites those, so that a rule means the same wherever it runs.
"""

from __future__ import annotations

import re
from re import _constants as _op
from re import _parser

# JavaScript's white space and line ends, as the inside of a Java character class.
WHITE = r"\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
LINE_END = r"\n\r\x{2028}\x{2029}"
#: ASCII word boundaries: Java's own \b knows other letters, and does so differently by version.
BOUNDARY = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
NO_BOUNDARY = "(?:(?<=[A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<![A-Za-z0-9_])(?![A-Za-z0-9_]))"
#: The boundary before what can only be a word character: one look instead of four, at every place of a text.
BEFORE_WORD = "(?<![A-Za-z0-9_])"
_LEADING = re.compile(r"\(\?([a-zA-Z]+)\)")
_GLOBAL = re.compile(r"\(\?[aiLmsux]+\)")
_QUANTIFIER = re.compile(r"\{[0-9]+(?:,[0-9]*)?\}")


class Unsupported(ValueError):
    """A construct that has no equal in the rule dialect."""


def _scan(source: str):
    """(token, inside a class) of a pattern; an escape is one token."""
    inside, at = False, 0
    while at < len(source):
        token = source[at : at + 2] if source[at] == "\\" and at + 1 < len(source) else source[at]
        was = inside
        if token == "[" and not inside:
            inside = True
        elif token == "]" and inside:
            inside = False
        yield at, token, was
        at += len(token)


def compact(source: str) -> str:
    """A verbose pattern without its layout: unescaped white space and comments outside classes go."""
    out, comment = [], False
    for _, token, inside in _scan(source):
        if comment:
            comment = token != "\n"
        elif len(token) == 2 and token[1].isspace():
            out.append(" " if token[1] == " " else token)
        elif inside or len(token) == 2 or not (token.isspace() or token == "#"):
            out.append(token)
        else:
            comment = token == "#"
    return "".join(out)


def from_python(pattern: str) -> tuple[str, str]:
    """(source, flags) of a Python pattern in the rule dialect; flags always have i.

    Raises Unsupported for locale flags, global flags inside the pattern, conditionals, and absolute anchors
    together with the m flag.
    """
    flags, verbose = {"i"}, False
    while lead := _LEADING.match(pattern):
        letters = set(lead[1])
        if unknown := letters - set("aiLmsux"):
            raise Unsupported(f"flags {sorted(unknown)}")
        if "L" in letters:
            raise Unsupported("locale flag")
        flags |= letters & set("ims")
        verbose |= "x" in letters
        pattern = pattern[lead.end() :]
    if verbose:
        pattern = compact(pattern)
    if _GLOBAL.search(pattern):
        raise Unsupported("global flag inside the pattern")
    if "(?(" in pattern:
        raise Unsupported("conditional group")
    pattern = re.sub(r"\(\?#[^)]*\)", "", pattern)
    pattern = pattern.replace("(?P<", "(?<")
    pattern = re.sub(r"\(\?P=([A-Za-z_][A-Za-z0-9_]*)\)", r"\\k<\1>", pattern)
    out, absolute = [], False
    for _, token, _ in _scan(pattern):
        absolute |= token in (r"\A", r"\Z", r"\z")
        out.append({r"\A": "^", r"\Z": "$", r"\z": "$"}.get(token, token))
    if absolute and "m" in flags:
        raise Unsupported("absolute anchor with the m flag")
    return "".join(out), "".join(sorted(flags))


def to_java(source: str, flags: str = "i") -> str:
    """A Java pattern that matches what the rule pattern matches in JavaScript."""
    out: list[str] = []
    skip = 0
    for at, token, inside in _scan(source):
        if at < skip:
            continue
        rest = source[at:]
        if inside:
            out.append({r"\s": WHITE, "[": r"\[", "&": r"\&", "~": r"\~"}.get(token, token))
        elif token == r"\b":
            out.append(BEFORE_WORD if _word_follows(source, at + 2) else BOUNDARY)
        elif token == r"\B":
            out.append(NO_BOUNDARY)
        elif token == r"\s":
            out.append(f"[{WHITE}]")
        elif token == r"\S":
            out.append(f"[^{WHITE}]")
        elif token == ".":
            out.append(r"[\s\S]" if "s" in flags else f"[^{LINE_END}]")
        elif token == "$":
            out.append(f"(?=[{LINE_END}]|\\z)" if "m" in flags else r"\z")
        elif token == "^":
            out.append(f"(?:\\A|(?<=[{LINE_END}]))" if "m" in flags else r"\A")
        elif token == "{" and not _QUANTIFIER.match(rest):
            out.append(r"\{")
        elif rest.startswith("(?<") and rest[3:4] not in ("=", "!"):
            name = rest[3 : rest.index(">")]
            out.append(f"(?<{_group(name)}>")
            skip = at + len(name) + 4
        elif token == r"\k" and rest.startswith(r"\k<"):
            name = rest[3 : rest.index(">")]
            out.append(f"\\k<{_group(name)}>")
            skip = at + len(name) + 4
        else:
            out.append(token)
    return ("(?i)" if "i" in flags else "") + "".join(out)


def _word_follows(source: str, at: int) -> bool:
    """Whether what stands at a place of a pattern must begin with a word character.

    That is a letter, digit or underscore, or a group without a name whose alternatives all begin so, neither of
    them optional. Anything else counts as unknown.
    """
    if source.startswith("(?:", at):
        starts, depth, end = [at + 3], 0, len(source)
        for i, token, inside in _scan(source[at:]):
            if inside or (token == "[" and depth):
                continue
            depth += (token == "(") - (token == ")")
            if depth == 0:
                end = at + i + 1
                break
            if token == "|" and depth == 1:
                starts.append(at + i + 1)
        return source[end : end + 1] not in ("?", "*", "{") and all(_word_follows(source, i) for i in starts)
    if source.startswith(r"\b", at):
        return _word_follows(source, at + 2)
    return bool(re.match(r"[A-Za-z0-9_](?![?*{])", source[at:]))


def _group(name: str) -> str:
    """Java group names have letters and digits only."""
    return "g" + "".join(c if c.isalnum() and c != "z" else f"z{ord(c):x}z" for c in name)


#: Sets of literals that a pattern needs, at most; and literals of one set.
NEEDS, ALTERNATIVES = 4, 64


def needs(pattern: str) -> tuple[tuple[str, ...], ...]:
    """Sets of lower-case ASCII literals of which a text must have one each to match a Python pattern.

    Read off its syntax tree: the longest literals that no alternative, option or assertion leaves out. Nothing
    for a pattern that cannot be read.
    """
    try:
        found = _needed(_parser.parse(pattern))
    except (re.error, RecursionError, OverflowError):
        return ()
    best = sorted(dict.fromkeys(tuple(sorted(s)) for s in found), key=lambda s: (-min(map(len, s)), len(s), s))
    return tuple(s for s in best if min(map(len, s)) >= 2)[:NEEDS]


def _needed(tree) -> list[frozenset[str]]:
    """Sets of literals of which every match has one each."""
    out: list[frozenset[str]] = []
    run = ""

    def end() -> None:
        nonlocal run
        if run:
            out.append(frozenset([run]))
        run = ""

    for what, own in tree:
        if what is _op.LITERAL and own < 128:
            run += chr(own).lower()
            continue
        end()
        if what is _op.SUBPATTERN:
            out += _needed(own[3])
        elif what in (_op.MAX_REPEAT, _op.MIN_REPEAT, _op.POSSESSIVE_REPEAT) and own[0] > 0:
            out += _needed(own[2])
        elif what is _op.ATOMIC_GROUP:
            out += _needed(own)
        elif what is _op.ASSERT and own[0] > 0:
            out += _needed(own[1])
        elif what is _op.BRANCH:
            parts = [_needed(branch) for branch in own[1]]
            if all(parts):
                best = [max(p, key=lambda s: (min(map(len, s)), -len(s))) for p in parts]
                union = frozenset().union(*best)
                if len(union) <= ALTERNATIVES:
                    out.append(union)
    end()
    return out

"""Row-local predicates over texts: windows, pattern hits, and the context before a hit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenward.functions.normalize import let, utf16_length
from lumenward.rules import Regex

# Window sizes in UTF-16 units, and the phrases that change how a hit counts.
WINDOW, STRIDE = 1200, 600
NEGATION_SPAN, DEFENSIVE_SPAN, MATCH_SPAN = 50, 120, 50
EXCERPT_BEFORE, EXCERPT_AFTER = 10, 20
CORROBORATE_MAX = 2000
NEGATIONS = ["do not", "don't", "don’t", "dont", "never", "avoid", "be careful", "watch out for", "beware of", "not run", "not execute", "not use", "should not", "shouldn't", "shouldn’t", "must not", "must never"]
FRAMING_LABELS = ["warning:", "warning -", "example of", "example:", "for example", "caution:", "note:"]
QUOTES = "\"'`“”‘’«»"
DEFENSIVE = ["detect", "detects", "detecting", "detection", "scan for", "scans for", "scanning for", "protect against", "protects against", "protection against", "defend against", "defends against", "block", "blocks", "prevent", "prevents", "flag", "flags", "catch", "catches", "identifies", "attempts to", "attempt to", "tries to", "attackers", "adversaries", "malicious actors", "threat actors", "vulnerability", "vulnerabilities", "exploit", "cve-"]
SENTENCE_ENDS = [". ", "! ", "? ", "\n"]


def units(text: Column, start: Column, size: Column) -> Column:
    """UTF-16 units of a text from a 0-based start, at most size of them, clipped to the text.

    Characters beyond the basic plane are rare; a text without them is cut by characters.
    """
    first, size = F.greatest(start, F.lit(0)), F.greatest(size + F.least(start, F.lit(0)), F.lit(0))
    wide = lambda t: F.decode(F.substring(F.encode(t, "UTF-16BE"), 2 * first + 1, 2 * size), "UTF-16BE")
    return let(text, lambda t: F.when(F.rlike(t, F.lit(r"[\x{10000}-\x{10ffff}]")), wide(t)).otherwise(F.substring(t, first + 1, size)))


def windows(text: Column) -> Column:
    """Overlapping windows of a text: itself if it is short, else every STRIDE units until one reaches the end."""
    n = utf16_length(text)
    count = F.ceil((n - WINDOW) / STRIDE).cast("int") + 1
    return F.when(n <= WINDOW, F.array(text)).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda i: units(text, i * STRIDE, F.lit(WINDOW))))


def contains_any(text: Column, phrases: Sequence[str]) -> Column:
    """Whether a text has any of the phrases; one literal array, however many they are."""
    return F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(text, p))


def negated(before: Column) -> Column:
    """Whether what stands before a hit negates it, or labels it as an example and opens a quote."""
    labels = F.array(*map(F.lit, FRAMING_LABELS))

    def of(text: Column) -> Column:
        quoted = F.exists(labels, lambda p: F.contains(text, p) & F.rlike(F.call_function("substring_index", text, p, F.lit(-1)), F.lit(f"[{QUOTES}]")))
        return contains_any(text, NEGATIONS) | quoted

    return let(F.lower(before), of)


def defensive(before: Column) -> Column:
    """Whether the hit's own sentence talks about defence before it."""
    own = F.lower(before)
    for end in SENTENCE_ENDS:
        own = F.substring_index(own, end, -1)
    return let(own, lambda text: contains_any(text, DEFENSIVE))


def possible(regex: Regex, lower: Column) -> Column:
    """Whether a lower-cased text has what a pattern needs."""
    out = F.lit(True)
    for literals in regex.needs:
        out = out & contains_any(lower, literals)
    return out


def hit(regex: Regex, text: Column, views: Column | None = None, lower: Column | None = None) -> Column:
    """struct<before, matched> of the first match of a pattern, null without one.

    before: up to DEFENSIVE_SPAN units; matched: up to MATCH_SPAN. A match at a window's start has nothing
    before it. views: the text's windows, computed once for all patterns that need them. lower: the text in
    lower case, which lets texts that cannot match be passed over.
    """
    worth = F.lit(True) if lower is None else possible(regex, lower)
    if regex.mode == "plain":
        before = let(F.regexp_instr(text, F.lit(regex.java)) - 1, lambda at: units(text, at - DEFENSIVE_SPAN, F.lit(DEFENSIVE_SPAN)))
        found = F.struct(before.alias("before"), units(F.regexp_extract(text, regex.java, 0), F.lit(0), F.lit(MATCH_SPAN)).alias("matched"))
        return F.when(worth & F.rlike(text, F.lit(regex.java)), found)
    flagged = Regex(f"^(?:{regex.source})", regex.flags.replace("m", ""))
    views = windows(text) if views is None else views
    first = F.filter(views, lambda w: F.rlike(w, F.lit(flagged.java)))
    found = F.struct(F.lit("").alias("before"), units(F.regexp_extract(F.get(first, F.lit(0)), flagged.java, 0), F.lit(0), F.lit(MATCH_SPAN)).alias("matched"))
    out = F.when(worth & F.exists(views, lambda w: F.rlike(w, F.lit(flagged.java))), found)
    for guard in regex.guards:
        out = F.when(~F.rlike(text, F.lit(Regex(f"^(?:{guard.source})", guard.flags.replace("m", "")).java)), out)
    return out


def hit_by(java: Column, plain: Column, guards: Column, text: Column, views: Column | None = None) -> Column:
    """hit() for a pattern that is a column: java, anchored unless it is plain, and its anchored guards."""
    found = lambda t: F.call_function("regexp_extract", t, java, F.lit(0))
    before = let(F.regexp_instr(text, java) - 1, lambda at: units(text, at - DEFENSIVE_SPAN, F.lit(DEFENSIVE_SPAN)))
    anywhere = F.struct(before.alias("before"), units(found(text), F.lit(0), F.lit(MATCH_SPAN)).alias("matched"))
    first = F.get(F.filter(windows(text) if views is None else views, lambda w: F.rlike(w, java)), F.lit(0))
    at_start = let(first, lambda w: F.when(w.isNotNull(), F.struct(F.lit("").alias("before"), units(found(w), F.lit(0), F.lit(MATCH_SPAN)).alias("matched"))))
    guarded = F.when(~F.exists(guards, lambda g: F.rlike(text, g)), at_start)
    return F.when(plain, F.when(F.rlike(text, java), anywhere)).otherwise(guarded)


def excerpt(text: Column, at: Column, size: int) -> Column:
    """The surroundings of a keyword found at a 0-based place in characters."""
    start = F.greatest(at - EXCERPT_BEFORE, F.lit(0))
    return F.substring(text, start + 1, F.least(F.length(text), at + size + EXCERPT_AFTER) - start)

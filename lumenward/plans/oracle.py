"""DuckDB SQL that says what the scan must find, built from the same rules: the raw-text lane, and the whole scan.

RE2, DuckDB's engine, has no look-behind; the one there is (a dot that begins a file name) becomes a consumed
character, which moves no match that the rules' canaries make.
"""

from __future__ import annotations

import string
import unicodedata
from collections.abc import Sequence

from lumenward import rules as R
from lumenward.functions import normalize, predicates
from lumenward.plans.seeds import literal
from lumenward.rules import Rule


def re2(source: str) -> str:
    return source.replace(r"(?<![\w.])\.env\b", r"(?:^|[^\w.])\.env\b")


def contains_any(text: str, phrases: Sequence[str]) -> str:
    return "(" + " or ".join(f"contains({text}, {literal(p)})" for p in phrases) + ")"


def after_last(text: str, mark: str) -> str:
    """What follows the last occurrence of a mark, or all of the text."""
    return f"list_extract(string_split({text}, {literal(mark)}), -1)"


def negated(before: str) -> str:
    labels = [f"(contains({before}, {literal(p)}) and regexp_matches({after_last(before, p)}, {literal('[' + predicates.QUOTES + ']')}))" for p in predicates.FRAMING_LABELS]
    return "(" + " or ".join([contains_any(before, predicates.NEGATIONS), *labels]) + ")"


def defensive(before: str) -> str:
    own = before
    for end in predicates.SENTENCE_ENDS:
        own = after_last(own, end)
    return contains_any(own, predicates.DEFENSIVE)


def hits(rules: Sequence[Rule], source: str, key: str, name: str = "hits") -> str:
    """A CTE of raw-lane findings over source(key..., channel, text): plain patterns only, the first that matches."""
    parts = []
    for n, rule in enumerate(rules):
        for k, e in enumerate(rule.regex):
            rx = literal(re2(e.source))
            parts.append(
                f"select {key}, {n} as ordinal, {k} as k, {literal(rule.id)} as id, {literal(rule.category)} as category, {literal(rule.severity)} as own, {literal(rule.kind)} as kind, {literal(rule.grade)} as tier, {str(rule.negation_immune).lower()} as immune, "
                f"regexp_extract(text, '(?is)^(.*?)(?:' || {rx} || ')', 1) as pre, left(regexp_extract(text, '(?i)' || {rx}), {predicates.MATCH_SPAN}) as matched "
                f"from {source} where channel in ({', '.join(map(literal, rule.channels))}) and regexp_matches(text, '(?i)' || {rx})"
            )
    near, far = f"lower(right(pre, {predicates.NEGATION_SPAN}))", f"lower(right(pre, {predicates.DEFENSIVE_SPAN}))"
    rank = "case " + " ".join(f"when severity = {literal(s)} then {r}" for s, r in R.SEVERITY_RANK.items()) + " else 0 end"
    return (
        f"{name}_all as ({' union all '.join(parts)}), "
        f"{name}_first as (select * from {name}_all qualify row_number() over (partition by {key}, ordinal order by k) = 1), "
        f"{name}_why as (select *, not immune and {negated(near)} as neg, kind = 'mechanism' and {defensive(far)} as def from {name}_first), "
        f"{name}_sev as (select *, case when neg or def then 'review' else own end as severity from {name}_why), "
        f"{name} as (select *, {rank} as rank from {name}_sev)"
    )


def kept(key: str, name: str = "hits") -> str:
    """A CTE `kept` of the findings that no carrier of their category makes redundant."""
    return (
        f"kept as (select * from (select *, max(case when kind = 'carrier' then rank else -1 end) over (partition by {key}, category) as carrier_rank from {name}) "
        f"where kind = 'carrier' or carrier_rank < rank)"
    )


def decision(rank: str) -> str:
    return f"case when {rank} is null then 'allow' when {rank} >= 3 then 'block' when {rank} = 2 then 'quarantine' else 'allow_redacted' end"


# The normalisation, stage by stage, over a text column t.


def rewritten(text: str, pattern: str, to: str) -> str:
    """Every match m of a pattern replaced by an expression over it."""
    rx = literal(pattern)
    return (
        f"array_to_string(list_transform(list_zip(string_split_regex({text}, {rx}), list_append(list_transform(regexp_extract_all({text}, {rx}), lambda m: {to}), '')), lambda z: coalesce(z[1], '') || coalesce(z[2], '')), '')"
    )


def _when(test: str, then: str, text: str) -> str:
    return f"case when {test} then {then} else {text} end"


def nfkc(text: str = "t") -> str:
    """NFC, and the compatibility characters of Latin-1, general punctuation, ligatures and full-width forms."""
    known = [c for c in map(chr, [*range(0xA0, 0x100), *range(0x2000, 0x2070), *range(0xFB00, 0xFB07), 0x3000, *range(0xFF01, 0xFF5F)]) if unicodedata.normalize("NFKC", c) != unicodedata.normalize("NFC", c)]
    one = [c for c in known if len(unicodedata.normalize("NFKC", c)) == 1]
    out = f"translate({text}, {literal(''.join(one))}, {literal(''.join(unicodedata.normalize('NFKC', c) for c in one))})"
    for c in known:
        if c not in one:
            out = f"replace({out}, {literal(c)}, {literal(unicodedata.normalize('NFKC', c))})"
    return f"nfc_normalize({out})"


def look_alikes(text: str = "t") -> str:
    wide = "".join(chr(0xFF21 + i) for i in range(26)) + "".join(chr(0xFF41 + i) for i in range(26))
    return f"translate({text}, {literal(''.join(normalize.LOOK_ALIKES) + wide)}, {literal(''.join(normalize.LOOK_ALIKES.values()) + string.ascii_uppercase + string.ascii_lowercase)})"


def invisible(text: str = "t") -> str:
    return f"regexp_replace({text}, {literal(normalize.INVISIBLE)}, '', 'g')"


def entities(text: str = "t") -> str:
    names = " ".join(f"when {literal(k)} then {literal(v)}" for k, v in normalize.ENTITIES.items())
    code = "case when starts_with(m, '&#x') then try_cast('0x' || nullif(right('0000000' || ltrim(substr(m, 4, length(m) - 4), '0'), 8), '') as bigint) else try_cast(nullif(regexp_extract(m, '^&#([0-9]+)', 1), '') as bigint) end"
    size = "case when starts_with(m, '&#x') then length(ltrim(substr(m, 4, length(m) - 4), '0')) else length(ltrim(regexp_extract(m, '^&#([0-9]+)', 1), '0')) end"
    number = f"case when ({size}) <= 8 and ({code}) <= 1114111 and not ({code}) between 55296 and 57343 then chr(({code})::int) else m end"
    name = f"case lower(substr(m, 2, length(m) - 2)) {names} else m end"
    return _when(f"contains({text}, '&')", rewritten(text, "&(?:#x?[0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);", f"case when starts_with(m, '&#') then {number} else {name} end"), text)


def percent(text: str = "t") -> str:
    return _when(f"contains({text}, '%')", rewritten(text, "(?:%[0-9A-Fa-f]{2})+", "coalesce(try(decode(unhex(replace(m, '%', '')))), m)"), text)


def hexadecimal(text: str = "t") -> str:
    return _when(rf"contains({text}, '\x')", rewritten(text, r"\\x[0-9A-Fa-f]{2}", "chr(('0x' || substr(m, 3, 2))::int)"), text)


#: The bytes of one character in hexadecimal digits, or else one byte.
_CHARACTER = "[0-7].|(?:C[2-9A-F]|D.)[89AB].|E0[AB].[89AB].|E[1-9ABCEF][89AB].[89AB].|ED[89].[89AB].|F0[9AB].[89AB].[89AB].|F[123][89AB].[89AB].[89AB].|F48.[89AB].[89AB].|.."


def base64(text: str = "t") -> str:
    """Runs as the printable characters that their bytes are, without the bytes that are none."""
    body = "rtrim(m, '=')"
    data = f"hex(from_base64({body} || repeat('=', ((4 - length({body}) % 4) % 4)::int)))"
    valid = f"list_filter(regexp_extract_all({data}, {literal(_CHARACTER)}), lambda x: not regexp_matches(x, '^[89A-F].$'))"
    plain = f"regexp_replace(replace(try(decode(unhex(array_to_string({valid}, '')))), chr(65533), ''), '^\ufeff', '')"
    good = f"not (contains(m, '=') and length(m) % 4 <> 0) and length({body}) % 4 <> 1 and length({plain}) > 4 and not regexp_matches({plain}, {literal(normalize.UNPRINTABLE)})"
    return rewritten(text, "[A-Za-z0-9+/]{20,}={0,2}", f"case when {good} then {plain} else m end")


def leet(text: str = "t") -> str:
    return f"translate({text}, {literal(normalize.LEET[0])}, {literal(normalize.LEET[1])})"


def rot13(text: str = "t") -> str:
    turn = lambda s: s[13:] + s[:13]
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    return f"translate({text}, '{upper}{lower}', '{turn(upper)}{turn(lower)}')"


#: The engine's white space in RE2's spelling.
WHITE = r"\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"


def delimiters(text: str = "t") -> str:
    dotted = rewritten(text, r"\b[a-zA-Z][.\-_][a-zA-Z](?:[.\-_][a-zA-Z])+\b", r"regexp_replace(m, '[.\-_]', '', 'g')")
    spaced = rewritten("p", r"\b(?:[a-zA-Z] ){2,}[a-zA-Z]\b", "replace(m, ' ', '')")
    return f"array_to_string(list_transform(string_split_regex({dotted}, '[{WHITE}]{{2,}}'), lambda p: {spaced}), ' ')"


def white(text: str = "t") -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace({text}, '[\t\r\x0b\x0c]+', ' ', 'g'), ' {{2,}}', ' ', 'g'), '^[{WHITE}]+|[{WHITE}]+$', '', 'g')"


def units(text: str) -> str:
    return rf"(length({text}) + len(regexp_extract_all({text}, '[\x{{10000}}-\x{{10ffff}}]')))"


def normalised(source: str, name: str) -> str:
    """CTEs that end in `name`: source(…, text) with normal, its normalised text; one stage each."""
    steps = [invisible(), nfkc(), look_alikes(), *[f() for _ in range(normalize.DECODE_PASSES) for f in (entities, percent, hexadecimal, base64)], leet(), delimiters(), white()]
    out = [f"{name}_0 as materialized (select *, text as t from {source})"]
    for n, step in enumerate(steps, 1):
        out.append(f"{name}_{n} as materialized (select * exclude (t), {step} as t from {name}_{n - 1})")
    last = f"{name}_{len(steps)}"
    out.append(f"{name}_r as materialized (select * exclude (t), {units('t')} <= {normalize.ENRICH_MAX} as short, case when {rot13()} <> t then t || ' ' || {rot13()} else t end as t from {last})")
    out.append(f"{name}_l as materialized (select * exclude (t), lower(case when short then t || ' ' || reverse(t) else t end) as t from {name}_r)")
    shape = r"regexp_replace(t, '\bl([a-z])', 'i\1', 'g')"
    out.append(f"{name} as materialized (select * exclude (t, short), case when short and {shape} <> t then t || ' ' || {shape} else t end as normal from {name}_l)")
    return ", ".join(out)


# The whole scan.

#: The windowed and guarded rules: what a window must have, all of it, and what defuses the text. Their patterns are
#: look-aheads, which RE2 does not know.
TOGETHER = {"CAR-009": ((r"\bwebhook\b", r"\bcredentials?\b"), None), "CAR-010": ((r"\bpassword\b", r"\bupload\b"), r"\bsecurity advisory\b")}


def _together(rule: Rule, text: str) -> str:
    words, guard = TOGETHER[rule.id]
    n, window, stride = units(text), predicates.WINDOW, predicates.STRIDE
    count = f"case when {n} <= {window} then 1 else ceil(({n} - {window}) / {stride}.0)::int + 1 end"
    both = " and ".join(f"regexp_matches(substr({text}, (i * {stride} + 1)::int, case when {n} <= {window} then length({text}) else {window} end::int), '(?i)' || {literal(w)})" for w in words)
    out = f"len(list_filter(range({count}), lambda i: {both})) > 0"
    return f"({out} and not regexp_matches({text}, '(?i)' || {literal(guard)}))" if guard else f"({out})"


def full(rules: Sequence[Rule], source: str, key: str) -> str:
    """CTEs that end in `kept`: all findings of source(key…, channel, text) after suppression, by lane, first and ordinal."""
    index = R.keyword_index(rules)
    own = lambda n: [(k, word) for k, (word, owners) in enumerate(index) if n in owners]
    listens = lambda r: f"channel in ({', '.join(map(literal, r.channels))})"
    fixed = lambda n, r: f"{n} as ordinal, {literal(r.id)} as id, {literal(r.category)} as category, {literal(r.severity)} as own, {literal(r.kind)} as kind, {literal(r.grade)} as tier, {str(r.negation_immune).lower()} as immune"
    first = lambda n: "case " + " ".join(f"when contains(normal, {literal(w)}) then {k}" for k, w in own(n)) + " end"
    two, words, retried = [], [], []
    for n, rule in enumerate(rules):
        for k, e in enumerate(rule.regex):
            for lane, text, to in ((2, "text", two), (3, "normal", retried)):
                if lane == 3 and not rule.keywords:
                    continue
                rx = literal(re2(e.source))
                if e.mode == "plain":
                    test, pre, matched = f"regexp_matches({text}, '(?i)' || {rx})", f"regexp_extract({text}, '(?is)^(.*?)(?:' || {rx} || ')', 1)", f"left(regexp_extract({text}, '(?i)' || {rx}), {predicates.MATCH_SPAN})"
                else:
                    test, pre, matched = _together(rule, text), "''", "''"
                at = f"{first(n)} as first" if lane == 3 else f"{n} as first"
                extra = f" and {first(n)} is not null and {units('text')} <= {predicates.CORROBORATE_MAX}" if lane == 3 else ""
                to.append(f"select {key}, {lane} as lane, {at}, {k} as k, {fixed(n, rule)}, {pre} as pre, {matched} as matched from {source} where {listens(rule)}{extra} and {test}")
        if rule.keywords and not rule.regex:
            place = "case first " + " ".join(f"when {k} then strpos(normal, {literal(w)}) - 1" for k, w in own(n)) + " end"
            size = "case first " + " ".join(f"when {k} then {len(w)}" for k, w in own(n)) + " end"
            excerpt = f"substr(normal, greatest(here - {predicates.EXCERPT_BEFORE}, 0) + 1, least(length(normal), here + size + {predicates.EXCERPT_AFTER}) - greatest(here - {predicates.EXCERPT_BEFORE}, 0))"
            words.append(
                f"select {key}, 1 as lane, first, 0 as k, {fixed(n, rule)}, substr(normal, greatest(here - {predicates.NEGATION_SPAN}, 0) + 1, here - greatest(here - {predicates.NEGATION_SPAN}, 0)) as pre, {excerpt} as matched "
                f"from (select *, {place} as here, {size} as size from (select *, {first(n)} as first from {source} where {listens(rule)}) where first is not null)"
            )
    near, far = f"lower(right(pre, {predicates.NEGATION_SPAN}))", f"lower(right(pre, {predicates.DEFENSIVE_SPAN}))"
    rank = "case " + " ".join(f"when severity = {literal(s)} then {r}" for s, r in R.SEVERITY_RANK.items()) + " else 0 end"
    one_each = f"qualify row_number() over (partition by {key}, ordinal order by k) = 1"
    return (
        f"lane2 as materialized (select * from ({' union all '.join(two)}) {one_each}), lane1 as ({' union all '.join(words)}), "
        f"lane3 as (select * from ({' union all '.join(retried)}) r where not exists (select 1 from lane2 l where {' and '.join(f'l.{c} = r.{c}' for c in key.split(', '))} and l.ordinal = r.ordinal) {one_each}), "
        "hits_all as (select * from lane1 union all select * from lane2 union all select * from lane3), "
        f"hits_why as (select *, not immune and {negated(near)} as neg, kind = 'mechanism' and lane = 2 and {defensive(far)} as def from hits_all), "
        f"hits_sev as (select *, case when neg or def then 'review' else own end as severity from hits_why), hits as materialized (select *, {rank} as rank from hits_sev), {kept(key)}"
    )

"""The scan: lanes of rules over each text, context downgrades, suppression, and a decision.

All of it is row-local: no join with the rules, no shuffle, the same in batch and in streams. The rules of a small
catalog become expressions of the plan, whose patterns are compiled once per task. Beyond LARGE patterns or
keywords, an automaton reads each text once and says which keywords occur and which patterns can match at all, by
the literals that they need; only those are tried, from a table, so that neither the plan nor a text's cost grows
with the catalog.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenward import rules as R
from lumenward.functions import normalize, predicates
from lumenward.functions.normalize import let
from lumenward.rules import Rule

#: What a lane knows of a finding: the rule's number, its place in the lane's order, and the text around the hit.
SIGHTING = "struct<lane:int,first:int,ordinal:int,before:string,matched:string>"
#: From so many keywords on, an automaton finds them all in one pass over a text.
AUTOMATON_KEYWORDS = 200
#: From so many keywords or patterns on, an automaton says what to try on a text.
LARGE = 200
#: What it says: rules with keywords only and the first of them that occurs, its place in characters; rules of which
#: a pattern may match the raw text; and rules with a keyword of which one may match the normalised text.
SCREENED = "struct<words:array<struct<ordinal:int,k:int,at:int>>,worth:array<struct<ordinal:int,tries:array<int>>>,again:array<struct<ordinal:int,k:int,tries:array<int>>>>"


def once(value: Column) -> Column:
    """value, marked so that the optimiser computes it in one place.

    Otherwise every filter and generator above the scan would get a copy of the whole scan to push down.
    """
    return F.when(F.rand(0) >= 0, value)


def sighting(lane: int, first: Column, ordinal: Column, before: Column, matched: Column) -> Column:
    return F.struct(F.lit(lane).alias("lane"), first.alias("first"), ordinal.alias("ordinal"), before.alias("before"), matched.alias("matched"))


def findings_of(sightings: Column, rules: Sequence[Rule]) -> Column:
    """Sightings as findings: the rule's own words, and the downgrades that the text before the hit calls for.

    A negated hit, or else one of a mechanism's in defensive words on the raw text, becomes a review and keeps
    its own severity beside.
    """
    words = lambda r: {"id": r.id, "name": r.name, "category": r.category, "severity": r.severity, "rank": r.rank, "kind": r.kind, "tier": r.grade, "description": r.description, "immune": r.negation_immune}
    fields = "id string, name string, category string, severity string, rank int, kind string, tier string, description string, immune boolean"
    known = table_literal([words(r) for r in rules], f"array<struct<{', '.join(f.replace(' ', ':') for f in fields.split(', '))}>>")

    def of(s: Column) -> Column:
        def judged(j: Column) -> Column:
            r, down = j["r"], j["n"] | j["d"]
            fields = {
                "lane": s["lane"], "first": s["first"], "ordinal": s["ordinal"], "id": r["id"], "name": r["name"], "category": r["category"],
                "severity": F.when(down, "review").otherwise(r["severity"]), "rank": F.when(down, R.SEVERITY_RANK["review"]).otherwise(r["rank"]),
                "kind": r["kind"], "tier": r["tier"], "description": r["description"], "matched_text": s["matched"],
                "original_severity": F.when(down, r["severity"]), "negation_context": F.when(j["n"], True), "defensive_context": F.when(~j["n"] & j["d"], True),
            }
            return F.struct(*(c.alias(k) for k, c in fields.items()))

        rule = F.get(known, s["ordinal"])
        negated = let(rule, lambda r: ~r["immune"] & predicates.negated(_near(s["before"])))
        framed = let(rule, lambda r: (r["kind"] != "carrier") & (s["lane"] == 2) & predicates.defensive(s["before"]))
        return let(F.struct(rule.alias("r"), negated.alias("n"), framed.alias("d")), judged)

    return F.transform(sightings, of)


def table_literal(rows: list, kind: str) -> Column:
    """A constant of any size in one expression; the optimiser turns it into a literal."""
    return F.from_json(F.lit(json.dumps(rows)), kind)


def _near(before: Column) -> Column:
    """The units close enough to negate."""
    return let(before, lambda b: predicates.units(b, F.greatest(normalize.utf16_length(b) - predicates.NEGATION_SPAN, F.lit(0)), F.lit(predicates.NEGATION_SPAN)))


def listens(rule: Rule, channel: Column) -> Column:
    return channel.isin(*rule.channels) if rule.channels else F.lit(False)


def keyword_places(text: Column, keywords: Sequence[str]) -> Column:
    """array<int>: the 0-based place, in characters, of each keyword's first occurrence in a text; -1 if it has none."""
    if not keywords:
        return F.array().cast("array<int>")
    if len(keywords) < AUTOMATON_KEYWORDS:
        return F.transform(F.array(*map(F.lit, keywords)), lambda k: F.call_function("locate", k, text) - 1)
    words = list(keywords)

    @F.pandas_udf("array<int>")
    def places(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = ahocorasick.Automaton()
        for n, word in enumerate(words):
            machine.add_word(word, n)
        machine.make_automaton()
        for texts in batches:
            out = []
            for t in texts:
                at = [-1] * len(words)
                for end, n in machine.iter(t or ""):
                    if at[n] < 0:
                        at[n] = end - len(words[n]) + 1
                out.append(at)
            yield pd.Series(out)

    return places(text)


def candidates(rules: Sequence[Rule], index: list[tuple[str, list[int]]], places: Column, channel: Column) -> Column:
    """array<struct<ordinal, k, alone>>: rules of the channel with a keyword that occurs.

    k: the number of the first such keyword, in the index's order; alone: the rule has keywords only. One
    expression over a literal table, however many rules there are.
    """
    own: dict[int, list[int]] = {}
    for k, (_, owners) in enumerate(index):
        for n in owners:
            own.setdefault(n, []).append(k)
    row = lambda n, ks: F.struct(F.lit(n).alias("ordinal"), F.array(*map(F.lit, ks)).alias("ks"), F.lit(not rules[n].regex).alias("alone"), F.array(*map(F.lit, rules[n].channels or ("",))).alias("channels"))
    table = F.array(*[row(n, ks) for n, ks in sorted(own.items())])
    first = lambda r: F.get(F.filter(r["ks"], lambda k: F.get(places, k) >= 0), F.lit(0))
    heard = F.filter(table, lambda r: F.array_contains(r["channels"], channel))
    found = F.transform(heard, lambda r: F.struct(r["ordinal"].alias("ordinal"), first(r).alias("k"), r["alone"].alias("alone")))
    return F.filter(found, lambda c: c["k"].isNotNull())


def keyword_sightings(found: Column, index: list[tuple[str, list[int]]], text: Column, places: Column) -> Column:
    """Lane 1: the candidates that have keywords only, with the surroundings of the keyword."""
    sizes = F.array(*[F.lit(len(k)) for k, _ in index])

    def of(c: Column) -> Column:
        return let(F.get(places, c["k"]), lambda at: sighting(1, c["k"], c["ordinal"], before_keyword(text, at), predicates.excerpt(text, at, F.get(sizes, c["k"]))))

    return F.transform(F.filter(found, lambda c: c["alone"]), of)


def before_keyword(text: Column, at: Column) -> Column:
    """The characters before a place that can negate it."""
    start = F.greatest(at - predicates.NEGATION_SPAN, F.lit(0))
    return F.substring(text, start + 1, at - start)


def first_hit(rule: Rule, text: Column, views: Column | None, lower: Column) -> Column:
    """The hit of a rule's first pattern that matches."""
    return F.coalesce(*[predicates.hit(e, text, views, lower) for e in rule.regex])


def suppressed(findings: Column) -> Column:
    """Findings without the mechanisms whose category a carrier already reports at the same rank or a higher one."""
    return F.filter(findings, lambda f: (f["kind"] == "carrier") | ~F.exists(findings, lambda g: (g["kind"] == "carrier") & (g["category"] == f["category"]) & (g["rank"] >= f["rank"])))


def decision_of(findings: Column) -> Column:
    """The decision that the worst finding leads to; of equal ranks the first; allow without findings."""
    ranked = F.transform(findings, lambda f, i: F.struct(f["rank"].alias("rank"), (-i).alias("i"), f["severity"].alias("severity")))
    worst = F.array_max(ranked)["severity"]
    decisions = F.create_map(*[F.lit(x) for pair in R.DECISIONS.items() for x in pair])
    return F.when(F.size(findings) == 0, "allow").otherwise(F.coalesce(F.try_element_at(decisions, worst), F.lit("quarantine")))


def channel_or_default(channel: Column) -> Column:
    """A request's channel; unknown and missing ones are the default."""
    return F.when(channel.isin(*R.CHANNELS), channel).otherwise(R.DEFAULT_CHANNEL)


class Screen:
    """What of a catalog can have anything to say about a text."""

    def __init__(self, rules: Sequence[Rule], index: list[tuple[str, list[int]]]) -> None:
        self.keywords = [k for k, _ in index]
        self.owners = [owners for _, owners in index]
        self.alone = [not r.regex for r in rules]
        self.channels = [frozenset(r.channels) for r in rules]
        tries = [(n, e) for n, r in enumerate(rules) for e in r.regex]
        self.rule_of = [n for n, _ in tries]
        #: Literals, the (pattern, set) pairs that each serves, and how many sets a pattern has.
        self.literals: dict[str, list[tuple[int, int]]] = {}
        self.sets = [len(e.needs) for _, e in tries]
        for t, (_, e) in enumerate(tries):
            for k, literals in enumerate(e.needs):
                for literal in literals:
                    self.literals.setdefault(literal, []).append((t, 1 << k))
        self.always = [t for t, n in enumerate(self.sets) if not n]

    def machines(self) -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
        """Automata over the literals and over the keywords."""

        def over(words: list[tuple[str, object]]) -> ahocorasick.Automaton:
            machine = ahocorasick.Automaton()
            for word, value in words:
                machine.add_word(word, value)
            if words:
                machine.make_automaton()
            return machine

        return over(list(self.literals.items())), over([(word, k) for k, word in enumerate(self.keywords)])

    def tries(self, machine: ahocorasick.Automaton, lower: str) -> dict[int, list[int]]:
        """By rule, the patterns that a lower-cased text can match, in order."""
        met: dict[int, int] = {}
        if len(machine):
            for serves in {id(v): v for _, v in machine.iter(lower)}.values():
                for t, bit in serves:
                    met[t] = met.get(t, 0) | bit
        out: dict[int, list[int]] = {}
        for t in sorted([*self.always, *(t for t, bits in met.items() if bits == (1 << self.sets[t]) - 1)]):
            out.setdefault(self.rule_of[t], []).append(t)
        return out

    def first_keywords(self, machine: ahocorasick.Automaton, normal: str) -> dict[int, tuple[int, int]]:
        """By rule, the first of its keywords that occurs, and where."""
        places: dict[int, int] = {}
        if len(machine):
            for end, k in machine.iter(normal):
                if k not in places:
                    places[k] = end - len(self.keywords[k]) + 1
        out: dict[int, tuple[int, int]] = {}
        for k in sorted(places):
            for n in self.owners[k]:
                out.setdefault(n, (k, places[k]))
        return out

    def column(self, lower: Column, normal: Column, channel: Column) -> Column:
        """SCREENED of a text."""
        own = self

        @F.pandas_udf(SCREENED)
        def screened(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            literals, keywords = own.machines()
            for lowers, normals, channels in batches:
                rows: list[tuple[list, list, list]] = []
                for low, norm, ch in zip(lowers, normals, channels, strict=True):
                    found = {n: x for n, x in own.first_keywords(keywords, norm or "").items() if ch in own.channels[n]}
                    words = [{"ordinal": n, "k": k, "at": at} for n, (k, at) in found.items() if own.alone[n]]
                    worth = [{"ordinal": n, "tries": t} for n, t in own.tries(literals, low or "").items() if ch in own.channels[n]]
                    keyed = {n: k for n, (k, _) in found.items() if not own.alone[n]}
                    retry = own.tries(literals, norm or "") if keyed else {}
                    rows.append((words, worth, [{"ordinal": n, "k": keyed[n], "tries": retry[n]} for n in sorted(keyed) if n in retry]))
                yield pd.DataFrame(rows, columns=["words", "worth", "again"])

        return screened(lower, normal, channel)


def tried(rules: Sequence[Rule], tries: Column, text: Column, views: Column | None = None) -> Column:
    """The hit of the first pattern that matches among those numbered, from a table of all patterns of the rules."""
    entries = [e for r in rules for e in r.regex]
    anchored = lambda e: R.Regex(f"^(?:{e.source})", e.flags.replace("m", "")).java
    rows = [{"plain": e.mode == "plain", "java": e.java if e.mode == "plain" else anchored(e), "guards": [anchored(g) for g in e.guards]} for e in entries]
    table = table_literal(rows, "array<struct<plain:boolean,java:string,guards:array<string>>>")
    hits = F.transform(tries, lambda t: let(F.get(table, t), lambda e: predicates.hit_by(e["java"], e["plain"], e["guards"], text, views)))
    return F.get(F.filter(hits, lambda h: h.isNotNull()), F.lit(0))


def large_lanes(df: DataFrame, rules: Sequence[Rule], index: list[tuple[str, list[int]]], channel: str) -> DataFrame:
    """df with __one, __two and __three as scan() has them, by what the automaton says is worth trying."""
    raw, normal = F.col("__text"), F.col("__normal")
    df = df.withColumn("__screened", once(Screen(rules, index).column(F.col("__lower"), normal if index else F.lit(""), F.col(channel))))
    sizes = table_literal([len(k) for k, _ in index], "array<int>")
    word = lambda c: sighting(1, c["k"], c["ordinal"], before_keyword(normal, c["at"]), predicates.excerpt(normal, c["at"], F.get(sizes, c["k"])))
    seen = lambda lane, first, c, text: let(tried(rules, c["tries"], text), lambda h: F.when(h.isNotNull(), sighting(lane, first, c["ordinal"], h["before"], h["matched"])))
    none = F.array().cast(f"array<{SIGHTING}>")
    df = df.withColumn("__one", once(F.transform("__screened.words", word)) if index else none)
    df = df.withColumn("__two", once(F.array_compact(F.transform("__screened.worth", lambda c: seen(2, c["ordinal"], c, raw)))))
    fresh = F.filter("__screened.again", lambda c: ~F.exists("__two", lambda s: s["ordinal"] == c["ordinal"]))
    short = normalize.utf16_length(raw) <= predicates.CORROBORATE_MAX
    three = F.when(short, F.array_compact(F.transform(fresh, lambda c: seen(3, c["k"], c, normal)))).otherwise(none)
    return df.withColumn("__three", once(three) if index else none).drop("__screened")


def scan(df: DataFrame, rules: Sequence[Rule], text: str = "text", channel: str = "channel", before: str | None = None) -> DataFrame:
    """df with findings (array of structs) and decision.

    Lane 1: rules with keywords only, on the normalised text. Lane 2: all patterns on the raw text. Lane 3: rules
    whose keyword occurs but whose pattern did not match the raw text get one try on the normalised text, for
    texts up to CORROBORATE_MAX units. A null text has no findings. before: a further column, with the findings
    before suppression.
    """
    rules = list(rules)
    index = R.keyword_index(rules)
    df = df.withColumn("__text", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn("__lower", once(F.lower("__text")))
    if index:
        df = normalize.normalized(df, "__text", "__normal")
    large = max(len(index), sum(len(r.regex) for r in rules)) >= LARGE
    df = large_lanes(df, rules, index, channel) if large else small_lanes(df, rules, index, channel)
    df = df.withColumn("findings", once(findings_of(F.array_sort(F.concat("__one", "__two", "__three")), rules)))
    if before:
        df = df.withColumn(before, F.col("findings"))
    df = df.withColumn("findings", once(F.when(F.exists("findings", lambda f: f["kind"] != "carrier"), suppressed(F.col("findings"))).otherwise(F.col("findings"))))
    df = df.withColumn("decision", once(decision_of(F.col("findings"))))
    return df.drop("__text", "__lower", "__normal", "__one", "__two", "__three")


def small_lanes(df: DataFrame, rules: Sequence[Rule], index: list[tuple[str, list[int]]], channel: str) -> DataFrame:
    """df with __one, __two and __three, the sightings of each lane, by an expression for each rule."""
    keyed = {n for _, owners in index for n in owners}
    patterned = [n for n, r in enumerate(rules) if r.regex]
    raw, ch, normal = F.col("__text"), F.col(channel), F.col("__normal")
    none = F.array().cast(f"array<{SIGHTING}>")
    if index:
        df = df.withColumn("__places", once(keyword_places(normal, [k for k, _ in index])))
        df = df.withColumn("__found", once(candidates(rules, index, F.col("__places"), ch)))
    views = None
    if any(e.mode != "plain" for n in patterned for e in rules[n].regex):
        df, views = df.withColumn("__views", once(predicates.windows(raw))), F.col("__views")
    lane_1 = keyword_sightings(F.col("__found"), index, normal, F.col("__places")) if index else none
    lane_2 = [F.when(listens(rules[n], ch), _sighted(2, rules[n], n, F.lit(n), raw, views, F.col("__lower"))) for n in patterned]
    df = df.withColumns({"__one": once(lane_1), "__two": once(F.array_compact(F.array(*lane_2))) if lane_2 else none})
    lane_3 = [_retried(rules[n], n, normal) for n in patterned if n in keyed]
    short = normalize.utf16_length(raw) <= predicates.CORROBORATE_MAX
    df = df.withColumn("__three", once(F.when(short, F.array_compact(F.array(*lane_3))).otherwise(none)) if lane_3 else none)
    return df.drop("__places", "__found", "__views")


def _sighted(lane: int, rule: Rule, n: int, place: Column, text: Column, views: Column | None, lower: Column) -> Column:
    """The sighting of a rule's first hit, null without one."""
    return let(first_hit(rule, text, views, lower), lambda h: F.when(h.isNotNull(), sighting(lane, place, F.lit(n), h["before"], h["matched"])))


def _retried(rule: Rule, n: int, normal: Column) -> Column:
    """Lane 3 for one rule: null unless it is a candidate that the raw text did not confirm."""
    mine: Callable[[Column], Column] = lambda c: c["ordinal"] == n
    place = F.get(F.filter("__found", mine), F.lit(0))["k"]
    return F.when(place.isNotNull() & ~F.exists("__two", mine), let(place, lambda k: _sighted(3, rule, n, k, normal, None, normal)))


#: The fields of a finding.
FIELDS = ("lane", "first", "ordinal", "id", "name", "category", "severity", "rank", "kind", "tier", "description", "matched_text", "original_severity", "negation_context", "defensive_context")


def exploded(scanned: DataFrame, *keys: str) -> DataFrame:
    """A row for each finding, with its number in its text.

    inline gives whole columns: with explode, the optimiser would extract each field from the scan by itself.
    """
    rows = F.transform("findings", lambda f, i: F.struct(i.alias("number"), *(f[c].alias(c) for c in FIELDS)))
    return scanned.select(*keys, F.inline(once(rows)))

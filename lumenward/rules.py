"""Rules are data: what to look for, on which channels, and how bad it is.

A rule of kind `carrier` names a known wording, one of kind `mechanism` the shape of an attack. Carriers come first
in a catalog, and their order matters: it decides which finding is first.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenward import dialect

# Severities with their ranks, the decision each leads to, and the channels a request may name.
SEVERITY_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1, "review": 0}
DECISIONS = {"critical": "block", "high": "block", "medium": "quarantine", "low": "allow_redacted", "review": "allow_redacted"}
CHANNELS = ("message", "file", "api_response", "web_content", "log_memory")
DEFAULT_CHANNEL = "message"
MODES = ("plain", "windowed", "guarded")


@dataclass(frozen=True)
class Regex:
    """A pattern in the rule dialect.

    plain: the first match anywhere. windowed: must match at the start of a window. guarded: as windowed, unless
    a guard matches at the start of the whole text. needs: sets of lower-case literals; a text that has none of a
    set's literals cannot match, and is not tried.
    """

    source: str
    flags: str = "i"
    mode: str = "plain"
    guards: tuple[Regex, ...] = ()
    needs: tuple[tuple[str, ...], ...] = ()

    @property
    def java(self) -> str:
        return dialect.to_java(self.source, self.flags)


@dataclass(frozen=True)
class Rule:
    """One rule; tier is S (signature), A (confirmed by a pattern) or B (hint), derived if it is not given."""

    id: str
    name: str
    category: str
    severity: str
    channels: tuple[str, ...]
    keywords: tuple[str, ...] = ()
    regex: tuple[Regex, ...] = ()
    negation_immune: bool = False
    description: str = ""
    tier: str | None = None
    kind: str = "carrier"

    @property
    def grade(self) -> str:
        return self.tier or ("A" if self.regex else "B")

    @property
    def rank(self) -> int:
        return SEVERITY_RANK.get(self.severity, 0)


@dataclass(frozen=True)
class Report:
    """What compiling a catalog gave."""

    total: int
    ported: int
    keyword_only: int
    failed: tuple[tuple[str, str], ...] = field(default=())


def ordered(rules: Iterable[Rule]) -> list[Rule]:
    """Carriers, then mechanisms, each in their own order."""
    rules = list(rules)
    return [r for r in rules if r.kind == "carrier"] + [r for r in rules if r.kind != "carrier"]


def keyword_index(rules: Sequence[Rule]) -> list[tuple[str, list[int]]]:
    """(lower-cased keyword, numbers of the rules that have it), by first appearance."""
    index: dict[str, list[int]] = {}
    for n, rule in enumerate(rules):
        for keyword in rule.keywords:
            index.setdefault(keyword.lower(), []).append(n)
    return list(index.items())


def stats(rules: Sequence[Rule]) -> dict[str, int]:
    """Carriers, mechanisms, keyword-rule pairs, and rules with a pattern."""
    return {
        "patterns": sum(r.kind == "carrier" for r in rules),
        "mechanisms": sum(r.kind != "carrier" for r in rules),
        "keywords": sum(len(r.keywords) for r in rules),
        "regex_patterns": sum(bool(r.regex) for r in rules),
    }


def invalid(spark: SparkSession, patterns: Sequence[str]) -> list[str | None]:
    """For each Java pattern, what the engine has against it; None if it compiles.

    All are tried in one query; only if that fails, the halves are, down to the patterns at fault.
    """
    if not patterns:
        return []
    try:
        tried = F.exists(F.array(*[F.lit("x").rlike(p) for p in patterns]), lambda hit: hit)
        spark.range(1).select(tried).collect()
        return [None] * len(patterns)
    except PySparkException as e:
        if len(patterns) == 1:
            return [str(e).splitlines()[0][:200]]
    half = len(patterns) // 2
    return [*invalid(spark, patterns[:half]), *invalid(spark, patterns[half:])]


def compile_catalog(spark: SparkSession, raw: Iterable[Mapping], deny: Iterable[str] = (), kind: str = "carrier", strict: bool = False) -> tuple[list[Rule], Report]:
    """Rules from raw ones whose patterns are Python's: {"id", ..., "regex": [str or {"source", "mode", "guards"}]}.

    Keywords of the deny list go, whatever their case. A rule with a pattern that cannot be converted or does
    not compile is left out and reported; strict: that is an error instead.
    """
    denied = {d.lower() for d in deny}
    read: list[tuple[Mapping, list[Regex] | ValueError]] = []
    for item in raw:
        try:
            read.append((item, [_entry(entry, kind) for entry in item.get("regex", ())]))
        except ValueError as e:
            if strict:
                raise
            read.append((item, e))
    patterns = list(dict.fromkeys(r.java for _, entries in read if isinstance(entries, list) for e in entries for r in (e, *e.guards)))
    problems = dict(zip(patterns, invalid(spark, patterns), strict=True))
    out, failed = [], []
    for item, entries in read:
        if isinstance(entries, list):
            found = [p for e in entries for r in (e, *e.guards) if (p := problems[r.java])]
            if found and strict:
                raise dialect.Unsupported(found[0])
            entries = dialect.Unsupported(found[0]) if found else entries
        if not isinstance(entries, list):
            failed.append((item["id"], str(entries)))
            continue
        known = {k: item[k] for k in ("id", "name", "category", "severity", "description", "tier", "negation_immune") if k in item}
        keywords = tuple(k for k in item.get("keywords", ()) if k.lower() not in denied)
        out.append(Rule(**known, channels=tuple(item.get("channel", ())), keywords=keywords, regex=tuple(entries), kind=kind))
    return out, Report(len(read), len(out), sum(not r.regex for r in out), tuple(failed))


def _entry(entry: str | Mapping, kind: str) -> Regex:
    """A raw pattern in the rule dialect, with the literals that it needs."""
    entry = {"source": entry} if isinstance(entry, str) else entry
    mode = entry.get("mode", "plain")
    if mode not in MODES or (kind == "mechanism" and mode == "guarded"):
        raise dialect.Unsupported(f"mode {mode}")
    guards = tuple(Regex(*dialect.from_python(g)) for g in entry.get("guards", ()))
    return Regex(*dialect.from_python(entry["source"]), mode, guards, dialect.needs(entry["source"]))


RULES_SCHEMA = "ordinal int, rule_id string, kind string, name string, category string, severity string, severity_rank int, tier string, channels array<string>, keywords array<string>, regex array<struct<mode:string,source:string,flags:string,guards:array<string>>>, negation_immune boolean, description string"


def table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """The catalog as a table."""
    rows = [
        (n, r.id, r.kind, r.name, r.category, r.severity, r.rank, r.grade, list(r.channels), list(r.keywords), [(e.mode, e.source, e.flags, [g.source for g in e.guards]) for e in r.regex], r.negation_immune, r.description)
        for n, r in enumerate(rules)
    ]
    return spark.createDataFrame(rows, RULES_SCHEMA)


def as_mechanisms(rules: Iterable[Rule]) -> list[Rule]:
    return [replace(r, kind="mechanism") for r in rules]

"""Rule patterns and catalogs."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenward import catalog, dialect
from lumenward import rules as R
from lumenward.plans import seeds


@pytest.mark.parametrize(
    ("python", "source", "flags"),
    [
        ("(?is)(?m)a.b", "a.b", "ims"),
        ("(?x) a\\ b [ #] # note\n c", "a b[ #]c", "i"),
        (r"(?P<a_b>x)(?P=a_b)", r"(?<a_b>x)\k<a_b>", "i"),
        (r"\Aa\Z", "^a$", "i"),
        ("a(?#note)b", "ab", "i"),
        ("(?i:a)", "(?i:a)", "i"),
    ],
)
def test_from_python(python, source, flags):
    assert dialect.from_python(python) == (source, flags)


@pytest.mark.parametrize("pattern", ["(?L)a", "a(?i)b", "(a)?(?(1)b|c)", r"(?m)\Aa"])
def test_unsupported(pattern):
    with pytest.raises(dialect.Unsupported):
        dialect.from_python(pattern)


@pytest.mark.parametrize(
    ("source", "text", "matches"),
    [
        (r"a\sb", "a b", True),
        (r"a$", "a\n", False),
        (r"a.b", "a\u0085b", True),
        (r"a.b", "a b", False),
        (r"\bx", "éx", True),  # é is no word character
        (r"\bx", "yx", False),
        (r"x\b", "xé", True),
        (r"\b(?:cat|dog)\b", "a DOG!", True),
        (r"\b(?:an?\s+)?cat", "a cat", True),
        (r"[[&&a]", "[", True),
        (r"a{b", "a{b", True),
        (r"(?<q_1>['])x\k<q_1>", "'x'", True),
        (r"\Bx", "yx", True),
        ("^a", "ba", False),
    ],
)
def test_to_java(spark, source, text, matches):
    got = spark.createDataFrame([(text,)], "t string").select(F.col("t").rlike(dialect.to_java(source))).first()[0]
    assert got is matches


def test_every_pattern_compiles(spark):
    patterns = [x.java for r in catalog.CATALOG for e in r.regex for x in (e, *e.guards)]
    assert R.invalid(spark, patterns) == [None] * len(patterns)
    assert R.invalid(spark, ["a(", "b"])[0] is not None


@settings(max_examples=30, deadline=None)
@given(st.text(alphabet="abcxyz .-\n'é ", max_size=12))
def test_benign_agreement_with_python(text):
    """Patterns agree with Python's engine on ASCII-bounded text, by needs and by match."""
    for rule in catalog.CATALOG:
        for e in rule.regex:
            if e.mode == "plain":
                assert re.search(e.source, text, re.I | re.A) is None


def test_needs_are_necessary():
    """A text that a pattern matches has a literal of every set that the pattern needs."""
    canaries = seeds.CANARIES.values()
    hit = 0
    for text in canaries:
        for rule in catalog.CATALOG:
            for e in rule.regex:
                if e.mode == "plain" and re.search(e.source, text, re.I | re.A):
                    hit += 1
                    assert all(any(x in text.lower() for x in need) for need in e.needs), (rule.id, text)
    assert hit > 15


def test_compile_catalog(spark):
    raw = [
        {"id": "A", "name": "a", "category": "c", "severity": "high", "channel": ["file"], "keywords": ["Foo", "the"], "regex": [r"\bfoo\b"]},
        {"id": "B", "name": "b", "category": "c", "severity": "low", "channel": ["file"], "keywords": ["bar"]},
        {"id": "C", "name": "c", "category": "c", "severity": "low", "channel": [], "regex": ["a(?(1)b)"]},
        {"id": "D", "name": "d", "category": "c", "severity": "low", "channel": [], "regex": ["a(b"]},
        {"id": "E", "name": "e", "category": "c", "severity": "low", "channel": [], "regex": [{"source": "x", "mode": "guarded", "guards": ["y"]}]},
    ]
    rules, report = R.compile_catalog(spark, raw, deny=["THE"])
    assert [r.id for r in rules] == ["A", "B", "E"]
    assert rules[0].keywords == ("Foo",)
    assert (report.total, report.ported, report.keyword_only) == (5, 3, 1)
    assert [f[0] for f in report.failed] == ["C", "D"]
    assert [r.grade for r in rules] == ["A", "B", "A"]
    with pytest.raises(ValueError):
        R.compile_catalog(spark, raw[2:3], kind="mechanism", strict=True)


def test_keyword_index_and_order():
    a = R.Rule("a", "a", "c", "low", ("file",), ("X", "y"))
    b = R.Rule("b", "b", "c", "low", ("file",), ("Y", "x"))
    m = R.Rule("m", "m", "c", "low", ("file",), kind="mechanism")
    assert [r.id for r in R.ordered([m, a, b])] == ["a", "b", "m"]
    assert R.keyword_index([a, b]) == [("x", [0, 1]), ("y", [0, 1])]
    assert R.stats([a, b, m]) == {"patterns": 2, "mechanisms": 1, "keywords": 4, "regex_patterns": 0}

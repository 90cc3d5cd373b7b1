"""A catalog of any size with made-up wordings, to measure how the scan's cost grows with it."""

from __future__ import annotations

import random

from pyspark.sql import SparkSession

from lumenward import rules as R
from lumenward.rules import Rule

#: The size that a catalog in production has: rules, those of them with keywords only, and keywords in all.
RULES, KEYWORD_ONLY, KEYWORDS = 1151, 166, 7281
_SYLLABLES = ["ba", "cor", "den", "fil", "gra", "hon", "jus", "kel", "lom", "mar", "nex", "or", "pli", "qua", "ros", "sten", "tur", "vel", "wim", "zor"]
_COMMON = ["read", "send", "open", "copy", "show", "print", "the file", "the text", "any word", "all data"]


def catalog(spark: SparkSession, rules: int = RULES, seed: int = 11) -> list[Rule]:
    """Rules of the usual shapes: some verbs, a gap, an object; and keywords of two or three words."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices(_SYLLABLES, k=rng.randint(2, 3)))
    raw = []
    for n in range(rules):
        alone = n < rules * KEYWORD_ONLY // RULES
        verbs, things = [rng.choice(_COMMON), word(), word()], [word() for _ in range(rng.randint(2, 5))]
        pattern = rf"\b(?:{'|'.join(verbs)})\b[^.\n]{{0,80}}?\b(?:{'|'.join(things)})s?\b"
        keywords = [" ".join(word() for _ in range(rng.randint(2, 3))) for _ in range(round(KEYWORDS / RULES))]
        raw.append({"id": f"SYN-{n:04d}", "name": f"Synthetic {n}", "category": f"c{n % 12}", "severity": rng.choice(["high", "medium", "low"]), "channel": list(R.CHANNELS), "keywords": keywords, "regex": [] if alone else [pattern]})
    return R.compile_catalog(spark, raw)[0]

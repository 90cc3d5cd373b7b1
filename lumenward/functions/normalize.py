"""Normalisation of texts, stage by stage, in built-in expressions.

Each function takes and returns a column. Chains of them belong in one projection per stage (see `normalized`):
inlined into one expression, a stage that reads its input twice would double the work of all stages before it.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenward import dialect

# The character tables of the stages.
INVISIBLE = r"[\x{200b}-\x{200f}\x{2060}-\x{2064}\x{feff}\x{ad}\x{34f}\x{61c}\x{2028}\x{2029}\x{e0001}-\x{e007f}]"
LOOK_ALIKES = {
    "АВСЕНКМОРТХ": "ABCEHKMOPTX", "аеорсух": "aeopcyx", "ІіЇїЄєҐґ": "IiIiEeGg", "ՈՍ": "OS", "ქ": "K",
    "ΑΒΕΗΙΚΜΝΟΡΤΧΖ": "ABEHIKMNOPTXZ", "αεορυ": "aeopu",
}
LEET = ("013457@$!", "oieastasi")
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "sol": "/", "bsol": "\\", "colon": ":", "semi": ";",
    "equals": "=", "grave": "`", "dollar": "$", "percnt": "%", "num": "#", "lpar": "(", "rpar": ")", "lbrack": "[", "rbrack": "]", "lbrace": "{",
    "rbrace": "}", "vert": "|", "ast": "*", "plus": "+", "comma": ",", "period": ".", "quest": "?", "excl": "!", "tilde": "~", "lowbar": "_",
}
UNPRINTABLE = r"[\x00-\x1f\x7f-\x9f\xa0\x{2028}\x{2029}]"
#: Whole runs only: the look behind spares a try at every letter of every word.
BASE64 = "(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{20,}+={0,2}"
DECODE_PASSES = 3
ENRICH_MAX = 2000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ROTATED = _UPPER[13:] + _UPPER[:13] + _LOWER[13:] + _LOWER[:13]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rewrite(text: Column, pattern: str, to: Callable[[Column], Column]) -> Column:
    """Replace every match of a Java pattern by a function of it, which replacement strings cannot express."""
    pieces, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.array_join(F.zip_with(pieces, F.transform(matches, to), lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    beyond = F.regexp_count(text, F.lit(r"[\x{10000}-\x{10ffff}]"))
    return F.length(text) + F.when(F.octet_length(text) == F.length(text), 0).otherwise(beyond)


def ascii_only(text: Column) -> Column:
    """Whether a text is all ASCII: stages that look for other characters skip it."""
    return F.octet_length(text) == F.length(text)


def strip_invisible(text: Column) -> Column:
    return F.when(ascii_only(text), text).otherwise(F.regexp_replace(text, INVISIBLE, ""))


def nfkc(text: str) -> Column:
    """Unicode NFKC of the string column of this name, by the ICU library that Spark ships; ASCII texts skip it."""
    return F.expr(f"case when `{text}` is null or octet_length(`{text}`) = char_length(`{text}`) then `{text}` else reflect('com.ibm.icu.text.Normalizer', 'compose', `{text}`, true) end")


def replace_look_alikes(text: Column) -> Column:
    """Cyrillic, Armenian, Georgian, Greek and full-width letters as the Latin ones they look like."""
    wide = "".join(chr(0xFF21 + i) for i in range(26)) + "".join(chr(0xFF41 + i) for i in range(26))
    return F.when(ascii_only(text), text).otherwise(F.translate(text, "".join(LOOK_ALIKES) + wide, "".join(LOOK_ALIKES.values()) + _UPPER + _LOWER))


def decode_leet(text: Column) -> Column:
    return F.when(F.rlike(text, F.lit(f"[{LEET[0]}]")), F.translate(text, *LEET)).otherwise(text)


def collapse_white(text: Column) -> Column:
    """Tabs, carriage returns and form feeds as spaces, runs of spaces as one, ends trimmed. Line feeds stay."""
    has = lambda t, *marks: functools.reduce(lambda x, y: x | y, [F.contains(t, F.lit(m)) for m in marks])
    flat = F.when(has(text, "\t", "\r", "\x0b", "\x0c"), F.translate(text, "\t\r\x0b\x0c", "    ")).otherwise(text)
    single = let(flat, lambda t: F.when(has(t, "  "), F.regexp_replace(t, " {2,}", " ")).otherwise(t))
    ends = lambda t: F.concat(F.substring(t, 1, 1), F.substring(t, -1, 1))
    trimmed = lambda t: F.regexp_replace(t, rf"\A[{dialect.WHITE}]+|[{dialect.WHITE}]+\z", "")
    return let(single, lambda t: F.when(F.rlike(ends(t), F.lit(f"[{dialect.WHITE}]")), trimmed(t)).otherwise(t))


def decode_entities(text: Column) -> Column:
    """HTML character references that end in a semicolon.

    The decimal form reads its leading digits only. Numbers that are no character (surrogates, beyond Unicode)
    and unknown names stay as they are.
    """
    names = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])

    def decoded(match: Column) -> Column:
        body = F.substring(match, F.lit(2), F.length(match) - 2)
        hexadecimal = body.startswith("#x")
        digits = F.when(hexadecimal, F.substring(body, F.lit(3), F.length(body))).otherwise(F.regexp_extract(body, "^#([0-9]+)", 1))
        digits = F.regexp_replace(digits, "^0+(?=.)", "")
        valid = lambda c: (c <= 0x10FFFF) & ~c.between(0xD800, 0xDFFF)
        character = let(_code(digits, hexadecimal), lambda c: F.when(valid(c), F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32")))
        return F.when(body.startswith("#"), F.coalesce(character, match)).otherwise(F.coalesce(F.try_element_at(names, F.lower(body)), match))

    return F.when(F.contains(text, F.lit("&")), rewrite(text, "&(?:#x?[0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);", decoded)).otherwise(text)


def _code(digits: Column, hexadecimal: Column) -> Column:
    """A code point from at most 8 digits; null for none or more."""
    read = F.when(hexadecimal, F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10))
    return F.when((digits != "") & (F.length(digits) <= 8), read.cast("long"))


def decode_percent(text: Column) -> Column:
    """Percent escapes, run by run; a run that is no UTF-8 stays."""
    decoded = lambda run: F.coalesce(F.try_validate_utf8(F.unhex(F.replace(run, F.lit("%"), F.lit(""))).cast("string")), run)
    return F.when(F.contains(text, F.lit("%")), rewrite(text, "(?:%[0-9A-Fa-f]{2})+", decoded)).otherwise(text)


def decode_hex(text: Column) -> Column:
    r"""\xNN escapes as the characters U+0000 to U+00FF."""
    decoded = lambda m: F.decode(F.unhex(F.substring(m, 3, 2)), "ISO-8859-1")
    return F.when(F.contains(text, F.lit(r"\x")), rewrite(text, r"\\x[0-9A-Fa-f]{2}", decoded)).otherwise(text)


def printable(text: Column) -> Column:
    return ~F.rlike(text, F.lit(UNPRINTABLE))


def decode_base64(text: Column) -> Column:
    """Base64 runs of 20 letters or more, where the bytes, without those that are no UTF-8, are over 4 printable units."""

    def decoded(run: Column) -> Column:
        plain = F.make_valid_utf8(F.try_to_binary(run, F.lit("base64")).cast("string"))
        plain = F.regexp_replace(F.replace(plain, F.lit("\ufffd"), F.lit("")), r"\A\x{feff}", "")
        return F.coalesce(let(plain, lambda p: F.when((utf16_length(p) > 4) & printable(p), p)), run)

    return F.when(F.rlike(text, F.lit(BASE64)), rewrite(text, BASE64, decoded)).otherwise(text)


def rot13(text: Column) -> Column:
    return F.translate(text, _UPPER + _LOWER, _ROTATED)


def join_padded(text: Column) -> Column:
    """Single letters spelled out with dots, dashes, underscores or spaces, three or more, as the word they spell.

    Spaces join within the parts between wider gaps; each wider gap becomes one space.
    """
    padded = r"(?<![A-Za-z0-9_])[a-zA-Z][.\-_][a-zA-Z](?:[.\-_][a-zA-Z])+(?![A-Za-z0-9_])"
    dotted = F.when(F.rlike(text, F.lit(r"[.\-_][a-zA-Z][.\-_]")), rewrite(text, padded, lambda m: F.regexp_replace(m, r"[.\-_]", ""))).otherwise(text)
    spaced = r"(?<![A-Za-z0-9_])(?:[a-zA-Z] ){2,}[a-zA-Z](?![A-Za-z0-9_])"
    gap = rf"[{dialect.WHITE}]{{2,}}"

    def joined(text: Column) -> Column:
        parts = F.split(text, gap, -1)
        return F.array_join(F.transform(parts, lambda p: F.when(F.rlike(p, F.lit(spaced)), rewrite(p, spaced, lambda m: F.replace(m, F.lit(" "), F.lit("")))).otherwise(p)), " ")

    # Most texts have no letters apart: only their gaps become spaces.
    plain = lambda t: F.when(ascii_only(t), F.regexp_replace(t, r"[\t-\r ]{2,}", " ")).otherwise(F.regexp_replace(t, gap, " "))
    return let(dotted, lambda t: F.when(F.rlike(t, F.lit(" [a-zA-Z] [a-zA-Z]")), joined(t)).otherwise(plain(t)))


def backwards(text: Column) -> Column:
    """A text reversed by grapheme clusters, as in the queries' SQL: marks stay behind their letters."""
    clusters = F.regexp_extract_all(text, F.lit(r"\X"), F.lit(0))
    return F.when(ascii_only(text), F.reverse(text)).otherwise(F.array_join(F.reverse(clusters), ""))


def enrich_rot13(text: Column) -> Column:
    turned = rot13(text)
    return F.when(turned != text, F.concat_ws(" ", text, turned)).otherwise(text)


def enrich_shape(text: Column) -> Column:
    """Append the reading of a leading l as i, if it differs."""
    shape = F.regexp_replace(text, "l(?<![A-Za-z0-9_]l)(?=[a-z])", "i")  # the letter first, which is quicker to find
    return F.when(shape != text, F.concat_ws(" ", text, shape)).otherwise(text)


#: The decoders of one pass, in order.
DECODERS = (decode_entities, decode_percent, decode_hex, decode_base64)


def normalized(df: DataFrame, text: str, out: str = "normalized") -> DataFrame:
    """df with the normalised form of a text column (null stays null).

    invisible characters, NFKC, look-alikes; three times entities, percent, hex and base64 decoding; leet,
    padding, white space; then the rotated text, for short ones the reversed text and the shape reading too.
    """
    work = "__norm"

    def stage(frame: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
        return frame.withColumn(work, f(F.col(work)))

    df = stage(df.withColumn(work, F.col(text)), strip_invisible).withColumn(work, nfkc(work))
    df = stage(df, replace_look_alikes)
    for n in range(DECODE_PASSES):
        # What a pass leaves as it was, the next ones would too.
        again = F.lit(True) if n == 0 else F.col("__again")
        df = df.withColumn("__before", F.col(work))
        for f in DECODERS:
            df = stage(df, lambda t, f=f: F.when(again, f(t)).otherwise(t) if n else f(t))
        df = df.withColumn("__again", F.col("__before") != F.col(work)) if n + 1 < DECODE_PASSES else df
    for f in (decode_leet, join_padded, collapse_white):
        df = stage(df, f)
    df = df.withColumn("__short", utf16_length(F.col(work)) <= ENRICH_MAX)
    df = stage(df, enrich_rot13)
    df = stage(df, lambda t: F.lower(F.when(F.col("__short"), F.concat_ws(" ", t, backwards(t))).otherwise(t)))
    df = stage(df, lambda t: F.when(F.col("__short"), enrich_shape(t)).otherwise(t))
    return df.drop("__short", "__before", "__again").withColumnRenamed(work, out)

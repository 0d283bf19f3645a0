"""Text predicates and rewrites as Column expressions; Python only for Unicode forms and alignment."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Typographic signs and the ASCII signs they fold to.
FOLD_FROM = "‘’ʼ‚“”„‐‑‒–—−•·●▪‣"
FOLD_TO = "''''" + '"""' + "------" + "-----"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
#: Unicode white space, as Python's \s has it.
SPACE = r"(?U)\s"
SUPERSCRIPTS, PLAIN_DIGITS = "⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789"
#: First sign, first number and count of the enclosed numbers ⓪, ① to ⑳, ⑴ to ⒇, ⒈ to ⒛, ❶ to ❿, ➀ to ➉ and ➊ to ➓.
ENCLOSED_RUNS = (("⓪", 0, 1), ("①", 1, 20), ("⑴", 1, 20), ("⒈", 1, 20), ("❶", 1, 10), ("➀", 1, 10), ("➊", 1, 10))
ENCLOSED = {chr(ord(first) + i): n + i for first, n, count in ENCLOSED_RUNS for i in range(count)}
#: Signs that mark notes, and German abbreviations that look like lettered notes: a letter with what follows it.
NOTE_SIGNS = "*†‡§¶#"
ABBREVIATIONS = {"d": ("h.", "i."), "z": ("b.",), "u": ("a.",), "s": ("den", "die", "das", "auch", "oben", "unten")}


def text_of(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def count_of(text: Column, pattern: str) -> Column:
    """How many times a pattern matches; 0 in a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))


def without(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def visible(text: Column) -> Column:
    """Characters that are not white space."""
    return F.length(without(text_of(text), SPACE))


def fold_typography(text: Column) -> Column:
    return F.translate(text, FOLD_FROM, FOLD_TO)


def words_of(text: Column) -> Column:
    """Maximal runs without white space."""
    return F.regexp_extract_all(text_of(text), F.lit(r"(\S+)"), 1)


def quality_reasons(text: Column) -> Column:
    """Why a text layer needs review, in a fixed order; empty: it is good."""
    t, n = text_of(text), F.greatest(F.lit(1), F.length(text_of(text)))
    words = words_of(t)
    hidden = count_of(t, r"\p{C}") - count_of(t, r"[\n\t]")
    reasons = {
        "empty_text": F.length(F.trim(without(t, SPACE))) == 0,
        "control_characters": count_of(t, CONTROL) / n > 0.02,
        "replacement_characters": count_of(t, "\ufffd") / n > 0.01,
        "repeated_text": (F.size(words) >= 8) & (F.size(F.array_distinct(words)) <= F.greatest(F.lit(1), F.floor(F.size(words) / 4))),
        "low_printable_ratio": (F.length(t) > 0) & ((F.length(t) - hidden) / n < 0.95),
    }
    return F.filter(F.array(*(F.when(test, F.lit(name)) for name, test in reasons.items())), lambda r: r.isNotNull())


def alnum_ratio(text: Column) -> Column:
    """Letters and digits among what is neither space nor newline; 1 where nothing is."""
    t = without(text_of(text), "[ \n]")
    return F.when(F.length(t) == 0, F.lit(1.0)).otherwise(count_of(t, r"[\p{L}\p{N}]") / F.length(t))


def looks_badly_read(text: Column, spaces: float = 0.7, newlines: float = 0.6, alnum: float = 0.3) -> Column:
    """Text that recognition has spoilt: gaps, line breaks, signs or replacement characters abound."""
    t = text_of(text)
    gaps, solid = count_of(t, r"\s+"), F.length(without(t, r"\s+"))
    breaks, rest = count_of(t, "\n+"), F.length(without(t, "\n+"))
    return (
        (F.length(t) == 0)
        | (gaps / (solid + gaps) > spaces)
        | (breaks / (breaks + rest) > newlines)
        | (alnum_ratio(t) < alnum)
        | (count_of(t, "\ufffd") > F.greatest(F.lit(6.0), F.length(t) * 0.03))
    )


def repair_hyphens(text: Column) -> Column:
    """Join a Latin word cut by a hyphen at a line's end, where it goes on in lower case."""
    return F.regexp_replace(text, r"([A-Za-z]{2,})-\n([a-z][A-Za-z]{1,})", "$1$2")


def edge_text(text: Column) -> Column:
    """A running line without the numbers at its ends."""
    t = F.regexp_replace(F.regexp_replace(text_of(text), "\n", ""), r"^\s+|\s+$", "")
    return F.regexp_replace(F.regexp_replace(t, r"^\d+\s*", ""), r"\s*\d+$", "")


def strip_markdown_noise(text: Column, level: int = 1) -> Column:
    """Drop the marks that open lines: `#` (1), also list marks (2), also quotes, rules and bars (3)."""
    marks = {1: r"[#]", 2: r"[#*+\-]", 3: r"[#*+\->|=_~]"}[level]
    return F.regexp_replace(text, rf"(?m)^([ \t]*){marks}+[ \t]+", "$1")


def superscript_calls(text: Column) -> Column:
    """Superscripts in LaTeX, caret and Unicode notation, and those with a bracket inside, as `<sup>n</sup>` at the end of what they follow."""
    t = F.regexp_replace(text, r"\\\(\s*\^\s*\{?([0-9]{1,4})\}?\s*\\\)", "<sup>$1</sup>")
    t = F.regexp_replace(t, r"\$\s*\^\s*\{?([0-9]{1,4})\}?\s*\$", "<sup>$1</sup>")
    t = F.regexp_replace(t, r"\^([0-9]{1,4})\^", "<sup>$1</sup>")
    for sign, digit in zip(SUPERSCRIPTS, PLAIN_DIGITS, strict=True):
        t = F.regexp_replace(t, sign, f"<sup>{digit}</sup>")
    t = F.regexp_replace(t, r"(?i)<sup>\s*([0-9]{1,4}|[ivxlcdm]{1,12})\s*\)\s*</sup>", "<sup>$1</sup>")
    t = F.regexp_replace(t, "</sup><sup>", "")
    # a call on a line of its own belongs to the end of the line before
    return F.regexp_replace(t, r"(?i)(\S)\s*\n\s*(<sup>(?:[0-9]{1,4}|[ivxlcdm]{1,12})</sup>)[ \t]*(?=\n|$)", "$1$2")


def roman_value(text: Column) -> Column:
    """A Roman numeral's value, null where the text is none; a smaller sign before a larger is taken off."""
    value = lambda c: F.element_at(F.create_map(*(F.lit(x) for p in zip("ivxlcdm", (1, 5, 10, 50, 100, 500, 1000), strict=True) for x in p)), c)
    low = F.lower(text)
    signs = F.transform(F.reverse(F.split(low, "")), value)
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("prev"))
    folded = F.aggregate(signs, start, lambda acc, v: F.struct((acc["sum"] + F.when(v < acc["prev"], -v).otherwise(v)).alias("sum"), v.alias("prev")), lambda acc: acc["sum"])
    return F.when(low.rlike("^[ivxlcdm]+$"), folded)


def roman_text(number: Column) -> Column:
    """A number from 1 to 3999 as a lower-case Roman numeral."""
    steps = list(zip((1000, 900, 500, 400, 100, 90, 50, 40, 10, 9, 5, 4, 1), ("m", "cm", "d", "cd", "c", "xc", "l", "xl", "x", "ix", "v", "iv", "i"), strict=True))
    out, rest = F.lit(""), number.cast("int")
    for value, sign in steps:
        out = F.concat(out, F.repeat(F.lit(sign), F.floor(rest / value).cast("int")))
        rest = rest % value
    return F.when(number.between(1, 3999), out)


def only(text: Column, signs: str, most: int = 64) -> Column:
    """The text has 1 to `most` signs, all of them among `signs`."""
    return (F.length(text).between(1, most)) & (F.length(F.translate(text, signs, "")) == 0)


def is_abbreviation(text: Column) -> Column:
    """Opens with an abbreviation of prose: a letter with a point, and what follows it in ABBREVIATIONS; `s.` also before a digit."""
    low = F.lower(F.ltrim(text))
    letter, rest = F.substring(low, 1, 1), F.ltrim(F.substring(low, 3, 20))
    word = F.regexp_extract(rest, r"^\w+", 0)
    tests = [(letter == one) & F.concat(word, F.substring(rest, F.length(word) + 1, F.lit(1))).isin(*after) if after[0].endswith(".") else (letter == one) & (word.isin(*after) | F.substring(rest, 1, 1).between("0", "9")) for one, after in ABBREVIATIONS.items()]
    found = tests[0]
    for test in tests[1:]:
        found = found | test
    return (F.substring(low, 2, 1) == ".") & found


def marker_of(text: Column) -> Column:
    """The footnote marker that opens a text: struct(original, normalized, style), or null.

    What the text opens with says where the marker ends: `<sup>` at its closing tag, `\\(` at `\\)`, `(` at
    `)` and a space, a caret after its digits; a sign that is a number itself, superscript or in a
    ring, ends with itself. Else the first word is one, with or without a point or bracket: digits, a
    Roman numeral or note signs, and a single letter if it has either. An abbreviation is none.
    """
    t = F.regexp_replace(text, r"^\s+", "")
    digits = lambda c: only(c, PLAIN_DIGITS, 4)
    roman = lambda c: only(F.lower(c), "ivxlcdm", 12)
    ring = F.substring(t, 1, 1)
    raised = F.regexp_extract(t, f"^[{SUPERSCRIPTS}]*", 0)
    # between the opening and its end
    tagged = F.trim(F.regexp_extract(t, "(?is)^<sup[^>]*>(.*?)</sup>", 1))
    is_tagged = digits(tagged) | roman(tagged) | tagged.rlike("^[A-Za-z]{1,3}$") | only(tagged, SUPERSCRIPTS) | tagged.isin(*ENCLOSED) | only(tagged, NOTE_SIGNS)
    bare = lambda c: F.translate(F.regexp_replace(c, r"\s", ""), "{}", "")
    latex = bare(F.substring_index(F.substring(t, 3, 40), r"\)", 1))
    power = F.substring(latex, 2, 40)
    is_latex = t.startswith(r"\(") & t.contains(r"\)") & latex.startswith("^") & digits(power)
    caret = F.regexp_extract(t, r"^\^([0-9]{1,4})", 1)
    word = F.regexp_extract(t, r"^(\S{1,20})\s", 1)
    bracketed = F.regexp_replace(F.substring(word, 2, 20), r"\)\.?$", "")
    is_bracketed = word.startswith("(") & (F.length(bracketed) < F.length(word) - 1) & digits(bracketed)
    core = F.regexp_replace(word, r"[.)]$", "")
    is_plain = ~is_abbreviation(text) & (digits(core) | roman(core) | only(core, NOTE_SIGNS) | ((core != word) & core.rlike("^[A-Za-z]$")))
    tests = [(is_tagged, tagged), (ring.isin(*ENCLOSED), ring), (F.length(raised) > 0, raised), (is_latex, power), (F.length(caret) > 0, caret), (is_bracketed, bracketed), (is_plain, core)]
    number = F.create_map(*(F.lit(x) for c, n in ENCLOSED.items() for x in (c, str(n))))

    def told(original: Column) -> Column:
        plain = F.translate(original, SUPERSCRIPTS, PLAIN_DIGITS)
        normal = F.coalesce(F.try_element_at(number, original), F.when(only(plain, PLAIN_DIGITS), plain.cast("int").cast("string")).otherwise(F.lower(original)))
        style = F.when(original.isin(*ENCLOSED), "enclosed").when(only(plain, PLAIN_DIGITS), "numeric").when(roman(original), "roman").when(original.rlike("^[A-Za-z]{1,3}$"), "alpha").otherwise("symbol")
        return F.struct(original.alias("original"), normal.alias("normalized"), style.alias("style"))

    # one element per form that fits, so that the forms stand in the plan once
    fits = F.filter(F.array(*(F.when(test, found) for test, found in tests)), lambda m: m.isNotNull())
    return F.try_element_at(F.transform(F.slice(fits, 1, 1), told), F.lit(1))


def redact_credentials(text: Column) -> Column:
    """Blank the password of a URL and the values of keys that name a secret."""
    t = F.regexp_replace(text, r"(?i)([a-z][a-z0-9+.-]*://[^\s/:@]+):[^\s/@]+@", "$1:***@")
    return F.regexp_replace(t, r"(?i)\b((?:api[_-]?key|token|secret|password)\s*[=:]\s*)[^\s&,;]+", "$1***")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def cell_text(text: Column) -> Column:
    """A table cell's text: no dot leaders, plain LaTeX signs, single spaces."""
    t = F.regexp_replace(text, r"(?:\.\s*){4,}", " ")
    t = F.regexp_replace(t, r"\\(?:text|mathrm|mathbf)\{([^}]*)\}", "$1")
    t = F.regexp_replace(t, r"\\([%$&#_])", "$1")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def mostly_rtl(text: Column, share: float = 0.3) -> Column:
    """More than `share` of the letters belong to Hebrew or Arabic blocks."""
    return count_of(text, r"[\u0590-\u08ff\ufb1d-\ufdff\ufe70-\ufeff]") > share * count_of(text, r"\p{L}")


#: Fixed value: signs or bytes of a batch that are parsed before their results leave the worker.
AT_ONCE = 1 << 20


def slices(texts: pd.Series, most: int = AT_ONCE) -> Iterator[pd.Series]:
    """A batch in parts of `most` signs, or of one longer text: what a parser makes of a part may leave before the next is read."""
    start = size = 0
    for i, t in enumerate(texts):
        n = 0 if t is None else len(t)
        if size + n > most and i > start:
            yield texts.iloc[start:i]
            start, size = i, 0
        size += n
    yield texts.iloc[start:]


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(T.StringType())
def casefold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else t.casefold())


def squeezed(text: Column, keep_spaces: bool = False) -> Column:
    """NFKC without white space, or with single spaces."""
    t = nfkc(text_of(text))
    return F.trim(F.regexp_replace(t, SPACE + "+", " ")) if keep_spaces else without(t, SPACE + "+")


def clean_line(text: Column) -> Column:
    """NFC, no replacement or zero-width characters, controls and spaces as single spaces."""
    return clean_composed(nfc(text_of(text)))


def clean_composed(text: Column) -> Column:
    """The same of a line of a text in NFC: nothing composes over a line's end, so whole texts may be brought there in one call before they are split."""
    t = F.translate(text, "\ufffd\u200b", "")
    return F.trim(F.regexp_replace(t, rf"(?U)[{CONTROL[1:-1]}\s]+", " "))


def _common_length(a: str, b: str) -> int:
    """The longest common subsequence's length, over machine-word rows."""
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for ch in b:
        hit = row & places.get(ch, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


@F.pandas_udf(T.DoubleType())
def indel_ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """100 x twice the longest common subsequence, over both lengths; 100 for two empty texts."""
    for left, right in pairs:
        yield pd.Series([None if a is None or b is None else 100.0 if not a and not b else 200.0 * _common_length(a, b) / (len(a) + len(b)) for a, b in zip(left, right, strict=True)], dtype="float64")


def sequence_distance(a: list, b: list) -> int:
    """Edit distance of two sequences, a row at a time."""
    row = np.arange(len(b) + 1)
    right = np.array([hash(x) for x in b], dtype=np.int64)
    for x in a:
        step = np.minimum(row[1:] + 1, row[:-1] + (right != hash(x)))
        first = row[0] + 1
        row = np.concatenate([[first], step])
        row = np.minimum.accumulate(row - np.arange(len(row))) + np.arange(len(row))
    return int(row[-1])


def edit_distance(a: str, b: str, most: int) -> int:
    """Edit distance of two texts, over machine-word columns; beyond `most`, some number above it. A step for each sign of the shorter text, whose bits are the longer one's."""
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    found: dict[str, list[int]] = {ch: [] for ch in b}
    for i, ch in enumerate(a):
        if ch in found:
            found[ch].append(i)
    places: dict[str, int] = {}
    for ch, at in found.items():
        bits = np.zeros(len(a), bool)
        bits[at] = True
        places[ch] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    full, top, score = (1 << len(a)) - 1, len(a) - 1, len(a)
    up, down = full, 0
    for j, ch in enumerate(b, 1):
        same = places.get(ch, 0)
        step = (((same & up) + up) ^ up) | same | down
        right = down | full & ~(step | up)
        left = up & step
        score += (right >> top & 1) - (left >> top & 1)
        if score - (len(b) - j) > most:  # each sign that is left takes off one at most
            return most + 1
        right, same = (right << 1 | 1) & full, same | down
        up = (left << 1) & full | full & ~(same | right)
        down = right & same
    return score


@F.pandas_udf(T.LongType())
def edits(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Edit distance of two whole texts, a column of bits at a time: memory grows with the text, not with its square."""
    for left, right in pairs:
        yield pd.Series([None if a is None or b is None else edit_distance(a, b, len(a) + len(b)) for a, b in zip(left, right, strict=True)], dtype="Int64")


@F.pandas_udf(T.BooleanType())
def halves_alike(texts: pd.Series) -> pd.Series:
    """Whether edits between a text's halves are 15 % of one at most: similarity of 0.85."""

    def alike(t: str) -> bool:
        half = len(t) // 2
        return half > 0 and 1 - edit_distance(t[:half], t[half : 2 * half], int(0.15 * half) + 1) / half >= 0.85

    return pd.Series([None if t is None else alike(t) for t in texts], dtype=object)


#: Chinese digits and units.
CHINESE_DIGITS = {c: i for i, c in enumerate("零一二三四五六七八九")} | {"〇": 0, "两": 2}
CHINESE_UNITS = {"十": 10, "百": 100, "千": 1000}


def chinese_value(text: str | None) -> int | None:
    """Digits side by side are positional; with units, each digit counts its unit, a bare unit one."""
    if not text or any(c not in CHINESE_DIGITS and c not in CHINESE_UNITS for c in text):
        return None
    if not any(c in CHINESE_UNITS for c in text):
        return int("".join(str(CHINESE_DIGITS[c]) for c in text))
    total = digit = 0
    for c in text:
        if c in CHINESE_UNITS:
            total, digit = total + (digit or 1) * CHINESE_UNITS[c], 0
        else:
            digit = CHINESE_DIGITS[c]
    return total + digit


@F.pandas_udf(T.IntegerType())
def chinese_number(texts: pd.Series) -> pd.Series:
    return texts.map(chinese_value).astype("Int32")

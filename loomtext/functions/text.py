"""Text columns in native expressions: tokens, fingerprints, DOI and title keys, word classes."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F

# Patterns and word lists that decide which words match.
WORD = r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*"
PIECE = r"[^\p{L}\p{N}]*" + WORD
MARKED = r"(?:[\p{L}\p{N}]\p{M}*)+(?:['’](?:[\p{L}\p{N}]\p{M}*)+)*"
TYPED = r"\b[0-9]+(?:[.,][0-9]+)+\b|" + MARKED
UNITS = TYPED + r"|[=<>≈]"
BOILERPLATE = (
    "(?i)all rights reserved|creative commons|conflicts? of interest|no competing interests|data (?:are|is) available|"
    "informed consent|institutional review board|statistically significant"
)
NUMERAL = r"^[0-9]+(?:[.,][0-9]+)*$"
DOI = r"10\.[0-9]{4,9}/[^\s<>\"]+"
STOPWORDS = (
    "a an and are as at be been being but by can could did do does done for from had has have having he her hers him his how i "
    "if in into is it its itself may might more most must no nor not of off on once only or other our ours out over own same she "
    "should so some such than that the their theirs them then there these they this those through to too under until up very was "
    "we were what when where which while who whom why will with would you your also both each few further here just via per vs al et"
).split()
STATISTICS = "b d f m n p r t z df sd se sem ci es η β χ μ σ ρ".split()


def fold(text: Column) -> Column:
    """Case-folded text with straight apostrophes: lower case, and the letters whose folding is more than that."""
    return F.replace(F.replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ")), F.lit("’"), F.lit("'"))


def words(text: Column, pattern: str = WORD) -> Column:
    """Array of the case-folded word units of the text; null text gives null."""
    return F.regexp_extract_all(fold(text), F.lit(pattern), F.lit(0))


#: Characters of words, or unknown to the JVM, that fold() does not turn into what compatibility normalisation and full case folding give, or may not.
UNUSUAL = r"[\p{L}\p{N}\p{M}\p{Cn}&&[^A-Za-z0-9À-ÖØ-öø-ÿ]]"


def exact_words(text: Column, pattern: str = WORD) -> Column:
    """words() with every word in NFKC and fully case-folded.

    Only texts with a character beyond ASCII and the Latin letters up to ÿ leave the native path, in Arrow batches.
    """

    @F.pandas_udf("array<string>")
    def normal(texts: pd.Series) -> pd.Series:
        import regex

        find = regex.compile(pattern).findall
        fold_one = lambda w: unicodedata.normalize("NFKC", w).casefold().replace("’", "'")
        return texts.map(lambda t: None if t is None else [fold_one(w) for w in find(t)])

    unusual = text.rlike(UNUSUAL)
    return F.when(unusual, normal(F.when(unusual, text))).otherwise(words(text, pattern))


def fingerprint(text: Column) -> Column:
    """SHA-256 of the words joined by blanks: equal for texts that differ in spacing and marks only."""
    return F.sha2(F.array_join(words(text), " "), 256)


def ledger_hash(text: Column) -> Column:
    """SHA-256 of the words as a compact JSON list; a null text has none."""
    return F.sha2(F.to_json(words(text)), 256)


def numeric_prefix(a: Column, b: Column) -> Column:
    """How many leading characters two different numerals share, if a decimal mark is among them, else 0; 0 for other words."""
    numerals = a.rlike(NUMERAL) & b.rlike(NUMERAL)
    same = F.array_max(F.filter(F.sequence(F.lit(0), F.least(F.length(a), F.length(b))), lambda k: a.substr(F.lit(1), k) == b.substr(F.lit(1), k)))
    return F.when(numerals & (a != b) & a.substr(F.lit(1), same).rlike("[.,]"), same).otherwise(0)


def is_content(w: Column, least: int = 3) -> Column:
    """A word of letters only, long enough and no stop word."""
    return w.rlike(r"^\p{L}+$") & (F.length(w) >= least) & ~w.isin(STOPWORDS)


def is_meaningful(w: Column) -> Column:
    """A statistic token, a number literal, or a content word of at least two letters."""
    return w.isin(STATISTICS) | w.rlike(r"^[0-9]+(?:[.,][0-9]+)*$") | is_content(w, 2)


def utf8_edits(a: Column, b: Column) -> Column:
    """Edits between the UTF-8 forms of two words, byte by byte."""
    return F.levenshtein(*(F.decode(F.encode(x, "UTF-8"), "ISO-8859-1") for x in (a, b)))


def ending_credit(a: Column, b: Column, edits: Column | None = None) -> Column:
    """Credit (1 - edits / longer length) of two words of five letters or more that share all but two letters at the end, else 0.

    Edits are those of letters unless others are given.
    """
    longest = F.greatest(F.length(a), F.length(b))
    stem = F.greatest(longest - 2, F.lit(5))
    near = (F.least(F.length(a), F.length(b)) >= 5) & (F.abs(F.length(a) - F.length(b)) <= 2)
    distance = F.levenshtein(a, b) if edits is None else edits
    credit = 1 - distance / longest
    same = a.substr(F.lit(1), stem) == b.substr(F.lit(1), stem)
    return F.when(near & same & distance.between(1, 2) & (credit >= 0.85), credit).otherwise(F.lit(0.0))


def doi_key(value: Column) -> Column:
    """Lenient DOI: found in the decoded value, trailing marks dropped, closing brackets balanced, lower case; empty if none."""
    found = F.regexp_extract(F.trim(F.coalesce(value, F.lit(""))), "(?i)" + DOI, 0)
    found = F.regexp_replace(found, r"[.,;]+$", "")
    opened, closed = (F.length(found) - F.length(F.replace(found, F.lit(c))) for c in "()")
    extra = F.greatest(closed - opened, F.lit(0))
    tail = F.length(F.regexp_extract(found, r"\)*$", 0))
    return F.lower(found.substr(F.lit(1), F.length(found) - F.least(extra, tail)))


def title_key(title: Column) -> Column:
    """Title without tags, version notes and marks, lower-cased words joined by blanks."""
    plain = F.lower(F.regexp_replace(F.coalesce(title, F.lit("")), "<[^>]+>", ""))
    plain = F.regexp_replace(plain, r"\s*[\[(](?:preprint|accepted manuscript|version\s*[0-9]+|v[0-9]+)[\])]\s*", " ")
    return F.array_join(F.regexp_extract_all(plain, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), " ")


def context(text: Column, start: Column, end: Column, most: int = 600) -> tuple[Column, Column]:
    """Bounds of [start, end) widened by at most `most` characters each way, to the nearest end of a sentence or paragraph if one is there."""
    left = F.greatest(start - most, F.lit(0))
    before, after = text.substr(left + 1, start - left), text.substr(end + 1, F.lit(most))
    first = r"(?s)^(.*?(?:[.!?][\"”]?(?=\s|$)|\n[ \t]*\n))"
    reach = F.length(F.regexp_extract(after, first, 1))
    lo = left + F.length(F.regexp_extract(before, r"(?s)^.*(?:[.!?][\"”]?\s+|\n[ \t]*\n)", 0))
    return lo, F.when(reach > 0, end + reach).otherwise(F.least(end + most, F.length(text)))


def csv_safe(value: Column) -> Column:
    """A cell that no spreadsheet takes for a formula."""
    return F.when(value.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), value)).otherwise(value)

"""Stems of words by language: ordered suffix rules, as Column expressions and, for the words of a query, in Python.

A rule is a pattern and what it puts in place of a match; each is tried once, in order, on a lower-case word. The patterns mean the
same in Java, RE2 and Python, so that SQL can run them. They conflate inflections and leave the parts of speech apart; words of languages without
rules, and words with digits, stay as they are.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that are written alike before the rules of a language.
FOLDS = {
    "de": ("äöü", "aou"),
    "es": ("áéíóúü", "aeiouu"),
    "fr": ("àâäéèêëîïôöùûüç", "aaaeeeeiioouuuc"),
}
#: Fixed values: (pattern, replacement) in the order in which they are tried; $1 to $9 are groups.
RULES = {
    "en": (
        (r"^(..+)(?:ies|ied)$", "$1y"),
        (r"^(..+(?:ss|sh|ch|x|z))es$", "$1"),
        (r"^(..+[^siu])s$", "$1"),
        (r"^(..*[aeiouy].*?)(?:ingly|edly|ing|ed|ly)$", "$1"),
        (r"^(.+[aeiouy])(?:(b)b|(d)d|(g)g|(m)m|(n)n|(p)p|(r)r|(t)t)$", "$1$2$3$4$5$6$7$8$9"),
        (r"^(...*[^e])e$", "$1"),
        (r"^(..+[^aeiou])y$", "$1i"),
    ),
    "de": (
        (r"^(...+in)nen$", "$1"),
        (r"^(...+?)(?:ern|em|er|en|es|e)$", "$1"),
        (r"^(..+[bdfghklmnrt])s$", "$1"),
        (r"^(...+?)(?:est|er|en|st)$", "$1"),
    ),
    "fr": (
        (r"^(..+)aux$", "$1al"),
        (r"^(...+?)(?:issons|issez|issent|erons|eront|erait|aient|erai|ions|iez|ait|ais|ons|ent|ant|ees|es|ez|er|ee|e|s|x)$", "$1"),
        (r"^(...+?)(?:e|i)$", "$1"),
    ),
    "es": (
        (r"^(..+)ces$", "$1z"),
        (r"^(...+?)(?:aciones|acion)$", "$1ac"),
        (r"^(...+?)(?:ariamos|eriamos|amente|mente|abamos|aremos|ieron|iendo|amos|emos|imos|aron|ando|aban|aba|ados|adas|idos|idas|ado|ada|ido|ida|ar|er|ir|es|os|as|an|en|o|a|e|s)$", "$1"),
    ),
}


def language(column: Column) -> Column:
    """The part of a language code before its region, lower-cased; empty where there is none."""
    return F.lower(F.regexp_extract(F.trim(F.coalesce(column, F.lit(""))), r"^([A-Za-z]*)", 1))


def _stem(word: Column, code: str) -> Column:
    out = F.translate(word, *FOLDS[code]) if code in FOLDS else word
    for pattern, new in RULES[code]:
        out = F.regexp_replace(out, pattern, new)
    return F.when(word.rlike("[0-9]"), word).otherwise(out)


def stem(word: Column, code: Column) -> Column:
    """The stem of a lower-case word in the language of ``code``."""
    out = word
    for known in RULES:
        out = F.when(code == known, _stem(word, known)).otherwise(out)
    return out


_LETTERS = {code: str.maketrans(*pair) for code, pair in FOLDS.items()}
_SUBSTITUTES = {code: [(re.compile(pattern).sub, re.sub(r"\$(\d)", r"\\g<\1>", new)) for pattern, new in rules] for code, rules in RULES.items()}
_DIGIT = re.compile("[0-9]")


def stem_word(word: str, code: str) -> str:
    """The same for one word."""
    if code not in RULES or _DIGIT.search(word):
        return word
    out = word.translate(_LETTERS[code]) if code in FOLDS else word
    for substitute, new in _SUBSTITUTES[code]:
        out = substitute(new, out)
    return out


def stem_sql(word: str, code: str) -> str:
    """The same as SQL for DuckDB."""

    def one(known: str) -> str:
        out = f"translate({word}, '{FOLDS[known][0]}', '{FOLDS[known][1]}')" if known in FOLDS else word
        for pattern, new in RULES[known]:
            out = f"regexp_replace({out}, '{pattern}', '{new.replace('$', chr(92))}')"
        return f"WHEN {code} = '{known}' AND NOT regexp_matches({word}, '[0-9]') THEN {out}"

    return f"CASE {' '.join(map(one, RULES))} ELSE {word} END"

"""Stems of English words by Porter's algorithm (1980): ordered suffix rules on columns of words, as regular expressions.

A word is read as [C](VC)^m[V]; conditions on m, on a vowel in the stem, on a double consonant and on a final consonant-vowel-consonant
are patterns on the part before the suffix.  Of a step's suffixes the longest that fits the word is the only one that is tried.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

C = "[^aeiou]"
V = "[aeiouy]"
CS = f"{C}[^aeiouy]*"
VS = f"{V}[aeiou]*"
MORE_THAN_0 = f"^({CS})?{VS}{CS}"
EXACTLY_1 = f"^({CS})?{VS}{CS}({VS})?$"
MORE_THAN_1 = f"^({CS})?{VS}{CS}{VS}{CS}"
WITH_VOWEL = f"^({CS})?{V}"
SHORT_END = f"^{CS}{V}[^aeiouwxy]$"

# The published rules, suffix and replacement, in the order of the paper.
STEP_2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _longest(rules: list[tuple[str, str]]) -> list[tuple[str, str]]:
    return sorted(rules, key=lambda r: -len(r[0]))


def _cut(word: Column, suffix: str) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - len(suffix))


def _replaced(word: Column, rules: list[tuple[str, str]], condition: str) -> Column:
    """The longest suffix that fits is replaced if what stands before it meets the condition."""
    out = None
    for suffix, new in _longest(rules):
        before = _cut(word, suffix)
        # an "ion" needs an s or t before it
        ok = before.rlike(condition) & (before.rlike("[st]$") if suffix == "ion" else F.lit(True))
        value = F.when(ok, F.concat(before, F.lit(new))).otherwise(word)
        out = F.when(word.endswith(suffix), value) if out is None else out.when(word.endswith(suffix), value)
    return out.otherwise(word)


def _plural(w: Column) -> Column:
    return F.when(w.rlike("(ss|i)es$"), _cut(w, "es")).when(w.rlike("[^s]s$"), _cut(w, "s")).otherwise(w)


def _past(w: Column) -> Column:
    def mended(stem: Column) -> Column:
        double = stem.rlike(r"([^aeiouylsz])\1$")
        return F.when(stem.rlike("(at|bl|iz)$") | stem.rlike(SHORT_END), F.concat(stem, F.lit("e"))).when(double, _cut(stem, "x")).otherwise(stem)

    tried = lambda suffix: let(_cut(w, suffix), lambda s: F.when(s.rlike(WITH_VOWEL), mended(s)).otherwise(w))
    return F.when(w.endswith("eed"), F.when(_cut(w, "eed").rlike(MORE_THAN_0), _cut(w, "d")).otherwise(w)).when(w.endswith("ed"), tried("ed")).when(w.endswith("ing"), tried("ing")).otherwise(w)


def _y(w: Column) -> Column:
    return F.when(w.endswith("y") & _cut(w, "y").rlike(WITH_VOWEL), F.concat(_cut(w, "y"), F.lit("i"))).otherwise(w)


def _final(w: Column) -> Column:
    stem = _cut(w, "e")
    cut = F.when(w.endswith("e") & (stem.rlike(MORE_THAN_1) | (stem.rlike(EXACTLY_1) & ~stem.rlike(SHORT_END))), stem).otherwise(w)
    return let(cut, lambda x: F.when(x.endswith("ll") & x.rlike(MORE_THAN_1), _cut(x, "l")).otherwise(x))


def stem(word: Column) -> Column:
    """The stem of a lower-case word; words of fewer than 3 letters, and those with other signs than a to z, stay as they are."""
    steps = [_plural, _past, _y, lambda w: _replaced(w, STEP_2, MORE_THAN_0), lambda w: _replaced(w, STEP_3, MORE_THAN_0), lambda w: _replaced(w, [(s, "") for s in STEP_4], MORE_THAN_1), _final]

    def run(w: Column, rest: list) -> Column:
        return let(rest[0](w), lambda x: run(x, rest[1:])) if len(rest) > 1 else rest[0](w)

    # a first y is a consonant; as a capital it is none of the vowels
    start = F.when(word.startswith("y"), F.concat(F.lit("Y"), F.substring(word, 2, 1 << 20))).otherwise(word)
    return F.when(word.rlike("^[a-z]{3,}$"), F.lower(let(start, lambda w: run(w, steps)))).otherwise(word)


def stems(words: Column) -> Column:
    """The stems of an array of words."""
    return F.transform(words, stem)

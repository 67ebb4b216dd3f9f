"""Column functions on texts: cleaning, response parsing, and similarity of two texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import DAY_PERIODS, NIGHT

#: Fixed value: the 32 punctuation signs of ASCII.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Fixed value: the language of numbered listings; responses are parsed alike only if the very same ones count as listings.
LISTING = r"(\d+)\.?\s+([a-zA-Z][a-zA-Z\s]*?)(?=\s*\d+\.?\s+[a-zA-Z]|\s*$)"


def let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.transform(F.array(value), body)[0]


def both(a: Column, b: Column, body) -> Column:
    """body(a, b), with each worked out once; functions of arrays that look at an element at a time need that."""
    return let(a, lambda x: let(b, lambda y: body(x, y)))


def without_punctuation(text: Column) -> Column:
    return F.translate(text, PUNCTUATION, "")


def cleaned(text: Column) -> Column:
    return F.lower(without_punctuation(text))


def stripped(text: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(text, F.lit(" \t\n\r\f\v"))


def file_name(text: Column) -> Column:
    """Letters, digits and ._- only."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}._-]", "")


def formatted_options(choices: Column) -> Column:
    """'a, b or c'; a single choice alone; empty for none."""
    most = F.array_join(F.slice(choices, 1, F.greatest(F.size(choices) - 1, F.lit(0))), ", ")
    return F.when(F.size(choices) > 1, F.concat(most, F.lit(" or "), F.element_at(choices, -1))).when(F.size(choices) == 1, choices[0]).otherwise("")


def filled(template: Column, value: Column) -> Column:
    """The template with {} replaced."""
    return F.replace(template, F.lit("{}"), value)


def listing(response: Column, choices: Column) -> Column:
    """Items of 'number choice' listings whose text is one of the (lower-case) choices: array of number and choice."""
    text = stripped(F.lower(response))
    numbers = F.regexp_extract_all(text, F.lit(LISTING), F.lit(1))
    items = F.regexp_extract_all(text, F.lit(LISTING), F.lit(2))
    low = F.transform(choices, lambda c: stripped(F.lower(c)))
    pairs = F.zip_with(numbers, items, lambda n, t: F.struct(F.try_to_number(n, F.lit("999999999")).cast("int").alias("number"), stripped(t).alias("choice")))
    return F.when(F.size(numbers) >= 2, F.filter(pairs, lambda p: F.array_contains(low, p["choice"]))).otherwise(F.filter(pairs, lambda p: F.lit(False)))


def is_listing(items: Column) -> Column:
    """Two or more items, numbered 1, 2, 3 and so on in order."""
    return (F.size(items) >= 2) & (F.transform(items, lambda p: p["number"]) == F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1))))


def nearest_choice(response: Column, choices: Column, least: float) -> Column:
    """The choice whose words are most like the response's (the first on ties); null if the similarity is below ``least``."""
    scored = let(tokens(response), lambda words: F.transform(choices, lambda c, i: F.struct(F.round(jaccard(words, tokens(c)), 9).alias("s"), (-i).alias("i"), c.alias("c"))))
    return let(F.array_max(scored), lambda best: F.when(best["s"] >= least, best["c"]))


def parsed(response: Column, choices: Column, compat: bool = True, similar: float | None = None) -> Column:
    """Struct of answer (null if invalid) and parse_type (exact_matching, ranked_listing, text_similarity, not_parsed).

    ``similar``: where nothing else fits, the choice with at least this similarity of words (off by default).

    A response counts as a choice if, cleaned, it equals one and holds no other; as a listing if it numbers several from 1 on,
    and then means the first.  ``compat``: choices keep their punctuation, no white space is cut and a listing gives the choice
    in lower case, as in the published evaluation; without it choices are cleaned like the response, which is trimmed, a choice
    that lies within the equal one doesn't spoil it, and a listing gives the choice as it is written."""
    text = cleaned(response) if compat else stripped(cleaned(response))
    low = F.transform(choices, F.lower) if compat else F.transform(choices, lambda c: stripped(cleaned(c)))
    place = F.array_position(low, text)
    present = F.filter(low, lambda c: F.contains(text, c))
    exact = (place > 0) & (F.size(present) == 1) if compat else place > 0
    items = listing(text, low)
    first = F.array_min(items)["choice"]
    named = first if compat else F.element_at(choices, F.nullif(F.array_position(low, first), F.lit(0)).cast("int"))
    result = lambda a, kind: F.struct(a.alias("answer"), F.lit(kind).alias("parse_type"))
    return (
        F.when(exact, result(F.element_at(choices, F.nullif(place, F.lit(0)).cast("int")), "exact_matching"))
        .when((F.size(present) > 1) & is_listing(items), result(named, "ranked_listing"))
        .otherwise(_unparsed(response, choices, similar))
    )


def _unparsed(response: Column, choices: Column, similar: float | None) -> Column:
    none = F.struct(F.lit(None).cast("string").alias("answer"), F.lit("not_parsed").alias("parse_type"))
    if similar is None:
        return none
    return let(nearest_choice(response, choices, similar), lambda c: F.when(c.isNotNull(), F.struct(c.alias("answer"), F.lit("text_similarity").alias("parse_type"))).otherwise(none))


def tokens(text: Column) -> Column:
    """Lower-case words between white space."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def without_stop_words(words: Column, stop: list[str]) -> Column:
    """Distinct words that aren't stop words, in order."""
    return F.array_except(words, F.array(*map(F.lit, stop)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")), F.lit(0.0))


def f_measure(shared: Column, in_prediction: Column, in_truth: Column) -> Column:
    """Struct of precision, recall and f1 with 0 for empty sides."""
    p = F.coalesce(F.try_divide(shared.cast("double"), in_prediction.cast("double")), F.lit(0.0))
    r = F.coalesce(F.try_divide(shared.cast("double"), in_truth.cast("double")), F.lit(0.0))
    return F.struct(p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


def token_f1_set(prediction: Column, truth: Column) -> Column:
    a, b = F.array_distinct(tokens(prediction)), F.array_distinct(tokens(truth))
    return f_measure(F.size(F.array_intersect(a, b)), F.size(a), F.size(b))


def count_of(a: Column, x: Column) -> Column:
    return F.size(a) - F.size(F.array_remove(a, x))


def shared_multiset(a: Column, b: Column) -> Column:
    """Elements that both arrays have, each as often as the smaller count."""
    return F.aggregate(F.transform(F.array_intersect(a, b), lambda x: F.least(count_of(a, x), count_of(b, x))), F.lit(0), lambda s, v: s + v)


def token_f1_multiset(prediction: Column, truth: Column) -> Column:
    return both(tokens(prediction), tokens(truth), lambda a, b: f_measure(shared_multiset(a, b), F.size(a), F.size(b)))


def char_ngrams(text: Column, n: int) -> Column:
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def char_jaccard(a: Column, b: Column, n: int = 3) -> Column:
    return jaccard(char_ngrams(F.lower(a), n), char_ngrams(F.lower(b), n))


def word_ngrams(words: Column, n: int) -> Column:
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))


def rouge_n(prediction: Column, truth: Column, n: int = 1) -> Column:
    grams = lambda t: let(tokens(t), lambda w: word_ngrams(w, n))
    return both(grams(prediction), grams(truth), lambda a, b: f_measure(shared_multiset(a, b), F.size(a), F.size(b)))


def _lengths(pairs) -> list[int]:
    """Longest common subsequences of pairs of word lists, a bit for each word of the second (Python's long integers)."""
    out = []
    for x, y in pairs:
        at: dict[str, int] = {}
        for i, w in enumerate(y):
            at[w] = at.get(w, 0) | 1 << i
        full = (1 << len(y)) - 1
        v = full
        for w in x:
            u = v & at.get(w, 0)
            v = (v + u | v - u) & full
        out.append(len(y) - v.bit_count())
    return out


def longest_common(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays; inherently sequential, so an Arrow-batched function."""

    @F.pandas_udf("int")
    def length(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(_lengths(zip(x, y, strict=True)))

    return length(a, b)


def rouge_l(prediction: Column, truth: Column) -> Column:
    a, b = tokens(prediction), tokens(truth)
    return f_measure(longest_common(a, b), F.size(a), F.size(b))


def tfidf_cosine(a: Column, b: Column) -> Column:
    """Cosine of the TF-IDF vectors of two texts, fitted on just the two: idf = ln(3 / (1 + df)) + 1; words of two or more letters."""
    words = lambda t: F.regexp_extract_all(F.lower(t), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    once, twice = F.log(F.lit(1.5)) + 1, F.lit(1.0)
    total = lambda arr, f: F.aggregate(F.transform(arr, f), F.lit(0.0), lambda s, v: s + v)

    def cosine(x: Column, y: Column) -> Column:
        def of(shared: Column) -> Column:
            weight = lambda w: F.when(F.array_contains(shared, w), twice).otherwise(once)
            square = lambda v: total(F.array_distinct(v), lambda w: F.pow(count_of(v, w) * weight(w), 2))
            product = total(shared, lambda w: count_of(x, w) * count_of(y, w) * F.lit(1.0))
            return F.coalesce(F.try_divide(product, F.sqrt(square(x)) * F.sqrt(square(y))), F.lit(0.0))

        return let(F.array_intersect(x, y), of)

    return both(words(a), words(b), cosine)


def day_period(timestamp_us: Column, zone: Column) -> Column:
    """Part of the day in local time of a moment given in microseconds since the epoch; the session's zone must be UTC."""
    hour = F.hour(F.from_utc_timestamp(F.timestamp_micros(timestamp_us), zone))
    out = F.lit(NIGHT)
    for lo, hi, name in DAY_PERIODS:
        out = F.when((hour >= lo) & (hour < hi), name).otherwise(out)
    return out


def title(text: Column) -> Column:
    return F.initcap(F.replace(text, F.lit("_"), F.lit(" ")))


def camera_display(name: Column) -> Column:
    return F.lower(F.replace(name, F.lit("_"), F.lit(" ")))


def decimals(value: Column, places: int) -> Column:
    """A number with so many decimals, halves away from zero, as 12.50; null stays null."""
    return F.when(value.isNotNull(), F.format_string(f"%.{places}f", value.cast("double")))


def grouped(value: Column) -> Column:
    """A whole number with its thousands apart, as 1,234,567."""
    return F.format_number(value.cast("long"), 0)

"""Quality rules with built-in functions only: fixed counts, and the divergence of histograms from language references.

Counts of words, signs, repeated lines and repeated 5-word windows are worked out within the row.  Windows are hashed, and
only where the distinct hashes are fewer than the windows are positions sorted by hash to see which ones repeat.

Divergence: a document's histogram of seven character classes (a-z, A-Z, 0-9, punctuation, other signs, white space, all others) and its
histogram of the language's commonest short words are compared with those of all documents of its language by the
Jensen-Shannon distance (base 2, 0 to 1).  Only texts with at least ``least_chars`` characters, and at least ``least_hits``
common words, are compared, and the limit is wider for short texts, whose histograms scatter.  References are sums over all
documents: one row for each language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settled

WORD = r"[^\x20\x09-\x0D]+"
SIGNS = r"[#*$%&|<>]"
#: Small letters and white space, most of a text, are taken out first: the other classes are counted in what is left.
COMMON_SIGNS = r"[a-z\x20\x09-\x0D]+"
CLASSES = {"capital": "[A-Z]+", "digit": "[0-9]+", "stop": r"[.,;:!?'\"()-]+", "sign": r"[#-&*+/<-@\[-`{-~]+"}
WINDOW = 5


def let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of 5 words which occurs twice or more."""
    n = F.size(words) - (WINDOW - 1)

    def met(a: Column, b: Column, k: int) -> Column:
        # each element of a with the one k places further on in b
        return F.zip_with(F.slice(a, F.lit(1), F.size(b) - k), F.slice(b, F.lit(k + 1), F.size(b) - k), lambda x, y: F.xxhash64(x, y))

    def windows(one: Column) -> Column:
        # hashes of 2, 4 and then 5 neighbouring words: three hashes of two numbers a window instead of one of five words
        return let(let(met(one, one, 1), lambda two: met(two, two, 2)), lambda four: met(four, one, 4))

    def positions(s: Column) -> Column:
        twin = lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])
        return F.sort_array(F.transform(F.filter(s, lambda x, i: F.coalesce(twin(x, i), F.lit(False))), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)).cast("long"))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, b: a + b)

    def of(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(let(pairs, positions), covered))

    # a word repeated through the text makes neighbours with the same hash in sorted order, whatever their number
    return F.when(n < 2, F.lit(0).cast("long")).otherwise(let(let(F.transform(words, lambda w: F.xxhash64(w)), windows), of))


def common_words(docs: DataFrame, top: int) -> dict[str, list[str]]:
    """The ``top`` commonest words of 1 to 4 letters of each language, counted over all documents; commonest first."""
    short = F.regexp_extract_all(F.lower("text"), F.lit(r"(?<![^\x20\x09-\x0D])\p{L}{1,4}(?![^\x20\x09-\x0D])"), F.lit(0))
    counts = docs.where("lang is not null and text is not null").select("lang", F.explode(short).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    # the first of each of 64 parts of a language's words, by which rows are dropped before they are shuffled, then the first of these
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("word"), F.lit(64))).orderBy(F.col("n").desc(), "word")
    first = counts.withColumn("r", F.row_number().over(part)).where(F.col("r") <= top)
    best = first.groupBy("lang").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "word"))), 1, top).alias("best"))
    return {r.lang: [x.word for x in r.best] for r in best.collect()}


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of counts; null if either is empty."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    shares = lambda a: F.transform(a, lambda v: v / F.nullif(total(a), F.lit(0.0)))
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    terms = F.zip_with(shares(p), shares(q), lambda x, y: (part(x, (x + y) / 2) + part(y, (x + y) / 2)) / 2)
    return F.sqrt(F.greatest(total(terms), F.lit(0.0)))


def measured(docs: DataFrame, common: dict[str, list[str]], top: int) -> DataFrame:
    """doc_id, lang, the fixed counts, and the two histograms as arrays of doubles."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    by_lang = lambda values, missing: F.coalesce(F.create_map(*[x for lang, v in values.items() for x in (F.lit(lang), v)])[F.col("lang")], missing) if values else missing
    table = by_lang({lang: F.array(*map(F.lit, w)) for lang, w in common.items()}, F.array().cast("array<string>"))
    # the commonest words are letters only, so they are patterns as they stand; (?!) matches nothing
    pattern = by_lang({lang: F.lit(r"(?<![^\x20\x09-\x0D])(?:" + "|".join(w) + r")(?![^\x20\x09-\x0D])") for lang, w in common.items() if w}, F.lit("(?!)"))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    base = docs.select(
        "doc_id",
        "lang",
        text.alias("text"),
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"),
        F.regexp_replace(text, COMMON_SIGNS, "").alias("rest"),
        table.alias("common"),
        F.regexp_extract_all(F.lower(text), pattern, F.lit(0)).alias("hits"),
    )
    counted = base.select(
        "doc_id",
        "lang",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SIGNS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.length("text").cast("double").alias("n_chars"),
        F.length("rest").cast("double").alias("n_rest"),
        *[(F.length("rest") - F.length(F.regexp_replace("rest", p, ""))).cast("double").alias(k) for k, p in CLASSES.items()],
        F.transform("common", lambda c: (F.size("hits") - F.size(F.array_remove("hits", c))).cast("double")).alias("word_hist"),
    )
    space = F.col("n_chars") - F.col("word_chars")
    small = F.col("word_chars") - F.col("n_rest")
    other = F.col("n_rest") - sum((F.col(k) for k in CLASSES), F.lit(0.0))
    return counted.withColumn("class_hist", F.array(small, *CLASSES, space, other)).drop("n_rest", *CLASSES)


def assessed(docs: DataFrame, top: int = 24, least_chars: int = 200, least_hits: int = 30, class_limit: float = 0.2, word_limit: float = 0.45) -> DataFrame:
    """For each row of docs (doc_id, text, lang; further columns are ignored): doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed (n_words < 10, or 100 * n_repeat_words > 20 * n_words), kept, class_distance and
    word_distance.

    kept is false if base_failed or a distance lies above its limit plus 2 / sqrt(characters or hits).  A null text counts as empty.
    Documents of a null language, whose reference is missing, and short texts are judged by the base rules alone; their
    distances are null.  Texts of any length are measured whole; repeated rows get the same result and count as often as they are
    there.  Languages are few: the driver gets a row for each.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    found = settled(measured(docs, common_words(docs, top), top))
    sums = lambda c, n: F.array(*[F.sum(F.get(F.col(c), F.lit(i))) for i in range(n)])
    # one row for each language
    references = {r.lang: r for r in found.where("lang is not null").groupBy("lang").agg(sums("class_hist", len(CLASSES) + 3).alias("classes"), sums("word_hist", top).alias("words")).collect()}
    literal = lambda key, n: F.create_map(*[x for lang, r in references.items() for x in (F.lit(lang), F.array(*[F.lit(float(v or 0.0)) for v in r[key][:n]]))])[F.col("lang")] if references else F.lit(None).cast("array<double>")
    hits = F.aggregate("word_hist", F.lit(0.0), lambda s, v: s + v)
    judged = found.select(
        "*",
        F.when(F.col("n_chars") >= least_chars, js_distance(F.col("class_hist"), literal("classes", 99))).alias("class_distance"),
        F.when(hits >= least_hits, js_distance(F.col("word_hist"), F.slice(literal("words", top), F.lit(1), F.size("word_hist")))).alias("word_distance"),
        hits.alias("hits"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    far = (F.col("class_distance") > class_limit + 2 / F.sqrt("n_chars")) | (F.col("word_distance") > word_limit + 2 / F.sqrt(F.greatest("hits", F.lit(1.0))))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & ~F.coalesce(far, F.lit(False))).alias("kept"), "class_distance", "word_distance",
    )

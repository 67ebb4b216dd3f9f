"""Secret scans with built-in functions only: fixed patterns, and a battery of randomness tests for what they miss.

*Patterns* (assign, access, hex) give spans by their rules.  Positions come from the lengths of the pieces between matches and
of the matches themselves, so no text is walked in Python and none is shuffled.

*Battery*: runs of 20 or more characters of the base-64 alphabets that hold a letter and lie in no pattern's span.
The encoding is inferred from the characters: hex, base 32, base 36 in one case, else base 64 (16, 32, 36, 64 signs).  Dashes and
other marks carry nothing in hex and in one case (a random base-64 token of 20 signs lacks a case once in 30,000).  Three tests
ask whether the signs can be independent and uniform: chi-squared over as many classes of neighbouring signs as the length fills
with 5 or more each, a runs test about the middle of the alphabet, and the lag-1 serial correlation; normal approximations give
two-sided p-values, and three times the least one is the token's.  Lower-case base 32 and base 36 have their signs in the order
of use in words, which is as good as any other for random tokens but puts words at one end; a fourth test, of the mean, finds them, and a
fifth one is the serial correlation in the alphabet's own order.

*Discoveries*.  A secret is what is told apart from structure, so structure is the null hypothesis: words, numbers and marks strung
together, as a Markov chain over the classes of characters (small, capital, digit, mark) in which letters have the frequencies of
words.  The likelihood of the token as uniform signs of its encoding, over that under the chain and over the number of encodings to
infer from, is an e-value: under the chain its mean is at most 1.  It is 0 where the battery denies that the signs are uniform
(below ``uniform``).  Each is weighted by the token's length over the mean length of all tokens, as long tokens have the power to
be told apart.  Over all tokens of the whole table, the step-up procedure on e-values takes the largest set of k tokens with
e >= tokens / (rate * k) each; whatever the dependence between tokens, at most ``rate`` of the discoveries are structured ones in
the mean, as far as the chain describes these.  They are added as spans of the kind ``random``.  One pass counts the tokens by
e-value and length (both in classes: a bounded table for the driver), a second one scans with the limit.
Identifiers drawn at random, as UUIDs of version 4, can't be told from secrets by their signs and are spans, too.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of the base scan.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # of AKIA[A-Z0-9]+ the matches of 18 or more characters
HEX = r"[0-9a-f]{16,}"  # of [0-9a-f]+ the matches of 16 or more characters
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")
SIGNS = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "lower32": "etaoinsrhldcumfpgwybvkxjqz234567", "base36": "etaoinsrhldcumfpgwybvkxjqz0123456789"}
#: Alphabets in the order of use in words.
BY_USE = ("lower32", "base36")
PLAIN = "abcdefghijklmnopqrstuvwxyz0123456789"
BLOCK = 128
#: The chain of structure: chances of the next class (L small, U capital, D digit, M mark) after each one; ^ stands for the start.
CHAIN = {
    "^": {"L": 0.5, "U": 0.3, "D": 0.15, "M": 0.05},
    "L": {"L": 0.8, "U": 0.08, "D": 0.06, "M": 0.06},
    "U": {"L": 0.55, "U": 0.35, "D": 0.05, "M": 0.05},
    "D": {"L": 0.1, "U": 0.1, "D": 0.65, "M": 0.15},
    "M": {"L": 0.4, "U": 0.3, "D": 0.25, "M": 0.05},
}
#: A letter is less frequent than the one before it in the order of use by this factor.
FADE = 0.87
#: Classes of the table of tokens: powers of two of the e-value, and lengths in steps of 4.
LEAST, MOST, LENGTHS = -8, 160, 64


def bound_to(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.transform(F.array(value), body)[0]


def span(start: Column, rank: int, end: Column) -> Column:
    return F.struct(start.cast("long").alias("start"), F.lit(rank).alias("rank"), end.cast("long").alias("end"))


SPANS = "array<struct<start:bigint,rank:int,end:bigint>>"


def folded(items: Column, state: Column, none: Column, step, prepare=None) -> Column:
    """step(state, item, prepared) -> (what to append, next state), over an array; the appended values.

    They are built block by block, so an array of very many items stays far from quadratic.  prepare(block, state) is worked out
    once for each block."""
    blocks = bound_to(items, lambda a: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / BLOCK).cast("int")), lambda b: F.slice(a, b * BLOCK + 1, F.lit(BLOCK))))

    def of_block(acc: Column, block: Column) -> Column:
        def walk(ready: Column) -> Column:
            def one(x: Column, v: Column) -> Column:
                made, following = step(x["at"], v, ready)
                return F.struct(F.array_append(x["out"], made).alias("out"), following.alias("at"))

            return F.aggregate(block, F.struct(none.alias("out"), acc["at"].alias("at")), one, lambda x: F.struct(F.concat(acc["out"], x["out"]).alias("out"), x["at"].alias("at")))

        return bound_to(prepare(block, acc["at"]) if prepare else F.lit(0), walk)

    return F.aggregate(blocks, F.struct(none.alias("out"), state.alias("at")), of_block, lambda acc: acc["out"])


def located(text: Column, pattern: str, rank: int, keep: Column | None = None) -> Column:
    """Spans of all matches of a pattern.  ``keep``: a condition for each match, as an array."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    sizes = F.zip_with(pieces, matches, lambda p, m: F.struct(F.length(p).cast("long").alias("gap"), F.length(m).cast("long").alias("size")))
    steps = F.filter(sizes, lambda x: x["size"].isNotNull())
    none = F.array().cast(SPANS)
    whole = folded(steps, F.lit(0).cast("long"), none, lambda at, v, _: (span(at + v["gap"], rank, at + v["gap"] + v["size"]), at + v["gap"] + v["size"]))
    if keep is not None:
        whole = bound_to(F.arrays_zip(whole.alias("s"), keep.alias("k")), lambda a: F.transform(F.filter(a, lambda x: x["k"]), lambda x: x["s"]))
    return F.when(text.rlike(pattern), whole).otherwise(none)


def normal_tail(z: Column) -> Column:
    """Two-sided p-value of a normal deviate (a rational approximation, error below 1e-7)."""

    def tail(x: Column) -> Column:
        poly = lambda t: t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
        return F.least(F.lit(1.0), 2 * 0.3989422804014327 * F.exp(-x * x / 2) * bound_to(1 / (1 + 0.2316419 * x), poly))

    # the deviate is a long expression: it is written down once
    return bound_to(F.abs(z), tail)


def encoded(token: Column) -> Column:
    """The token's inferred encoding: its signs t and the alphabet."""
    plain, bare = F.translate(token, "-_=", "+/"), F.translate(token, "+/_=-", "")
    as_kind = lambda t, kind: F.struct(t.alias("t"), F.lit(SIGNS[kind]).alias("signs"))
    return (
        F.when(bare.rlike("^[0-9A-Fa-f]+$"), as_kind(F.lower(bare), "hex"))
        .when(token.rlike("^[A-Z2-7]+=*$"), as_kind(plain, "base32"))
        .when(bare.rlike("^([a-z2-7]+|[A-Z2-7]+)$"), as_kind(F.lower(bare), "lower32"))
        .when(bare.rlike("^([a-z0-9]+|[A-Z0-9]+)$"), as_kind(F.lower(bare), "base36"))
        .otherwise(as_kind(plain, "base64"))
    )


def p_value(kind: Column) -> Column:
    """The number of tests times the least p-value of the tests of an encoded token: three, and two more in the order of use."""

    def tested(k: Column) -> Column:
        m = F.length(k["signs"]).cast("double")
        place = lambda signs: F.transform(F.filter(F.split(k["t"], ""), lambda c: c != ""), lambda c: (F.position(c, signs) - 1).cast("double"))
        return bound_to(F.struct(place(k["signs"]).alias("x"), place(F.lit(PLAIN)).alias("y")), lambda c: combined(c["x"], c["y"], m, k["signs"].isin(*[SIGNS[b] for b in BY_USE])))

    def combined(x: Column, y: Column, m: Column, by_use: Column) -> Column:
        n = F.size(x).cast("double")
        total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
        classes = F.when(n >= 5 * m, m).when(n >= 160, F.lit(32.0)).when(n >= 80, F.lit(16.0)).when(n >= 40, F.lit(8.0)).otherwise(F.lit(4.0))
        classes = F.least(classes, m)

        def chi(c: Column) -> Column:
            squares = total(F.transform(F.sequence(F.lit(0), c.cast("int") - 1), lambda b: F.pow(F.size(F.filter(x, lambda v: F.floor(v * c / m) == b)).cast("double"), 2)))
            chi2, df = squares * c / n - n, c - 1
            return (F.pow(F.greatest(chi2, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))

        def runs(bits: Column) -> Column:
            high = total(bits)
            changes = total(F.transform(F.sequence(F.lit(1), F.size(bits) - 1), lambda i: F.abs(bits[i] - bits[i - 1])))
            mean = 2 * high * (n - high) / n + 1
            spread = F.sqrt(F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(1e-9)))
            return F.when((high == 0) | (high == n), F.lit(40.0)).otherwise((changes + 1 - mean) / spread)

        def serial(x: Column, mean: Column) -> Column:
            var = total(F.transform(x, lambda v: (v - mean) * (v - mean)))
            cov = total(F.transform(F.sequence(F.lit(1), F.size(x) - 1), lambda i: (x[i] - mean) * (x[i - 1] - mean)))
            return F.when(var <= 0, F.lit(40.0)).otherwise((cov / var + 1 / n) * F.sqrt(n))

        # only too uneven counts speak against uniform signs
        one = normal_tail(F.greatest(bound_to(classes, chi), F.lit(0.0)))
        two = normal_tail(bound_to(F.transform(x, lambda v: F.when(v >= m / 2, 1.0).otherwise(0.0)), runs))
        three = normal_tail(bound_to(total(x) / n, lambda mean: serial(x, mean)))
        four = normal_tail((total(x) / n - (m - 1) / 2) / F.sqrt((m * m - 1) / (12 * n)))
        five = normal_tail(bound_to(total(y) / n, lambda mean: serial(y, mean)))
        return F.least(F.lit(1.0), F.when(by_use, 5 * F.least(one, two, three, four, five)).otherwise(3 * F.least(one, two, three)))

    return tested(kind)


def chain_costs() -> dict[str, float]:
    """-log2 of the chain's chance of a character after a class: keys of the class before, the class, and the small letter if it is one."""
    fade = (1 - FADE) / (1 - FADE**26)
    letters = {c: -log2(fade * FADE**i) for i, c in enumerate(SIGNS["base36"][:26])}
    out = {}
    for before, nexts in CHAIN.items():
        for kind, p in nexts.items():
            if kind in "LU":
                out |= {f"{before}{kind}{c}": -log2(p) + x for c, x in letters.items()}
            else:
                out[f"{before}{kind}"] = -log2(p) + log2(10 if kind == "D" else 2)
    return out


def evidence(kind: Column) -> Column:
    """log2 of the e-value of an encoded token against structure."""
    letters = SIGNS["base36"][:26]
    costs = F.create_map(*[F.lit(x) for pair in chain_costs().items() for x in pair])
    signs = letters + letters.upper() + "0123456789+/"

    def of(k: Column) -> Column:
        kinds = F.concat(F.lit("^"), F.translate(k["t"], signs, "L" * 26 + "U" * 26 + "D" * 10 + "MM"))
        # the letter itself, or nothing for digits and marks
        low = F.lower(F.translate(k["t"], "0123456789+/", " " * 12))
        return bound_to(F.struct(kinds.alias("kinds"), low.alias("low")), lambda x: summed(k, x))

    def summed(k: Column, x: Column) -> Column:
        n = F.length(k["t"])
        each = F.transform(F.sequence(F.lit(1), n), lambda i: costs[F.concat(F.substring(x["kinds"], i, F.lit(2)), F.trim(F.substring(x["low"], i, F.lit(1))))])
        return F.aggregate(each, F.lit(0.0), lambda a, v: a + v) - n * F.log2(F.length(k["signs"])) - log2(len(SIGNS))

    return bound_to(kind, of)


TOKENS = "array<struct<s:struct<start:bigint,rank:int,end:bigint>,n:bigint,e:double>>"


def weighed(text: Column, found: Column, uniform: float) -> Column:
    """Tokens that overlap none of the spans found: span, length, log2 of the e-value (null where the battery denies uniform signs)."""
    lettered = lambda t: t.rlike("[A-Za-z]")
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    free = F.filter(
        F.zip_with(located(text, TOKEN, 3), tokens, lambda s, t: F.struct(s.alias("s"), t.alias("t"))),
        lambda x: lettered(x["t"]) & ~F.exists(found, lambda b: (b["start"] < x["s"]["end"]) & (x["s"]["start"] < b["end"])),
    )

    def one(x: Column) -> Column:
        # the battery is asked only where there is evidence
        allowed = lambda k: bound_to(evidence(k), lambda e: F.when(e <= LEAST, e).when(p_value(k) >= uniform, e))
        return F.struct(x["s"].alias("s"), F.length(x["t"]).cast("long").alias("n"), bound_to(encoded(x["t"]), allowed).alias("e"))

    return F.when(text.rlike(TOKEN), F.transform(free, one)).otherwise(F.array().cast(TOKENS))


def limit_of(classes: Iterable[tuple[int | None, int, int]], rate: float) -> tuple[float, float]:
    """The least weighted log2 e-value that is a discovery, and the mean length, of (log2 e rounded down, length, tokens)."""
    rows = [(e, n, k) for e, n, k in classes if k]
    tokens = sum(k for *_, k in rows)
    if not tokens:
        return float("inf"), 1.0
    mean = sum(n * k for _, n, k in rows) / tokens
    taken, limit = 0, float("inf")
    for e, k in sorted(((e + log2(n / mean), k) for e, n, k in rows if e is not None), reverse=True):
        taken += k
        if e >= log2(tokens / (rate * taken)):
            limit = log2(tokens / (rate * taken))
    return limit, mean


def fresh(df: DataFrame, n: int) -> list[str]:
    """Names that no column of df has."""
    taken = {c.lower() for c in df.columns}
    return [x for x in (f"_secrets_{i}" for i in range(n + len(taken))) if x not in taken][:n]


def based(docs: DataFrame, into: str) -> DataFrame:
    """docs with a column of the base spans: by kind and all together."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    long_enough = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= 12)
    parts = [located(text, ASSIGN, 0, long_enough), located(text, ACCESS, 1), located(text, HEX, 2)]
    names = fresh(docs.withColumn(into, F.lit(0)), 3)
    found = docs.withColumns(dict(zip(names, parts, strict=True)))
    every = F.array_sort(reduce(lambda a, b: F.concat(a, b), map(F.col, names)))
    return found.withColumn(into, F.struct(*[F.size(c).cast("long").alias(f"n_{k}") for c, k in zip(names, KINDS, strict=False)], every.alias("base"))).drop(*names)


def scanned(docs: DataFrame, into: str, rate: float, uniform: float) -> DataFrame:
    """docs with a column (a struct) of n_assign, n_access, n_hex, base and all spans; two passes over the texts."""
    name, tokens = fresh(docs.withColumn(into, F.lit(0)), 2)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # the e-value and the length in classes: at most some ten thousand rows
    slim = based(docs.select("text"), name).select(F.explode(weighed(text, F.col(name)["base"], uniform)).alias("t"))
    rows = slim.select(F.floor(F.least(F.greatest(F.col("t.e"), F.lit(float(LEAST))), F.lit(float(MOST)))).cast("int").alias("e"), F.least(F.ceil(F.col("t.n") / 4), F.lit(LENGTHS)).cast("int").alias("n"))
    limit, mean = limit_of([(r.e, r.n, r.k) for r in rows.groupBy("e", "n").agg(F.count("*").alias("k")).collect()], rate)
    found = based(docs, name).withColumn(tokens, weighed(text, F.col(name)["base"], uniform))
    weight = lambda x: F.log2(F.least(F.ceil(x["n"] / 4), F.lit(LENGTHS)) / mean)
    # e-values in the lowest class are no discoveries, whatever the limit
    hit = lambda x: F.coalesce((x["e"] > LEAST) & (x["e"] + weight(x) >= limit), F.lit(False))
    random = F.transform(F.filter(tokens, hit), lambda x: x["s"])
    fields = [F.col(name)[c].alias(c) for c in (*[f"n_{k}" for k in KINDS[:3]], "base")]
    return found.withColumn(into, F.struct(*fields, F.array_sort(F.concat(F.col(name)["base"], random)).alias("all"))).drop(name, tokens)


def joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat(names[s["rank"]], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, rate: float = 0.05, uniform: float = 0.001) -> DataFrame:
    """docs with n_assign, n_access, n_hex, base_spans and all_spans (arrays of start, rank of the kind, end; in code points,
    end exclusive, by start and kind).  A null text is an empty one: no spans.  Other columns stay as they are; columns of
    these names are replaced.  Repeated rows get the same result and count as often as they are there.  Texts of any length are
    scanned whole; a token's limit depends on the whole table."""
    (into,) = fresh(docs, 1)
    names = {f"n_{k}": f"n_{k}" for k in KINDS[:3]} | {"base_spans": "base", "all_spans": "all"}
    return scanned(docs, into, rate, uniform).withColumns({n: F.col(into)[c] for n, c in names.items()}).drop(into)


def report(docs: DataFrame, rate: float = 0.05, uniform: float = 0.001) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of each row, as ``scan`` finds them."""
    found = scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rate, uniform)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined(F.col("base_spans")), 256).alias("base_sha256"), joined(F.col("all_spans")).alias("spans"))


def redacted(docs: DataFrame, mask: str = "[secret]", rate: float = 0.05, uniform: float = 0.001) -> DataFrame:
    """docs with every span of ``scan`` replaced by ``mask`` (overlapping spans by one) and n_chars, if there, adjusted.  All other
    columns stay as they are, whatever their names.  A null text stays null."""
    text = F.col("text")
    (into,) = fresh(docs, 1)
    spans = F.col(into)["all"]
    furthest = lambda block, at: F.greatest(at, F.array_max(F.transform(block, lambda x: x["end"])))
    part = lambda t, begin, end: F.substring(t, (begin + 1).cast("int"), F.greatest(end - begin, F.lit(0)).cast("int"))

    def ready(block: Column, at: Column) -> Column:
        # the stretch of the text that a block of spans lies in, cut out once
        return F.struct(at.alias("base"), part(text, at, furthest(block, at)).alias("t"))

    def step(at: Column, s: Column, stretch: Column) -> tuple[Column, Column]:
        piece = F.when(s["start"] >= at, F.concat(part(stretch["t"], at - stretch["base"], s["start"] - stretch["base"]), F.lit(mask))).otherwise(F.lit(""))
        return piece, F.greatest(at, s["end"])

    def cut() -> Column:
        pieces = folded(spans, F.lit(0).cast("long"), F.array().cast("array<string>"), step, ready)
        last = F.array_max(F.transform(spans, lambda x: x["end"]))
        return F.concat(F.array_join(pieces, ""), F.substring(text, (last + 1).cast("int"), F.length(text)))

    changed = scanned(docs, into, rate, uniform).withColumn("text", F.when(F.size(spans) > 0, cut()).otherwise(text))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return changed.select(*docs.columns)

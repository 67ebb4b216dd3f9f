"""Language identification by interpolated Kneser-Ney character models, one for each language, in sorted hash arrays.

Texts become lower-case letters with one blank between words, padded by three blanks in front and one behind.  A model of
order 4 holds, sorted by the packed characters, the discounted share of each 1- to 4-gram and the weight that each context
leaves to the next shorter one.  The 4-grams of all languages also stand in one sorted array with their log probabilities, so
scoring a chunk means to look up its distinct 4-grams in that array, work out the few others by backing off, and average by
document.  The language of the lowest cross-entropy per character wins.  A result is ``rejected`` if its cross-entropy lies
above what 99.5 % of the language's calibration documents have, plus a margin for short texts.

Models are fitted to a sample of about ``per_language`` documents of each language (by a 64-bit hash of doc_id and text; every fourth
calibrates where these are enough for a limit, else all are learnt from).  Rows that repeat a document count once.
4-grams are counted in tasks, then summed; the driver gets one number for each language and distinct 4-gram of the sample.
Languages are few: each one has a model in every task, and a row of counts on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import LETTER, classes
from .bytesnum import Texts, U, batches
from .common import bounded_batches, held_out, settled

CHUNK = 1 << 20
BLANK = 32
#: Calibration documents that a language's limit needs.
LEAST = 20


@lru_cache(1)
def lower_letters() -> np.ndarray:
    """Code point -> lower-case letter in 16 bits, 0 for what isn't a letter."""
    kind = classes()
    out = np.zeros(len(kind), np.uint16)
    for i in np.flatnonzero(kind == LETTER).tolist():
        low = chr(i).lower()
        out[i] = (ord(low) if len(low) == 1 else i) & 0xFFFF or 1
    return out


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed 4-grams (four times 16 bits) of all rows with a letter, and the row of each."""
    n = len(offsets) - 1
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    if not len(lead):
        return np.zeros(0, U), np.zeros(0, np.int64)
    x = lower_letters()[np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)]
    row = np.repeat(np.arange(n), np.diff(np.searchsorted(lead, offsets)))
    after = np.zeros(len(x), bool)  # the first of several others after a letter of the same row
    after[1:] = (x[1:] == 0) & (x[:-1] > 0) & (row[1:] == row[:-1])
    keep = np.flatnonzero((x > 0) | after)
    kept, row = np.where(x[keep] > 0, x[keep], BLANK).astype(U), row[keep]
    count = np.bincount(row, minlength=n)
    size = np.where(count > 0, count + 4, 0)
    begin = np.cumsum(size) - size
    seq = np.full(int(size.sum()), BLANK, U)
    seq[begin[row] + 3 + np.arange(len(row)) - (np.cumsum(count) - count)[row]] = kept
    if len(seq) < 4:
        return np.zeros(0, U), np.zeros(0, np.int64)
    packed = seq[:-3] << U(48) | seq[1:-2] << U(32) | seq[2:-1] << U(16) | seq[3:]
    of = np.repeat(np.arange(n), size)
    whole = of[:-3] == of[3:]
    return packed[whole], of[:-3][whole]


def lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float) -> np.ndarray:
    """Values of the wanted keys in a sorted array."""
    if not len(keys):
        return np.full(len(wanted), default)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], default)


@dataclass
class KneserNey:
    """``shares[k]``: sorted k-grams and their discounted shares; ``rest[k]``: sorted contexts and what they leave over."""

    shares: dict[int, tuple[np.ndarray, np.ndarray]]
    rest: dict[int, tuple[np.ndarray, np.ndarray]]
    floor: float

    @staticmethod
    def of(codes: np.ndarray, counts: np.ndarray) -> KneserNey:
        shares, rest = {}, {}
        order = np.argsort(codes)
        codes, counts = codes[order], counts[order].astype(float)
        for k in (4, 3, 2, 1):
            ones, twos = (counts == 1).sum(), (counts == 2).sum()
            d = ones / (ones + 2 * twos) if ones and twos else 0.5
            context, inverse = np.unique(codes >> U(16), return_inverse=True)
            total = np.bincount(inverse, counts)
            shares[k] = codes, np.maximum(counts - d, 0) / total[inverse]
            rest[k] = context, np.bincount(inverse, np.minimum(counts, d)) / total
            # lower orders count distinct continuations to the left
            codes, counts = np.unique(codes & U((1 << 16 * (k - 1)) - 1), return_counts=True)
            counts = counts.astype(float)
        return KneserNey(shares, rest, 1 / (len(shares[1][0]) + 1))

    def log_prob(self, packed: np.ndarray) -> np.ndarray:
        p = np.full(len(packed), self.floor)
        for k in (1, 2, 3, 4):
            gram = packed & U((1 << 16 * k) - 1) if k < 4 else packed
            p = lookup(*self.shares[k], gram, 0.0) + lookup(*self.rest[k], gram >> U(16), 1.0) * p
        return np.log(p)


@dataclass
class Model:
    languages: list[str]
    each: list[KneserNey]
    known: np.ndarray = field(default_factory=lambda: np.zeros(0, U))
    logs: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    limits: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def entropies(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character of each row under each language, and the number of characters."""
        packed, row = grams(data, offsets)
        n = len(offsets) - 1
        count = np.bincount(row, minlength=n)
        out = np.zeros((n, len(self.languages)))
        if len(packed):
            code, distinct = pd.factorize(packed)
            at = np.minimum(np.searchsorted(self.known, distinct), len(self.known) - 1)
            logs = self.logs[at]
            other = np.flatnonzero(self.known[at] != distinct)
            for k, model in enumerate(self.each):
                logs[other, k] = model.log_prob(distinct[other])
            for k in range(len(self.languages)):
                out[:, k] = -np.bincount(row, logs[code, k], n) / np.maximum(count, 1)
        return out, count


COUNTS = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])
CALIBRATION = pa.schema([("lang", pa.string()), ("entropy", pa.float64()), ("n", pa.int64())])


def bounds(sizes: dict[str, int], per_language: int) -> dict[str, int]:
    """The signed 64-bit number below which a hash puts a document into its language's sample: the share per_language / size of the
    whole range, never none of it, or all of it."""
    whole = 1 << 64
    return {lang: min(whole, max(1, whole * per_language // n)) - (1 << 63) for lang, n in sizes.items()}


def fit(docs: DataFrame, per_language: int = 1500) -> Model:
    """Model from text and non-null lang of documents that aren't held out.  A language whose sample has no letter isn't learnt."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null").where(~held_out(F.col("doc_id")))
    hashed = known.withColumn("h", F.xxhash64("doc_id", "text"))
    # of different documents, as rows that repeat one are one in the sample
    sizes = {r.lang: max(1, r.n) for r in hashed.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}
    if not sizes:
        return Model([], [])
    least = bounds(sizes, per_language)
    most = (1 << 63) - 1
    bound = F.create_map(*[x for lang, n in least.items() for x in (F.lit(lang), F.lit(min(n, most)))])
    whole = F.col("lang").isin([lang for lang, n in least.items() if n > most])
    chosen = hashed.where(whole | (F.col("h") < bound[F.col("lang")])).groupBy("lang", "h").agg(F.any_value("doc_id").alias("doc_id"), F.any_value("text").alias("text"))
    # about per_language texts of each language, which are read four times
    sample = settled(chosen.withColumn("calibrates", F.pmod(F.xxhash64("h", F.lit(1)), F.lit(4)) == 0).drop("h"))
    if missing := set(sizes) - {r.lang for r in sample.select("lang").distinct().collect()}:
        raise RuntimeError(f"no document was drawn of {sorted(missing)}")
    # a language without enough documents for a limit, or to learn from beside them, sets none aside
    enough = F.count_if("calibrates") >= LEAST
    apart = [r.lang for r in sample.where(F.col("text").rlike(r"\p{L}")).groupBy("lang").agg((enough & (F.count_if(~F.col("calibrates")) > 0)).alias("apart")).where("apart").collect()]
    sample = sample.withColumn("calibrates", F.col("calibrates") & F.col("lang").isin(apart))

    def count(batch):
        texts, langs = Texts(batch.column("text")), np.array(batch.column("lang").to_pylist(), object)
        for i, j, data, offsets in texts.chunks(CHUNK):
            packed, row = grams(data, offsets)
            of = langs[i:j]
            for lang in set(of.tolist()):
                code, n = np.unique(packed[(of == lang)[row]], return_counts=True)
                yield [[lang] * len(code), code.view(np.int64), n]

    rows = (
        sample.where("not calibrates")
        .select("lang", "text")
        .mapInArrow(lambda it: batches(it, COUNTS, count), "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    languages = sorted(lang for lang in sizes if (rows.lang == lang).any())
    if not languages:
        return Model([], [])
    each = []
    for lang in languages:
        mine = rows[rows.lang == lang]
        each.append(KneserNey.of(mine.gram.to_numpy().view(U), mine.n.to_numpy()))
    known_grams = np.unique(rows.gram.to_numpy().view(U))
    model = Model(languages, each, known_grams, np.stack([m.log_prob(known_grams) for m in each], 1), np.full(len(languages), np.inf))

    def calibrate(batch):
        texts, langs = Texts(batch.column("text")), batch.column("lang").to_pylist()
        place = {lang: k for k, lang in enumerate(languages)}
        for i, j, data, offsets in texts.chunks(CHUNK):
            entropy, n = model.entropies(data, offsets)
            use = [r for r in range(j - i) if langs[i + r] in place and n[r]]
            yield [[langs[i + r] for r in use], [float(entropy[r, place[langs[i + r]]]) for r in use], [int(n[r]) for r in use]]

    held = sample.where("calibrates").select("lang", "text").mapInArrow(lambda it: batches(it, CALIBRATION, calibrate), "lang string, entropy double, n long").toPandas()
    for k, lang in enumerate(languages):
        mine = held[(held.lang == lang) & (held.n >= 40)].entropy
        model.limits[k] = np.quantile(mine, 0.995) + 0.1 if len(mine) >= LEAST else np.inf
    return model


PREDICTED = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("entropy", pa.float64()), ("rejected", pa.bool_())])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """For each row of docs (doc_id, text; further columns are ignored): doc_id, held_out, lang_pred ('und' for a null text,
    one without letters, or without a model), score (share of the language among the likelihoods, per character, of all;
    0 for 'und'), entropy and rejected.  Repeated rows get the same result; a long text is scored whole, with memory for it."""

    def one(batch):
        texts = Texts(batch.column("text"))
        names = [*model.languages, "und"]
        for i, j, data, offsets in texts.chunks(CHUNK):
            if not model.languages:
                yield [batch.column("doc_id").slice(i, j - i), ["und"] * (j - i), np.zeros(j - i), np.zeros(j - i), np.zeros(j - i, bool)]
                continue
            entropy, n = model.entropies(data, offsets)
            best = entropy.argmin(1)
            low = entropy[np.arange(j - i), best]
            weight = np.minimum(n, 50)[:, None]
            share = 1 / np.exp(-np.minimum(50, (entropy - low[:, None]) * weight)).sum(1)
            some = n > 0
            limit = model.limits[best] + 4 / np.sqrt(np.maximum(n, 1))
            yield [batch.column("doc_id").slice(i, j - i), [names[b] for b in np.where(some, best, len(names) - 1)], np.where(some, share, 0.0), np.where(some, low, 0.0), some & (low > limit)]

    return (
        bounded_batches(docs)
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .mapInArrow(lambda it: batches(it, PREDICTED, one), "doc_id long, lang_pred string, score double, entropy double, rejected boolean")
        .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "entropy", "rejected")
    )


def identify(docs: DataFrame, per_language: int = 1500) -> DataFrame:
    """``predict`` with a model fitted to the same table's texts and languages."""
    bounded_batches(docs)
    return predict(docs, fit(docs, per_language))

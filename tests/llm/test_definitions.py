"""Quality rules and graded quality against their definitions, worked out one text at a time."""

import collections
import math
import re

import numpy as np
from pyspark.sql import functions as F

from lanewise.llm import quality, rules
from lanewise.llm.bytesnum import U, mix, prefix, spans

from . import fixtures

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SHORT = re.compile(r"(?<![^\x20\x09-\x0D])[^\W\d_]{1,4}(?![^\x20\x09-\x0D])")
CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:!?'\"()-", "#$%&*+/<=>?@[\\]^_`{|}~"]


def distance(p, q):
    """Jensen-Shannon, base 2."""
    if not sum(p) or not sum(q):
        return None
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    kl = lambda a, m: sum(x * math.log2(x / y) for x, y in zip(a, m, strict=True) if x > 0)
    m = [(x + y) / 2 for x, y in zip(p, q, strict=True)]
    return math.sqrt(max((kl(p, m) + kl(q, m)) / 2, 0))


def test_rules_by_definition(spark, small):
    docs = fixtures.documents(spark, small)
    junk = [(20_000 + i, t, "en", "s", 0) for i, t in enumerate(["%$#@!" * 60 + " " + "the of and a " * 20, "QQQQ " * 30 + "x7 " * 90, "a b c d " * 40])]
    docs = docs.union(spark.createDataFrame(junk, docs.schema))
    rows = [(r.doc_id, r.text or "", r.lang) for r in docs.collect()]
    counts = collections.defaultdict(collections.Counter)
    for _, text, lang in rows:
        if lang is not None:
            counts[lang].update(SHORT.findall(text.lower()))
    common = {lang: [w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:24]] for lang, c in counts.items()}
    figures = []
    for i, text, lang in rows:
        words = WORD.findall(text)
        n = collections.Counter(text)
        classes = [sum(n[c] for c in each) for each in CLASSES]
        letters = sum(map(len, words))
        classes += [len(text) - letters, letters - sum(classes)]
        hits = collections.Counter(w.lower() for w in words if len(w) <= 4)
        figures.append((i, lang, text, words, classes, [hits[w] for w in common.get(lang, [])]))
    total = {lang: ([sum(x) for x in zip(*[f[4] for f in figures if f[1] == lang], strict=True)], [sum(x) for x in zip(*[f[5] for f in figures if f[1] == lang], strict=True)]) for lang in common}
    want, far_ones = [], 0
    for i, lang, text, words, classes, hist in figures:
        windows = collections.Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        again = {k + j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(5)}
        failed = len(words) < 10 or 100 * len(again) > 20 * len(words)
        a = distance(classes, total[lang][0]) if lang in total and len(text) >= 200 else None
        b = distance(hist, total[lang][1]) if lang in total and sum(hist) >= 30 else None
        far = (a is not None and a > 0.2 + 2 / math.sqrt(len(text))) or (b is not None and b > 0.45 + 2 / math.sqrt(sum(hist)))
        far_ones += far and not failed
        want.append((i, failed, not failed and not far, a, b))
    got = [(r.doc_id, r.base_failed, r.kept, r.class_distance, r.word_distance) for r in rules.assessed(docs).collect()]
    short = lambda rows: sorted(repr((*r[:3], *[None if x is None else round(x, 7) + 0.0 for x in r[3:]])) for r in rows)
    assert short(got) == short(want)
    assert far_ones and any(k for _, _, k, _, _ in want) and sum(b is not None for *_, b in want) > 50


def hashed(b: bytes) -> int:
    data = np.frombuffer(b, np.uint8)
    return int(spans(prefix(data), np.array([0]), np.array([len(data)]))[0])


def naive_entries(text: str, dims: int) -> list[tuple[int, float]]:
    """Bucket and value of everything that a text is graded by."""
    raw = text.encode()
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", raw) if w]
    low = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    shape = lambda c: 65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c
    out = []
    share = 1 / math.sqrt(max(len(words), 1)) / 2
    for w, x in zip(words, low, strict=True):
        s = [shape(c) for c in w]
        out.append((hashed(x), share))
        out.append((hashed(bytes(c for i, c in enumerate(s) if i == 0 or c != s[i - 1])) ^ 3, share))
    n, size = max(len(words), 1), max(len(raw), 1)
    signs = sum(32 < c < 48 or 57 < c < 65 or 90 < c < 97 or 122 < c < 128 for c in raw)
    figures = [16 * (sum(a == b for a, b in zip(low, low[1:], strict=False)) / n), math.log2(len(words) + 1), 16 * len(set(low)) / n, min(40 * (sum(65 <= c < 91 for c in raw) / size), 20), min(40 * (signs / size), 20)]
    out += [(int(mix(np.array([int(x) + 1000 * (k + 1)], U))[0]), 0.5) for k, x in enumerate(figures)]
    return [(h & (dims - 1), v) for h, v in out]


def test_grades_by_definition(spark, small):
    docs = fixtures.documents(spark, small)
    labels = spark.read.parquet(f"{small}/labels.parquet")
    model = quality.fit(docs, labels, F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2), per_grade=60, dims=1 << 14)
    assert list(model.thresholds) == sorted(model.thresholds) and len(model.thresholds) == 2
    got = sorted((repr(r.doc_id), round(r.expected_grade, 6), round(r.tail_prob, 6), r.kept) for r in quality.grade(docs, model, cut=2, least=0.4).collect())
    want = []
    for r in docs.collect():
        z = sum(float(model.weights[b]) * v for b, v in naive_entries(r.text or "", 1 << 14))
        over = [1 / (1 + math.exp(t - z)) for t in model.thresholds]
        want.append((repr(r.doc_id), round(sum(over), 6), round(over[1], 6), over[1] >= 0.4))
    assert all(a[0] == b[0] and abs(a[1] - b[1]) < 3e-6 and abs(a[2] - b[2]) < 3e-6 and (a[3] == b[3] or abs(a[2] - 0.4) < 1e-5) for a, b in zip(got, sorted(want), strict=True))


def loss(z, y, weight, theta):
    """Weighted mean of -log P(grade) by the cumulative probabilities."""
    edge = np.concatenate([[-np.inf], theta, [np.inf]])
    p = 1 / (1 + np.exp(-(edge[y + 1] - z))) - 1 / (1 + np.exp(-(edge[y] - z)))
    return float((weight / weight.sum() * -np.log(np.maximum(p, 1e-9))).sum())


def test_fitting_finds_the_least_loss():
    """One feature and three grades: no weight and no thresholds near the fitted ones do better, so the gradient is that of the loss."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=400)
    y = np.digitize(1.5 * x + rng.logistic(size=400), [-1.0, 2.0])
    weight = rng.uniform(0.5, 2, 400)
    model = quality.fitted(y, weight, np.arange(400), np.zeros(400, int), x, 3, 8, steps=3000, rate=0.02, decay=0.0)
    best = loss(model.weights[0] * x, y, weight, model.thresholds)
    for dw, d1, d2 in ((0.02, 0, 0), (-0.02, 0, 0), (0, 0.03, 0), (0, -0.03, 0), (0, 0, 0.03), (0, 0, -0.03), (0.02, 0.03, 0.03)):
        assert loss((model.weights[0] + dw) * x, y, weight, model.thresholds + [d1, d2]) > best

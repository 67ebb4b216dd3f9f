"""Runs of repeated words, passages of earlier documents and codes of vectors, against brute force and on odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanewise.llm import codes, passages, periods, queries
from lanewise.llm.bytesnum import U, mix

from . import fixtures

WORD = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def brute_runs(s, least):
    """Every period is tried at every place."""
    out = {}
    for q in range(1, len(s) // 2 + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q) and j > i:
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return out


def periodic(rng, n):
    s = [rng.randrange(rng.choice([1, 2, 2, 3])) for _ in range(n)]
    if n > 20 and rng.random() < 0.5:
        p, k = rng.randint(1, 9), rng.randint(0, n // 2)
        for i in range(k, n):
            s[i] = s[k + (i - k) % p]
        if rng.random() < 0.5:
            s[rng.randrange(n)] = 7
    return s


@pytest.mark.parametrize("least", [4, 6, 12])
def test_repetitions_by_brute_force(least):
    rng = random.Random(least)
    for _ in range(1200):
        s = periodic(rng, rng.randint(0, 70))
        assert periods.repetitions(s, least) == brute_runs(s, least)


def test_stretches_hold_every_run():
    rng = random.Random(3)
    for _ in range(300):
        texts = [periodic(rng, rng.randint(0, 60)) for _ in range(3)]
        h = mix(np.array(sum(texts, []), U))
        rows = np.repeat(np.arange(3), [len(t) for t in texts])
        first = np.searchsorted(rows, np.arange(3))
        got = {(int(rows[a]), a - int(first[rows[a]]) + x, a - int(first[rows[a]]) + y): q for a, b in zip(*(z.tolist() for z in periods.stretches(h, rows, 12)), strict=True) for (x, y), q in periods.repetitions(np.unique(h[a:b], return_inverse=True)[1].tolist()).items()}
        assert got == {(k, x, y): q for k, t in enumerate(texts) for (x, y), q in brute_runs(t, 12).items()}


def test_z_values():
    rng = random.Random(1)
    for _ in range(200):
        s = [rng.randrange(2) for _ in range(rng.randint(1, 40))]
        want = [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]
        assert periods.z_values(s) == want


def run_row(doc_id, text):
    w = WORD.findall(text or "")
    found = sorted((a, b - a, q) for (a, b), q in brute_runs(w, 12).items())
    gone = {i for a, n, q in found for i in range(a + q, a + n)}
    best = max(found, key=lambda x: (x[1], -x[0], -x[2]), default=(None, None, None))
    listed = "".join(f"{a},{n},{q}\n" for a, n, q in found)
    return (doc_id, len(w), len(found), *best, 1000 * best[1] // best[2] if found else None, sha(listed), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def odd_texts():
    para = "one two three four five six seven"
    return [
        *[(r[0], r[1]) for r in fixtures.odd_rows() if r[0] != 10_013],
        (1, "a " * 11), (2, "a " * 12), (3, "a b " * 6), (4, ("a b c d e f g " * 2).strip()), (5, " ".join([para] * 3) + " eight " + para),
        (5, "another text under the same id"), (6, "x y\u00a0z " * 7), (7, "a b c " * 5 + "a b a b a b a b a b a b a b"),
    ]


def test_runs_of_odd_texts(spark):
    rows = odd_texts()
    docs = fixtures.with_clashing_columns(spark.createDataFrame(rows, "doc_id long, text string"))
    got = periods.with_runs(docs)
    names = ["doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(repr, (tuple(r) for r in got.select(*names).collect()))) == sorted(repr(run_row(*r)) for r in rows)
    for r in got.collect():
        assert sha(r.text_left) == r.collapsed_sha256
        assert sha("".join(f"{x.start},{x.length},{x.period}\n" for x in r.runs)) == r.runs_sha256


def test_runs_of_a_very_long_text(spark):
    text = "word " * 120_000 + "end " + "tick tock " * 50_000
    got = periods.with_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(x) for x in got.runs] == [(0, 120_000, 1), (120_001, 100_000, 2)]
    assert got.text_left == "word end tick tock"


def test_runs_of_an_empty_table_and_bad_lengths(spark):
    assert periods.with_runs(fixtures.empty(spark)).count() == 0
    with pytest.raises(ValueError):
        periods.with_runs(fixtures.empty(spark), least=7)


def test_periodic_edit(spark, small):
    docs = fixtures.documents(spark, small)
    edited = queries.with_periods(docs).collect()
    want = []
    for r in docs.collect():
        w, h = WORD.findall(r.text or ""), None if r.doc_id is None else zlib.crc32(str(r.doc_id).encode())
        if h is None or h % 10 or not w:
            want.append((r.doc_id, r.text))
            continue
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        want.append((r.doc_id, " ".join(w[i] if i < a else w[a + (i - a) % p] for i in range(len(w)))))
    assert sorted(map(repr, (tuple(r) for r in edited))) == sorted(map(repr, want))
    assert sum(a != b for a, b in zip(sorted(map(repr, want)), sorted(repr((r.doc_id, r.text)) for r in docs.collect()), strict=True)) > 5


def brute_passages(rows, length):
    lowest = {}
    words = [WORD.findall(t or "") for _, t in rows]
    windows = [[tuple(w[i : i + length]) for i in range(len(w) - length + 1)] for w in words]
    for (d, _), ws in zip(rows, windows, strict=True):
        for w in ws if d is not None else ():
            lowest[w] = min(lowest.get(w, d), d)
    out = []
    for (d, _), w, ws in zip(rows, words, windows, strict=True):
        gone = {i + k for i, x in enumerate(ws) if d is not None and lowest[x] < d for k in range(length)}
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return sorted(map(repr, out))


def shared_rows(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "c", "dd", "\u00e9", "F"]
    phrase = [rng.choice(vocabulary) for _ in range(9)]
    pool = [[rng.choice(vocabulary) for _ in range(rng.randint(3, 50))] for _ in range(6)]
    rows = []
    for d in range(60):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += rng.choice([phrase, rng.choice(pool), rng.choice(pool)[2:20], [rng.choice(vocabulary) for _ in range(rng.randint(0, 12))]])
        rows.append((rng.choice([d, d, rng.randint(0, 60), None]), " ".join(w) if rng.random() < 0.9 else "  " + "\n".join(w) + "\t"))
    return rows


@pytest.mark.parametrize(("seed", "length", "k"), [(1, 13, 5), (2, 13, 13), (3, 5, 2), (4, 5, 1), (5, 8, 5)])
def test_passages_by_brute_force(spark, seed, length, k):
    rows = shared_rows(seed) + [(r[0], r[1]) for r in fixtures.odd_rows()]
    docs = fixtures.with_clashing_columns(spark.createDataFrame(rows, "doc_id long, text string"))
    got = passages.without_passages(docs, length, k)
    assert sorted(map(repr, (tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()))) == brute_passages(rows, length)
    for r in got.collect():
        assert sha(r.text_left) == r.kept_sha256
        assert r.n_removed == sum(b - a for a, b in zip(r.removed[::2], r.removed[1::2], strict=True))


def test_passages_of_a_very_long_text_and_none(spark):
    rng = random.Random(1)
    long = [f"w{rng.randrange(10**6)}" for _ in range(200_000)]
    docs = spark.createDataFrame([(1, " ".join(long[1000:1200])), (2, " ".join(long)), (3, " ".join(long))], "doc_id long, text string")
    assert sorted(tuple(r) for r in passages.without_passages(docs).select("doc_id", "n_words", "n_removed").collect()) == [(1, 200, 0), (2, 200_000, 200), (3, 200_000, 200_000)]
    assert passages.without_passages(fixtures.empty(spark)).count() == 0
    with pytest.raises(ValueError):
        passages.without_passages(docs, 5, 6)


def brute_codes(rows, parts, entries, scale, rounds):
    good = [(i, [int(np.floor(np.float64(x) * scale)) for x in v], label) for i, v, label in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    m = len(good[0][1]) // parts
    cut = lambda v: [tuple(v[p * m : (p + 1) * m]) for p in range(parts)]
    books = [[cut(v)[p] for _, v, _ in good[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda p, x: min(range(len(books[p])), key=lambda e: (far(x, books[p][e]), e))
    for _ in range(rounds):
        new = [list(b) for b in books]
        for p in range(parts):
            of = [(nearest(p, cut(v)[p]), cut(v)[p]) for _, v, _ in good]
            for e in {e for e, _ in of}:
                mine = [x for q, x in of if q == e]
                new[p][e] = tuple(sum(c) // len(mine) for c in zip(*mine, strict=True))
        books = new
    coded = [(i, label, "".join(f"{nearest(p, x):02x}" for p, x in enumerate(cut(v))), sum(far(x, books[p][nearest(p, x)]) for p, x in enumerate(cut(v)))) for i, v, label in good]
    sums = {}
    for _, label, _, e in coded:
        sums[label] = sums.get(label, 0) + e
    digest = sha(",".join(str(c) for b in books for e in b for c in e))
    return sorted(repr((*r, sums[r[1]], digest)) for r in coded)


@pytest.mark.parametrize(("parts", "entries", "rounds"), [(4, 16, 4), (2, 256, 2), (1, 3, 0)])
def test_codes_by_brute_force(spark, parts, entries, rounds):
    rng = random.Random(parts)
    rows = [(rng.randrange(50), [rng.choice([rng.uniform(-2, 2), 0.5, -0.25]) for _ in range(8)], rng.choice([0, 1, None])) for _ in range(80)]
    rows += [(1, None, 0), (2, [], 0), (3, [1.0] * 7 + [None], 0), (4, [float("nan")] * 8, 1), (5, [1.0] * 7 + [float("inf")], 1), (None, [0.1] * 8, None), (7, [0.3] * 8, 2), (7, [0.3] * 8, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    df = df.select("*", F.lit("clash").alias("v"), F.lit("clash").alias("code"), F.lit("clash").alias("of"))
    got = codes.compressed(df, parts=parts, entries=entries, scale=1024, rounds=rounds)
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute_codes(rows, parts, entries, 1024, rounds)


def test_codes_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label string"
    assert codes.compressed(spark.createDataFrame([], schema)).count() == 0
    assert codes.compressed(spark.createDataFrame([(1, None, "a"), (2, [], "a")], schema)).count() == 0
    one = codes.compressed(spark.createDataFrame([(5, [1.0] * 8, "a"), (6, [1.0] * 4, "b")], schema)).collect()
    assert [(r.vec_id, r.label, r.code, r.error, r.label_error) for r in one] == [(5, "a", "00000000", 0, 0)]
    with pytest.raises(ValueError):
        codes.compressed(spark.createDataFrame([(5, [1.0] * 6, "a")], schema))
    with pytest.raises(Exception, match="no exact 64-bit distances"):
        codes.compressed(spark.createDataFrame([(5, [1e30] * 8, "a")], schema)).collect()

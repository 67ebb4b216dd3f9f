"""Learnt operators: held-out accuracy, limits of what they learn from, odd rows; and the pipeline."""

import collections
import itertools
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanewise.llm import language, quality, toxicity
from lanewise.llm.bytesnum import U, prefix, spans
from lanewise.llm.common import held_out, table

from .fixtures import documents, with_clashing_columns

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, SF).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return table(spark, SF, "labels")


def test_toxicity(docs, labels):
    got = {r.doc_id: r for r in toxicity.toxicity(with_clashing_columns(docs), labels).collect()}
    held = [(got[r.doc_id], r.toxic) for r in labels.where(held_out(F.col("doc_id"))).collect()]
    caught = [r.predicted for r, y in held if y]
    assert sum(caught) / len(caught) >= 0.6  # so few labels show the words of one language only
    assert not any(r.predicted for r, y in held if not y)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert got[10_000].score == got[10_001].score == 0 and got[10_000].offending == []
    text = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    bad = next(r for r in got.values() if r.predicted and r.offending)
    assert 0 <= bad.offending[0] < bad.offending[1] <= len(text[bad.doc_id])


def test_toxicity_learns_nothing_from_held_out_labels(docs, labels):
    other = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, other)
    assert np.array_equal(a.weights, b.weights)


def test_noisy_or_is_found_by_the_fit():
    """Documents of sentences of one word each; word 1 makes a document toxic."""
    rng = np.random.default_rng(0)
    examples = []
    for _ in range(300):
        w = rng.integers(2, 50, 20)
        y = int(rng.random() < 0.3)
        if y:
            w[rng.integers(20)] = 1
        examples.append((y, 1.0, w, np.ones(20, np.int32)))
    model = toxicity.fitted(examples, 64)
    assert model.weights[1] > 8 and np.delete(model.weights, 1).max() < 4


def test_clean_keeps_rows_as_they_are(docs, labels):
    model = toxicity.fit(docs, labels)
    kept = toxicity.clean(with_clashing_columns(docs), model)
    assert kept.columns == with_clashing_columns(docs).columns
    scores = toxicity.score(docs, model)
    assert kept.count() == scores.where("score < 0.3").count()


def test_language(docs):
    got = language.identify(with_clashing_columns(docs), per_language=300)
    rows = got.join(docs.select("doc_id", "lang").distinct(), "doc_id").where("held_out and doc_id < 10000").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) >= 0.97
    by = {r.doc_id: r for r in got.collect()}
    assert by[10_000].lang_pred == by[10_001].lang_pred == by[10_002].lang_pred == "und" and by[10_000].score == 0
    assert all(0 <= r.score <= 1 for r in by.values())


def test_language_of_one_document(spark, docs):
    """A language is learnt from its only document, whatever the document's hash."""
    learnt = [r.id for r in spark.range(200_000, 200_100).where(~held_out(F.col("id"))).collect()]
    # signs of its own for each language
    rows = [(i, "".join(chr(0x3B1 + (k * 7 + n) % 17 if n % 6 else 32) for n in range(300)) if k == 0 else "".join(chr(0x4E00 + 100 * k + n % 50) for n in range(300)), f"l{k}") for k, i in enumerate(learnt[:24])]
    few = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    common = docs.select("doc_id", "text", "lang").where("lang is not null")
    model = language.fit(common.union(few), 300)
    assert {x for _, _, x in rows} <= set(model.languages)
    got = {r.doc_id: r.lang_pred for r in language.predict(few, model).collect()}
    assert got == {i: lang for i, _, lang in rows}
    assert language.fit(few, 300).languages == sorted(lang for _, _, lang in rows)


def test_kneser_ney_is_a_distribution():
    text = "abracadabra cadabra abra " * 4
    data = np.frombuffer(text.encode(), np.uint8)
    packed, _ = language.grams(data, np.array([0, len(data)]))
    code, n = np.unique(packed, return_counts=True)
    model = language.KneserNey.of(code, n)
    letters = np.array([ord(c) for c in "abrcd "], U)
    for context in {int(c) >> 16 for c in code}:
        p = np.exp(model.log_prob(np.uint64(context << 16) | letters))
        # all seen letters, and the floor's share for one unseen
        assert p.sum() <= 1 + 1e-9 and p.sum() > 0.85 and (p > 0).all()


def test_quality(docs, labels):
    graded = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    model = quality.fit(docs, labels, graded)
    assert list(model.thresholds) == sorted(model.thresholds)
    got = {r.doc_id: r for r in quality.grade(with_clashing_columns(docs), model).collect()}
    held = [(got[r.doc_id], r.quality) for r in labels.where(held_out(F.col("doc_id"))).collect()]
    assert np.mean([r.kept == (y == 1) for r, y in held]) >= 0.93
    assert all(0 <= r.expected_grade <= 2 and 0 <= r.tail_prob <= 1 and not math.isnan(r.tail_prob) for r in got.values())


def test_pipeline(spark, docs):
    import corpus_pipeline as p
    from lanewise.llm import mixing, near_dedup, secrets
    from lanewise.llm.common import settled

    data = table(spark, SF, "documents")
    outs = []
    for name, stage in p.STAGES:
        data = settled(stage(spark, data, SF))
        outs.append((name, data))
    assert [n for n, _ in outs] == ["toxicity", "near_dedup", "secrets", "mixing", "byte_bpe"]
    assert all(d.columns == p.COLUMNS for _, d in outs[:-1])
    clean, single, masked, mixed, encoded = (d for _, d in outs)
    scores = toxicity.score(table(spark, SF, "documents"), toxicity.fit(table(spark, SF, "documents"), table(spark, SF, "labels")))
    ids = lambda d: sorted(r.doc_id for r in d.select("doc_id").collect())
    assert ids(clean) == ids(scores.where("score < 0.3"))
    assert ids(single) == ids(near_dedup.near_duplicates(clean, 5).where("kept"))
    assert ids(masked) == ids(single) and secrets.report(masked).where("spans <> ''").count() == 0
    assert set(ids(mixed)) < set(ids(masked)) and mixed.count() >= 0.8 * masked.count()
    assert ids(encoded) == ids(mixed)
    tokens = mixed.agg(F.sum(mixing.n_tokens(F.col("text")))).first()[0]
    assert tokens >= 0.85 * masked.agg(F.sum(mixing.n_tokens(F.col("text")))).first()[0]
    assert p.run(spark, SF).count() == encoded.count()


def test_forget_keeps_what_is_named(spark):
    from lanewise.llm.common import forget, settled

    a, b = settled(spark.range(3)), settled(spark.range(5))
    assert forget(spark, b) >= 1 and b.count() == 5
    with pytest.raises(Exception, match="(?i)path|exist|FAILED_READ_FILE"):
        a.count()


def test_no_language_is_left_without_a_sample():
    """However many documents a language has, about per_language of them fall below its bound."""
    sizes = {"few": 3, "some": 1501, "many": 10**7, "most": 2 * 10**9, "all": 10**15}
    got = language.bounds(sizes, 1500)
    for lang, n in sizes.items():
        share = (got[lang] + (1 << 63)) / 2**64
        assert abs(share * n - min(n, 1500)) < 0.01 * min(n, 1500)


def test_kneser_ney_equals_its_definition():
    """Interpolated Kneser-Ney worked out with dictionaries, for every 4-gram over a small alphabet."""
    texts = ["abracadabra", "barbara", "abba cab", "dab"]
    seqs = ["   " + t + " " for t in texts]
    counts = {4: collections.Counter(s[i : i + 4] for s in seqs for i in range(len(s) - 3))}
    for k in (3, 2, 1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
    discount = {}
    for k, c in counts.items():
        one, two = (sum(v == x for v in c.values()) for x in (1, 2))
        discount[k] = one / (one + 2 * two) if one and two else 0.5
    floor = 1 / (len(counts[1]) + 1)

    def prob(g):
        k = len(g)
        if not k:
            return floor
        same = {h: v for h, v in counts[k].items() if h[:-1] == g[:-1]}
        if not same:
            return prob(g[1:])
        total = sum(same.values())
        rest = sum(min(v, discount[k]) for v in same.values()) / total
        return max(same.get(g, 0) - discount[k], 0) / total + rest * prob(g[1:])

    pack = lambda g: sum(ord(c) << 16 * (3 - i) for i, c in enumerate(g))
    made = np.array([pack(g) for g in counts[4]], np.uint64)
    model = language.KneserNey.of(made, np.array(list(counts[4].values())))
    every = ["".join(g) for g in itertools.product("abcdr ", repeat=4)]
    got = model.log_prob(np.array([pack(g) for g in every], np.uint64))
    assert np.allclose(got, [np.log(prob(g)) for g in every])


def test_labels_that_differ_and_rows_that_repeat(spark):
    """The least label counts, one row of each doc_id is learnt from, and a long text isn't."""
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2]
    a, b, c, d = ids[:4]
    docs = spark.createDataFrame([(a, "x"), (a, "y"), (a, "y"), (b, "z" * 50), (c, None), (d, "w"), (None, "v")], "doc_id long, text string")
    labels = spark.createDataFrame([(a, 1), (a, 0), (b, 1), (c, 0), (d, 1), (d, 1), (None, 1), (ids[5], 7)], "doc_id long, toxic int")
    totals, sample = toxicity.labelled(docs, labels, F.col("toxic"), [0, 1], 10, 40)
    got = {r.doc_id: (r.label, r.text) for r in sample.collect()}
    assert totals == {0: 2, 1: 2} and set(got) == {a, c, d} and got[c] == (0, None) and got[d] == (1, "w") and got[a][0] == 0
    for part in (sample, sample.repartition(7)):
        assert {r.doc_id: (r.label, r.text) for r in part.collect()} == got


def test_toxicity_equals_a_naive_scorer(spark, docs, labels):
    """Sentences and words cut by regular expressions, each hashed by itself, summed and joined by noisy-or."""
    model = toxicity.fit(docs, labels)
    dims = len(model.weights)

    def bucket(word, k=0):
        data = np.frombuffer(word, np.uint8)
        return int((spans(prefix(data), np.array([0]), np.array([len(data)]))[0] ^ U(k)) & U(dims - 1))

    def naive(text):
        clean = 1.0
        for sentence in re.split(rb"[.!?\n]", (text or "").encode()):
            words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", sentence)
            if words:
                low = [bytes(c + 32 if 65 <= c < 91 else c for c in w) for w in words]
                z = model.bias + sum(float(model.weights[bucket(w)]) + sum(float(model.weights[bucket(w[:n], k)]) if len(w) > n else float(model.weights[0]) for k, n in enumerate(toxicity.STEMS, 1)) for w in low)
                base = 1 / (1 + math.exp(-model.bias))
                clean *= 1 - max(0.0, (1 / (1 + math.exp(-min(40, max(-40, z)))) - base) / (1 - base))
        return 1 - clean

    some = docs.where("doc_id is null or doc_id % 9 = 0 or doc_id >= 10000")
    want = sorted((r.doc_id if r.doc_id is not None else -1, round(naive(r.text), 6)) for r in some.collect())
    got = sorted((r.doc_id if r.doc_id is not None else -1, round(r.score, 6)) for r in toxicity.score(with_clashing_columns(some), model).collect())
    assert got == want


def test_a_language_of_few_documents_in_many_rows_is_learnt(spark):
    few = ["der hund und die katze schlafen im haus", "das wetter ist heute sehr schön und warm", "wir gehen morgen in die schule", "sie liest ein buch über die geschichte", "der zug fährt um acht uhr ab"]
    many = [f"the dog number {i} and the cat sleep in house {i % 7}" for i in range(400)]
    rows = [(i, t, "de") for i, t in enumerate(few) for _ in range(2000)] + [(100 + i, t, "en") for i, t in enumerate(many)]
    # ids that may be learnt from
    rows = [(i, t, x) for i, t, x in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=50)
    assert model.languages == ["de", "en"]
    got = language.predict(spark.createDataFrame([(1, "die katze und der hund gehen heute"), (2, "the cat and the dog")], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == ["de", "en"]


def test_language_scores_by_the_definition(spark):
    """lang_pred has the least mean cost of its 4-grams' last characters, summed up one by one."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    model = language.fit(docs, per_language=20)
    out = {r.doc_id: r for r in language.predict(docs, model).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for i, r in out.items():
        if r.lang_pred == "und":
            continue
        data = np.frombuffer((texts[i] or "").encode(), np.uint8)
        packed, _ = language.grams(data, np.array([0, len(data)]))
        cost = [-sum(float(m.log_prob(np.array([g]))[0]) for g in packed) / len(packed) for m in model.each]
        assert abs(min(cost) - cost[model.languages.index(r.lang_pred)]) < 1e-9
        assert abs(r.entropy - min(cost)) < 1e-6

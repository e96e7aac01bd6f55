import random

import numpy as np
import pyarrow as pa
import pytest

from sectorlake.llm import classifiers, fm, quality_classifier, textcore as tc, toxicity


def test_score_is_the_pairwise_sum():
    r = np.random.default_rng(1)
    factor = r.normal(size=(9, 4))
    factor[[1, 5]] = 0
    m = fm.Machine(0.3, r.normal(size=9), np.array([0, 2, 3, 4, 6, 7, 8]), factor[[0, 2, 3, 4, 6, 7, 8]])
    sets = [np.array([0, 3, 5]), np.array([], int), np.array([8])]
    rows = np.repeat(np.arange(3), [len(s) for s in sets])
    got = m.raw(rows, np.concatenate(sets).astype(int), 3)
    for s, g in zip(sets, got, strict=True):
        pairs = sum(factor[i] @ factor[j] for a, i in enumerate(s) for j in s[a + 1 :])
        assert g == pytest.approx(0.3 + m.weight[s.astype(int)].sum() + pairs)


def test_learns_an_interaction_that_no_weight_shows():
    r = np.random.default_rng(2)
    x = r.integers(0, 2, (3000, 2))
    sets = [np.array([k for k in (0, 1) if row[k]] + [2 + int(r.integers(0, 20))]) for row in x]
    y = (x[:, 0] ^ x[:, 1]).astype(float)
    m = fm.fit(sets[:2000], y[:2000], 22, epochs=60)
    rows = np.repeat(np.arange(1000), [len(s) for s in sets[2000:]])
    assert ((m.score(rows, np.concatenate(sets[2000:]), 1000) > 0.5) == (y[2000:] == 1)).mean() > 0.98


def test_no_pair_stands_out_by_chance():
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 60, 12)) for _ in range(2000)]
    y = np.array([float((3 in s) or (5 in s)) for s in sets])
    m = fm.fit(sets, y, 60)
    rows = np.repeat(np.arange(2000), [len(s) for s in sets])
    assert ((m.score(rows, np.concatenate(sets), 2000) > 0.5) == (y == 1)).mean() > 0.98


def test_toxicity_learns_pairs_alone(spark):
    """An insult is toxic only with a group, and a group only with an insult: no term goes with the label by itself."""
    r = random.Random(5)
    words = [f"{a}{b}{c}" for a in "bdfgklmn" for b in "aeiou" for c in ("n", "r", "st", "")]
    docs, labels = [], []
    for k in range(3000):
        text = [r.choice(words) for _ in range(r.randint(15, 40))]
        insult, group = r.random() < 0.5, r.random() < 0.5
        for is_, word in ((insult, "zork"), (group, "vumpians")):
            if is_:
                text.insert(r.randrange(len(text)), word)
        docs.append((k, " ".join(text)))
        labels.append((k, int(insult == group)))
    docs, labels = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    truth = dict(labels.collect())
    held = [(r.score > 0.5, truth[r.doc_id] == 1) for r in toxicity.score(docs, model).collect() if r.held_out]
    assert len(held) > 900 and np.mean([a == b for a, b in held]) > 0.9


def test_sample_does_not_grow_with_repeats_or_text(spark):
    docs, labels = corpus(spark, 200)
    one = classifiers.sample(docs, labels, "toxic", "doc_id", "text", 100, True, (4,))
    more = classifiers.sample(docs.unionByName(docs).unionByName(docs), labels.unionByName(labels), "toxic", "doc_id", "text", 100, True, (4,))
    key = lambda s: sorted((bytes(r.terms), bytes(r.shape), r.y) for r in s.df.collect())
    assert key(one) == key(more) and len(key(one)) <= 100
    long = spark.createDataFrame([(k, " ".join(chr(97 + k) + chr(97 + j % 26) + chr(97 + j // 26 % 26) + chr(97 + j // 676 % 9) for j in range(60000)), 1) for k in range(6)], "doc_id bigint, text string, toxic int")
    rows = classifiers.sample(long, long, "toxic", "doc_id", "text", 10, False, ())
    names = classifiers.frequent(rows.df, 64, 1)
    y, sets, _ = classifiers.held(rows.df, names)
    assert len(names) == 64 and all(len(s) <= 64 for s in sets)
    for s in (one, more, rows):
        s.drop()


def test_one_class_and_nothing():
    assert fm.fit([], np.array([]), 3).score(np.empty(0, int), np.empty(0, int), 2).tolist() == [0.5, 0.5]
    assert fm.fit([np.array([1])], np.array([1.0]), 3).score(np.empty(0, int), np.empty(0, int), 1)[0] > 0.9


def test_terms_fold_case_and_cut_beginnings():
    def of(text):
        out = set()
        for _, _, data, offsets in tc.chunks(pa.array([text])):
            out |= set(classifiers.terms(data, offsets, (4, 5, 6))[1].tolist())
        return out

    assert of("Idiot!") == of("idiot") == of("IDIOT,") and len(of("idiot")) == 3
    assert of("loweischaft") & of("loweiung") and not of("abc") & of("abd") and of("") == set()
    rows = list(tc.chunks(pa.array(["ab", "cd"])))[0]
    assert classifiers.terms(rows[2], rows[3])[0].tolist() == [0, 1]


def test_repeated_terms_and_sizes_are_features():
    rows, hashes = np.array([0, 0, 0, 1]), np.array([7, 7, 9, 7], np.uint32)
    r, h = classifiers.leveled(rows, hashes, np.array([3, 1, 0]))
    size = lambda n: classifiers._SIZE + int(np.log2(n + 1))
    assert set(zip(r.tolist(), h.tolist(), strict=True)) == {(0, 7), (0, 9), (0, 7 ^ classifiers.LEVELS[2]), (1, 7), (0, size(3)), (1, size(1)), (2, size(0))}
    assert all(not x & 0xFFFFF for x in classifiers.LEVELS.values())


def corpus(spark, n=1500):
    r = random.Random(4)
    words = [f"{a}{b}{c}" for a in "bdfgklmn" for b in "aeiou" for c in ("n", "r", "st", "")]
    docs, labels = [], []
    for k in range(n):
        text = " ".join(r.choice(words) for _ in range(r.randint(20, 120))).split(" ")
        bad, low = k % 7 == 0, k % 5 == 0
        if bad:
            for _ in range(r.randint(1, 4)):
                text.insert(r.randrange(len(text)), r.choice(["zorkish", "Zorkheit,", "VUMP!"]))
        text = " ".join(w + "###" for w in text) if low else " ".join(text)
        docs.append((k, text, 0.5, "clash"))
        if k % 2 == 0 or k % 7 == 0:
            labels.append((k, 0 if low else 1, int(bad)))
    docs += [(n, None, None, None), (n + 1, "", None, None), (None, "zorkish", None, None), (0, docs[0][1], 1.0, "again")]
    labels += [(n + 5, None, None), (None, 1, 1), (0, *labels[0][1:])]
    return spark.createDataFrame(docs, "doc_id bigint, text string, score double, held_out string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


@pytest.mark.parametrize("kind, label", [(toxicity, "toxic"), (quality_classifier, "quality")])
def test_classifiers_on_held_out_rows(spark, kind, label):
    docs, labels = corpus(spark)
    model = kind.fit(docs, labels)
    got = kind.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    import zlib

    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    truth = {r.doc_id: r[label] for r in labels.collect()}
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and truth.get(r.doc_id) is not None]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert len({r.score for r in got if r.doc_id == 0}) == 1
    assert kind.score(docs.limit(0), model).count() == 0
    again = kind.score(docs, kind.fit(docs.repartition(5), labels.repartition(3))).collect()
    assert {(r.doc_id, round(r.score, 6)) for r in got} == {(r.doc_id, round(r.score, 6)) for r in again}


@pytest.mark.parametrize("kind", [toxicity, quality_classifier])
def test_very_long_texts_are_scored_whole(spark, kind):
    docs, labels = corpus(spark, 600)
    model = kind.fit(docs, labels)
    filler = " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676 % 26)}" for k in range(300000))
    rows = [(1, filler), (2, filler + " zorkish Zorkheit, VUMP! zorkish VUMP! " + filler), (3, "")]
    got = {r.doc_id: r.score for r in kind.score(spark.createDataFrame(rows, "doc_id bigint, text string"), model).collect()}
    assert len(got) == 3 and all(0 <= s <= 1 for s in got.values()) and (kind is not toxicity or got[2] > got[1])


@pytest.mark.parametrize("kind", [toxicity, quality_classifier])
def test_scores_against_brute_force(spark, kind):
    """The query's scores, by summing over all pairs of each text's features."""
    docs, labels = corpus(spark, 600)
    model = kind.fit(docs, labels)
    m, factors = model.machine, dict(zip(model.machine.factored.tolist(), model.machine.factor, strict=True))
    for r in kind.score(docs, model, keep=("text",)).limit(60).collect():
        features = set()
        for _, _, data, offsets in tc.chunks(pa.array([r.text])):
            rows, hashes = classifiers.terms(data, offsets, model.prefixes)
            known = set(classifiers.leveled(rows, hashes, np.array([len(hashes)]))[1].tolist())
            features = {k for k, name in enumerate(model.names.tolist()) if name in known}
            if model.edges is not None:
                shape = classifiers.shapes(classifiers.stats(data, offsets))[0]
                features |= {len(model.names) + k * classifiers.BINS + sum(x >= e for e in model.edges[k]) for k, x in enumerate(shape)}
        z = m.bias + sum(m.weight[k] for k in features)
        some = [factors[k] for k in features if k in factors]
        z += sum(float(a @ b) for k, a in enumerate(some) for b in some[k + 1 :])
        assert r.score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)
        assert r.predicted == int(r.score >= kind.THRESHOLD)


def test_labels_of_held_out_rows_and_missing_labels_teach_nothing(spark):
    docs, labels = corpus(spark, 300)
    flipped = labels.withColumn("toxic", __import__("pyspark").sql.functions.when(classifiers.held_out(), 1 - labels.toxic).otherwise(labels.toxic))
    score = lambda t: sorted((r.doc_id or -1, r.score) for r in toxicity.score(docs, toxicity.fit(docs, t)).collect())
    assert score(labels) == score(flipped)
    none = toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).collect()
    assert len({r.score for r in none}) == 1
    assert toxicity.clean(docs, toxicity.fit(docs, labels)).columns == docs.columns

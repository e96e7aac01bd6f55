import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from sectorlake.llm import components, embedding_dedup, line_dedup, minhash_dedup, session
from sectorlake.llm.session import Stored, cut


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


@pytest.mark.parametrize("task", [10**6, 30])
def test_components(spark, task):
    r = random.Random(task)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(1000 + k, 1001 + k) for k in range(80)] + [(5000, 6000 + k) for k in range(60)] + [(7, 7), (8, 8)]
    want = Sets()
    for a, b in links:
        want.join(a, b)
    got = {x.node: x.component for x in components.components(spark.createDataFrame(links, "a bigint, b bigint").repartition(4), task).collect()}
    assert got == {n: want.find(n) for a, b in links if a != b for n in (a, b)}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_a_cluster_needs_a_shared_folder():
    for master, is_local in (("local", True), ("local[8]", True), ("local[*]", True), ("local[2,3]", True), ("local-cluster[2,1,1024]", False), ("spark://host:7077", False), ("yarn", False)):
        assert bool(session._LOCAL.fullmatch(master)) == is_local


def test_tables_are_cut_to_the_checkpoint_folder(spark):
    df = spark.range(10)
    assert sorted(r.id for r in cut(df).collect()) == list(range(10))
    kept = Stored(df)
    assert kept.df.count() == 10
    kept.drop()


# embeddings
def brute_vectors(rows, t=0.93):
    def good(r):
        return r[0] is not None and r[1] is not None and r[2] and all(x is not None and np.isfinite(x) for x in r[2]) and any(r[2])

    n, sets = [0] * len(rows), Sets()
    for i, a in enumerate(rows):
        for j in range(i):
            b = rows[j]
            if good(a) and good(b) and a[1] == b[1] and len(a[2]) == len(b[2]):
                x, y = np.array(a[2], float), np.array(b[2], float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= t:
                    n[i] += 1
                    n[j] += 1
                    sets.join(a[0], b[0])
    return sorted(((r[0], k, sets.find(r[0]) if r[0] is not None else None, r[0] is not None and sets.find(r[0]) == r[0]) for r, k in zip(rows, n, strict=True)), key=str)


@pytest.mark.parametrize("dimensions, tile", [(3, 8), (20, 2048)])
def test_vectors_against_brute_force(spark, dimensions, tile):
    r, rows = np.random.default_rng(dimensions), []
    for k in range(160):
        v = r.normal(size=dimensions).astype(np.float32).tolist()
        rows.append((int(r.integers(0, 120)), int(r.integers(0, 3)), v))
        if k % 4 == 0:
            rows.append((1000 + k, rows[-1][1], (np.array(v) * 3 + r.normal(size=dimensions) * 0.3).astype(np.float32).tolist()))
        if k % 9 == 0:
            rows += [(2000 + k, rows[-1][1], v), rows[-1]]
    rows += [(None, 1, rows[0][2]), (5000, None, rows[0][2]), (5001, 1, None), (5002, 1, [0.0, 0.0]), (5003, 1, [1.0, None]), (5004, 1, [1.0, float("nan")]), (5005, 1, [1.0, float("inf")]), (5006, 1, []), (5007, 1, [1.0, 2.0]), (5008, 1, [2.0, 4.0]), (5009, 2, [3.0])]
    df = spark.createDataFrame([(*x, "c", 1) for x in rows], "vec_id bigint, label int, embedding array<float>, key string, n_links int")
    got = sorted((tuple(x) for x in embedding_dedup.dedup(df, tile=tile).collect()), key=str)
    assert got == brute_vectors(rows)
    assert embedding_dedup.dedup(df.limit(0)).count() == 0


def test_bounds_lose_no_pair():
    r = np.random.default_rng(3)
    base = r.normal(size=(40, 40))
    x = np.concatenate([base, base + r.normal(size=base.shape) * 0.35, r.normal(size=(300, 40))])
    _, v = np.linalg.eigh(x.T @ x)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    i, j = embedding_dedup.compare(x, None, v[:, ::-1], 0.93)
    want = {(a, b) for a, b in zip(*np.nonzero(np.triu(u @ u.T >= 0.93, 1)), strict=True)}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and len(want) > 10
    i, j = embedding_dedup.compare(x[:100], x[100:], v[:, ::-1], 0.2)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*(k.tolist() for k in np.nonzero(u[:100] @ u[100:].T >= 0.2)), strict=True))


# near-duplicates
def test_signatures_agree_like_the_similarity():
    r, plain, weighted = np.random.default_rng(4), [], []
    for _ in range(60):
        e = r.integers(0, 2**63, 240, dtype=np.uint64)
        s = minhash_dedup.signatures(np.concatenate([e[:200], e[40:]]), np.repeat([0, 1], 200), 2)
        plain.append((s[0] == s[1]).mean())
        w, x = r.uniform(0.2, 6, 240), r.uniform(0.2, 6, 240)
        s = minhash_dedup.signatures(np.concatenate([e, e]), np.repeat([0, 1], 240), 2, np.concatenate([w, x]))
        weighted.append((s[0] == s[1]).mean() - np.minimum(w, x).sum() / np.maximum(w, x).sum())
    assert abs(np.mean(plain) - 160 / 240) < 0.02 and abs(np.mean(weighted)) < 0.02
    one = minhash_dedup.signatures(np.array([5], np.uint64), np.array([1]), 3)
    assert not one[0].any() and (one[1] != np.iinfo(np.uint64).max).all()


def word_sets(rows):
    for i, t in rows:
        w = (t or "").split()
        yield i, Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()


def brute_near(rows):
    sets, up = list(word_sets(rows)), Sets()
    for a, (_, x) in enumerate(sets):
        for b in range(a):
            y = sets[b][1]
            if (not x and not y) or 5 * (x & y).total() >= 4 * (x | y).total() > 0:
                up.join(a, b)
    classes = {}
    for k, (i, _) in enumerate(sets):
        classes.setdefault(up.find(k), []).append(i)
    return sorted((i, min(c)) for c in classes.values() for i in c)


def near_corpus(seed=6):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefgh") + str(r.randrange(900))
    rows = []
    template = [word() for _ in range(120)]
    for _ in range(25):
        base = [word() for _ in range(r.choice([3, 8, 60, 200]))]
        for _ in range(r.randint(1, 4)):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                copy[r.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    for k in range(40):  # a third of the rows share a template; only few of them are near enough
        own = [word() for _ in range(30 if k % 8 else 6)]
        rows.append(" ".join(template + own))
    line = " ".join(word() for _ in range(30))
    for times in (3, 20, 21, 22, 60, 70):  # repeated lines: near by weight
        rows.append("\n".join([line] * times + [" ".join(word() for _ in range(30))]))
    a, b = ("".join("ab"[k.bit_count() & 1 ^ x] for k in range(2048)) for x in (0, 1))
    rows += [a, b, f"{a} {b}", f"{b} {a}", " ".join(a), " ".join(b)]  # polynomial hashes take these for equal
    rows += [rows[0]] * 4 + ["  ".join(rows[1].split()), "", None, " \n", "one", "one", "two three"]
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("tile, signed_tile", [(192, 2048), (8, 16)])
def test_near_duplicates_against_brute_force(spark, monkeypatch, tile, signed_tile):
    monkeypatch.setattr(minhash_dedup.blocks, "__defaults__", ((4, 5), tile))
    monkeypatch.setattr(minhash_dedup.near, "__defaults__", (signed_tile, minhash_dedup.AGREE))
    rows = near_corpus()
    docs = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id bigint, text string, `bucket.x` string, kept int")
    got = minhash_dedup.dedup(docs).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == brute_near(rows)
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)
    more = docs.unionByName(docs.limit(5)).unionByName(spark.createDataFrame([(None, "x", None, None)] * 2, docs.schema))
    kept = minhash_dedup.survivors(more)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in kept.collect()) == [-1, -1, *sorted({c for _, c in brute_near(rows)})]
    null = [r for r in minhash_dedup.dedup(more).collect() if r.doc_id is None]
    assert [(r.class_id, r.kept) for r in null] == [(None, True)] * 2
    assert minhash_dedup.dedup(docs.limit(0)).count() == 0 and minhash_dedup.survivors(docs.limit(0)).count() == 0


def test_only_what_signatures_join_is_compared_exactly(spark):
    """A hot bucket of pages of one template, alike but no near-duplicates: their texts go nowhere."""
    r = np.random.default_rng(9)
    base = r.integers(0, 2**63, 700, dtype=np.uint64)
    sets = [np.concatenate([base[:400], r.integers(0, 2**63, 300, dtype=np.uint64)]) for _ in range(40)]
    sets.append(np.concatenate([sets[7][:650], r.integers(0, 2**63, 50, dtype=np.uint64)]))
    s = minhash_dedup.signatures(np.concatenate(sets), np.repeat(np.arange(41), 700), 41).astype("<u2")
    left = spark.createDataFrame([(5, k, k) for k in range(41)], "bucket bigint, key bigint, part bigint")
    sketches = spark.createDataFrame([(k, bytearray(x.tobytes())) for k, x in enumerate(s)], "key bigint, sketch binary")
    for tile in (2048, 4):
        assert sorted(x.key for x in minhash_dedup.near(left, sketches, tile).collect()) == [7, 40]


# lines
def brute_lines(rows, least=50, rare=20, rare_words=5):
    """(id, text) -> new text and sources, by looking at every pair of documents."""
    docs = sorted({(i, t) for i, t in rows if i is not None and t is not None})
    lines = {d: [(k, tuple(x.split())) for k, x in enumerate(d[1].split("\n")) if x.split()] for d in docs}

    def runs(x):
        size = [len(w) for _, w in x]
        for i in range(len(x)):
            ends = [e for e in range(i + 1, len(x) + 1) if sum(size[i:e]) >= least]
            starts = [s for s in range(i + 1) if sum(size[s : i + 1]) >= least]
            yield from [(i, e) for e in ends[:1]] + [(s, i + 1) for s in starts[-1:]]

    names, windows = {}, {}
    for d, x in lines.items():
        for w in {w for _, w in x}:
            names.setdefault(w, []).append(d)
        for r in {tuple(w for _, w in x[i:e]) for i, e in runs(x)}:
            names.setdefault(r, []).append(d)
        flat, at = [w for _, ws in x for w in ws], 0
        for k, w in x:
            for s in range(max(0, at + len(w) - least), min(at, len(flat) - least) + 1):
                if len(w) < least:
                    windows.setdefault((w, at - s, tuple(flat[s : s + least])), []).append((d, k))
            at += len(w)
    out = {d: (set(), set()) for d in docs}
    for d, x in lines.items():
        is_rare = lambda w: len(w) >= rare_words and len(names[w]) <= rare
        firsts = {}
        for w in {w for _, w in x}:
            if is_rare(w) and names[w][0] < d:
                firsts.setdefault(names[w][0], set()).add(w)
        for i, e in runs(x):
            if (f := names[tuple(w for _, w in x[i:e])][0]) < d:
                firsts.setdefault(f, set())
        b = [w for _, w in x]
        for f, evident in firsts.items():
            a = [w for _, w in lines[f]]
            for i in range(len(a)):
                for j in range(len(b)):
                    n = 0
                    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                        n += 1
                    if n and (sum(map(len, b[j : j + n])) >= least or evident & set(b[j : j + n])):
                        out[d][0].update(k for k, _ in x[j : j + n])
                        out[d][1].add(f[0])
    for held in windows.values():
        for d, k in held:
            if held[0][0] < d:
                out[d][0].add(k)
                out[d][1].add(held[0][0][0])
    return {d: ("\n".join(x for k, x in enumerate(d[1].split("\n")) if k not in gone), len(gone), sources) for d, (gone, sources) in out.items()}


def test_patience_blocks():
    assert line_dedup.patience([1, 2, 3, 4], [9, 2, 3, 8]) == [(1, 1, 2)]
    assert line_dedup.patience([1, 2, 3], [1, 2, 3]) == [(0, 0, 3)]
    assert line_dedup.patience([], [1]) == []
    a, b = [1, 5, 5, 2, 7, 3], [4, 1, 5, 2, 6, 3]
    blocks = line_dedup.patience(a, b)
    assert all(a[i : i + n] == b[j : j + n] for i, j, n in blocks) and sum(n for _, _, n in blocks) >= 4
    assert line_dedup._increasing([(0, 3), (1, 1), (2, 2), (3, 5)]) == [(1, 1), (2, 2), (3, 5)]


@given(st.lists(st.integers(0, 3), max_size=12), st.lists(st.integers(0, 4), max_size=12))
@settings(deadline=None, max_examples=300)
def test_common_blocks_against_brute_force(a, b):
    runs = {(j, n) for j in range(len(b)) for n in range(1, len(b) - j + 1) if any(a[i : i + n] == b[j : j + n] for i in range(len(a)))}
    longest = {(j, n) for j, n in runs if (j, n + 1) not in runs and (j - 1, n + 1) not in runs}
    assert sorted(line_dedup.moved(a, b)) == sorted(longest)
    assert all(a[i : i + n] == b[j : j + n] for i, j, n in line_dedup.patience(a, b))
    gone, _ = line_dedup.aligned(a, b, np.full(len(b), 10), {3}, 30)
    assert {int(k) for k in np.flatnonzero(gone)} == {k for j, n in runs if n >= 3 or 3 in b[j : j + n] for k in range(j, j + n)}


def test_aligned_takes_long_and_regular_documents():
    a, words = list(range(20000)), np.full(20000, 30)
    assert line_dedup.aligned(a, a[::-1], words, set())[0].sum() == 0  # 30 words each: no block
    assert line_dedup.aligned(a, a[10000:] + a[:10000], words, set())[0].all()
    assert line_dedup.aligned(a, a[::-1], np.full(20000, 60), set())[0].all()
    assert line_dedup.aligned([1, 2], [1, 2] * 10000, words, set())[0].all()
    assert line_dedup.aligned([1, 2] * 10000, [2, 1] * 10000, words, set())[0].all()


def line_corpus(seed):
    r = random.Random(seed)
    line = lambda n: " ".join(f"w{r.randrange(99999)}" for _ in range(n))
    hot, short, long_, some = line(70), "Read more", [line(20) for _ in range(3)], [line(r.randint(1, 18)) for _ in range(30)]
    rows = []
    for i in range(60):
        text = [line(r.randint(3, 80)) for _ in range(r.randint(1, 6))]
        if i % 3 == 0:
            text.insert(r.randrange(len(text) + 1), hot if i % 2 else "  " + hot + " ")
        if i % 7 == 0:
            at = r.randrange(len(text) + 1)
            text[at:at] = long_
        if i % 4 == 0:  # shared lines, in any order
            for _ in range(r.randint(1, 6)):
                at = r.randrange(len(text) + 1)
                text[at:at] = some[(k := r.randrange(30)) : k + r.randint(1, 5)]
        if i % 5 == 0:
            text.insert(0, short)
        if i % 11 == 0:
            text.insert(1, "")
        rows.append((i, "\n".join(text)))
    a, b = ("".join("ab"[k.bit_count() & 1 ^ x] for k in range(2048)) for x in (0, 1))
    rows += [(60, rows[4][1]), (61, rows[5][1] + "\n\n"), (62, ""), (63, None), (64, "\n"), (65, hot), (3, rows[3][1]), (66, a + " " + line(60)), (67, f"{line(9)}\n{b}"), (68, f"{line(9)}\n{a}")]
    return rows, hot


@pytest.mark.parametrize("least, rare, rare_words", [(50, 20, 5), (12, 2, 3), (30, 1, 5)])
def test_line_dedup_against_brute_force(spark, least, rare, rare_words):
    rows, hot = line_corpus(least)
    docs = spark.createDataFrame([(i, t, "c", 0) for i, t in rows] + [(None, hot, "n", 0)], "doc_id bigint, text string, `gone.x` string, n_removed_lines int")
    got = line_dedup.dedup(docs, least=least, rare=rare, rare_words=rare_words).select("row.doc_id", F.col("row.text").alias("old"), "text", "n_removed_lines", "source_ids").collect()
    assert len(got) == len(rows) + 1
    want = brute_lines(rows, least, rare, rare_words)
    assert sum(n for _, n, _ in want.values()) > 30
    for x in got:
        if x.doc_id is None or x.old is None:
            assert x.text == x.old and not x.n_removed_lines and not x.source_ids
        else:
            assert (x.text, x.n_removed_lines, set(x.source_ids)) == want[x.doc_id, x.old]
    out = line_dedup.deduplicated(docs)
    assert out.columns == docs.columns and out.count() == len(got)
    assert line_dedup.dedup(docs.limit(0)).count() == 0


def test_passages_that_start_or_end_inside_a_line(spark):
    r = random.Random(9)
    words = lambda n: " ".join(f"w{r.randrange(99999)}" for _ in range(n))
    a, b, c, d, own = words(30), words(9), words(25), words(21), [words(40) for _ in range(12)]
    rows = [
        (0, f"{own[0]}\n{b}\n{own[1]}"),  # holds the short line first, without the passage
        (1, f"{own[2]} {a}\n{b}\n{c} {own[3]}"),
        (2, f"{own[4]} {a}\n {b}\n{c} {own[5]}"),
        (3, f"{own[6]}\n{b}\n{c} {own[7]}"),  # 34 common words are no passage
        (4, f"{own[8]} {a} {b} {c} {own[9]}\nx"),  # all inside one line
        (5, f"{own[10]} {d}\n{c}\n{' '.join(c.split()[:3])} {own[11]}"),
        (6, f"{words(40)} {d}\n{c}\n{' '.join(c.split()[:3])} {words(40)}"),  # 21 + 25 + 3 words
        (7, f"{words(40)} x {d}\n{c}\n{' '.join(c.split()[:3])} {own[11].split()[0]} {words(40)}"),  # one word more, in common with 5 only
    ]
    got = {x.doc_id: x for x in line_dedup.dedup(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), rare=0).select("row.doc_id", "text", "n_removed_lines", "source_ids").collect()}
    lines = rows[2][1].split("\n")
    assert (got[2].text, got[2].n_removed_lines, got[2].source_ids) == (f"{lines[0]}\n{lines[2]}", 1, [1])
    assert (got[7].n_removed_lines, got[7].source_ids) == (1, [5]) and c not in got[7].text.split("\n")
    assert all(got[i].text == t and not got[i].source_ids for i, t in rows if i not in (2, 7))


def test_very_long_documents(spark):
    """Megabytes in one row: a near copy with changed lines, and a small document with a passage of it."""
    r = random.Random(12)
    lines = [" ".join(f"w{r.randrange(99999)}" for _ in range(r.randint(4, 20))) for _ in range(25000)]
    copy = list(lines)
    for k in range(0, 25000, 500):
        copy[k] = f"other words {k} that stand here alone"
    few = [*lines[700:720], "and words of its own"]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(copy)), (3, "\n".join(few))], "doc_id bigint, text string")
    got = {x.doc_id: x for x in line_dedup.dedup(docs).select("row.doc_id", "text", "n_removed_lines", "source_ids").collect()}
    assert got[1].n_removed_lines == 0 and got[3].text == few[-1] and got[3].source_ids == [1]
    assert got[2].text.split("\n") == [x for x in copy if x.startswith("other")]
    assert {x.doc_id: x.class_id for x in minhash_dedup.dedup(docs).collect()} == {1: 1, 2: 1, 3: 3}

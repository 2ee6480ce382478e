"""Vector codes, ranked search and toxicity against plain models."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from helpers import SCHEMA, documents  # noqa: E402

from linesift.llm import ball_search, part_codes, toxicity  # noqa: E402
from linesift.llm.common import Scratch  # noqa: E402


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# 11 --------------------------------------------------------------------------------------------------------------

def brute_nearest(x, entries):
    best = [min((sum((a - b) ** 2 for a, b in zip(row, e)), k) for k, e in enumerate(entries)) for row in x]
    return [k for _, k in best], [d for d, _ in best]


@pytest.mark.parametrize("shift", [None, 0, 3, 9])
def test_cells_keep_the_nearest(shift):
    rng = np.random.default_rng(2)
    entries = rng.integers(-40, 40, (60, 5)) * rng.choice([1, 9], (60, 1))
    entries[7] = entries[3]                                  # ties go to the lower index
    x = np.concatenate([rng.integers(-60, 60, (300, 5)), entries, entries, np.full((2, 5), 1 << 27), np.full((1, 5), -(1 << 27))])
    grid = part_codes.Grid(entries, shift)
    index, distance = grid.nearest(x)
    again = grid.filled
    want = brute_nearest(x.tolist(), entries.tolist())
    assert index.tolist() == want[0] and distance.tolist() == want[1]
    assert grid.nearest(x)[0].tolist() == want[0] and grid.filled == again       # the second time every cell is known


def test_cells_save_evaluations():
    rng = np.random.default_rng(0)
    x = np.repeat(rng.integers(-400, 400, (500, 16)), 4, axis=0)
    grid = part_codes.Grid(x[::8][:200].copy())
    grid.nearest(x)
    assert grid.filled <= 500 and grid.evaluated < 0.5 * len(x) * 200


def brute_codes(rows, entries, rounds=4, parts=4):
    kept = [r for r in rows if r[1] is not None and all(v is not None and math.isfinite(v) for v in r[1])]
    first = {}
    for i, v, _ in kept:
        if i is not None:
            first[i] = min(v, first.get(i, v))
    dim = len(first[min(first)]) if first else None
    most = part_codes.limit(dim, parts) if first else 0
    cut = part_codes.bounds(dim or 0, parts)

    def ints(v):
        return [math.floor(1024 * c) for c in v] if len(v) == dim and all(abs(c) * 1024 < most for c in v) else None

    ids = [i for i in sorted(first) if len(first[i]) == dim][:entries]
    start = [ints(first[i]) for i in ids]
    books = [[v[cut[p]:cut[p + 1]] for v in start if v] for p in range(parts)]
    xs = [ints(v) for _, v, _ in kept]
    for r in range(rounds + 1):
        found = [brute_nearest([x[cut[p]:cut[p + 1]] for x in xs if x], books[p]) for p in range(parts)]
        if r < rounds:
            for p in range(parts):
                own = {}
                for k, x in zip(found[p][0], [x for x in xs if x]):
                    own.setdefault(k, []).append(x[cut[p]:cut[p + 1]])
                for k, members in own.items():
                    books[p][k] = [sum(c) // len(members) for c in zip(*members)]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out, j = [], 0
    for (i, _, label), x in zip(kept, xs):
        if x is None:
            out.append([i, None, None, label])
        else:
            out.append([i, "".join(f"{found[p][0][j]:02x}" for p in range(parts)), sum(found[p][1][j] for p in range(parts)), label])
            j += 1
    sums = Counter()
    for _, _, e, label in out:
        sums[label] += e or 0
    return [(i, c, e, sums[label] if any(x[2] is not None for x in out if x[3] == label) else None, sha) for i, c, e, label in out]


@pytest.mark.parametrize("dim,entries", [(24, 256), (10, 7)])
def test_codes(spark, dim, entries):
    rnd = random.Random(dim)
    centres = [[rnd.gauss(0, 1) for _ in range(dim)] for _ in range(9)]
    rows = [(i, [c + rnd.gauss(0, .2) for c in rnd.choice(centres)], rnd.choice([0, 1, None])) for i in range(400)]
    rows += [(400 + i, list(rows[0][1]), 3) for i in range(40)]                                      # copies
    rows += [(500, None, 1), (501, [None] * dim, 1), (502, [float("nan")] * dim, 1), (503, [1.0] * (dim - 1) + [float("inf")], 0),
             (504, [], 1), (505, [1.0, 2.0], 4), (506, [1e30] * dim, 1), (507, [-0.0] * dim, None), (None, [0.5] * dim, 0), (3, [9.0] * dim, 0)]
    rows += [rows[7], rows[7]]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, code string, id int").repartition(6)
    got = rows_of(part_codes.encode_vectors(df, entries=entries))
    assert sorted(got, key=str) == sorted(brute_codes(rows, entries), key=str)


def test_codes_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert rows_of(part_codes.encode_vectors(df)) == []
    odd = spark.createDataFrame([(None, [1.0, 2.0], 1), (1, None, 1)], "vec_id long, embedding array<float>, label int")
    assert [r[:4] for r in rows_of(part_codes.encode_vectors(odd))] == [(None, None, None, None)]


# 12 --------------------------------------------------------------------------------------------------------------

def plain_terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute_search(docs, items, k=20):
    """docs (id, text), items (id, text): rows (item, rank, doc, score)."""
    bags = [(i, Counter(plain_terms(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n_docs, total = len(bags), sum(n for *_, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in set(items):
        asked, found = Counter(plain_terms(text)), []
        for i, b, n in bags:
            m = 75 + 25 * n * n_docs // total
            s = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * b[t] // (1000 * b[t] + 12 * m))
                    for t, c in asked.items() if t in b)
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(found, key=lambda x: x[:3])[:k])]
    return out


@pytest.mark.parametrize("small", [False, True])
def test_ranked_search(spark, monkeypatch, small):
    if small:
        for name, value in (("SEED_DOCS", 10), ("CHUNK_DOCS", 30), ("LEAF", 3), ("GROUP_ITEMS", 2)):
            monkeypatch.setattr(ball_search, name, value)
        monkeypatch.setattr(ball_search.Block.__init__, "__defaults__", (2,))
        monkeypatch.setattr(ball_search.BallTree.__init__, "__defaults__", (3,))
    rows = documents()
    texts = [r[1] for r in rows if r[1]]
    rnd = random.Random(4)
    items = [(k, " ".join(rnd.choice(texts).split()[:40])) for k in range(9)] + \
        [(100, None), (101, ""), (102, "nothing-like-this zzzzz"), (103, "word word WORD"), (103, "one"), (103, "one"), (None, "Ärger the of"), (104, "oté ?!")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    asked = spark.createDataFrame([(*x, 5, "s") for x in items], "item_id long, text string, rank int, score string")
    for k in (20, 3):
        got = rows_of(ball_search.ranked_search(docs, asked, k=k, block_items=4 if small else 2000))
        want = brute_search([(r[0], r[1]) for r in rows], [x for x in items if x[1] is not None], k)
        assert sorted(got, key=str) == sorted(want, key=str)
    assert rows_of(ball_search.ranked_search(docs.limit(0), asked)) == []
    assert rows_of(ball_search.ranked_search(docs, asked.limit(0))) == []


def test_balls_prune_and_lose_nothing():
    rng = np.random.default_rng(1)
    n_terms, rows = 60, 3000
    part = rng.integers(0, 4, rows)
    x = np.where(rng.random((rows, n_terms)) < 0.15, rng.integers(1, 1000, (rows, n_terms)), 0)
    x[np.arange(n_terms)[None, :] // 15 != part[:, None]] = 0                # four languages
    x[:, 0] += 1
    x[100:140] = x[100]                                                      # copies
    asked = [(np.sort(rng.choice(15, 9, replace=False)) + 15 * (k % 4), rng.integers(1, 3, 9)) for k in range(4)] + \
        [(np.flatnonzero(x[100]), np.ones(np.count_nonzero(x[100]), np.int64))]
    for k in range(4):                                                       # passages of the items
        x[500 + 20 * k:515 + 20 * k, asked[k][0]] = 1000
    r, t = np.nonzero(x)
    tree = ball_search.BallTree(np.searchsorted(r, np.arange(rows + 1)), t, x[r, t], n_terms)
    items, dense = ball_search.Items(asked, n_terms), np.zeros(n_terms, np.int64)
    for q, (term, count) in enumerate(asked):
        scores = x[:, term] @ count
        edge = np.sort(scores)[-10]
        found = tree.search(items, q, 1, 10, dense)
        assert {(int(scores[i]), i) for i in np.flatnonzero(scores >= edge)} <= set(found)
        assert all(scores[i] == s for s, i in found) and not dense.any()
    assert tree.scored < 0.6 * rows * len(asked)


# 13 --------------------------------------------------------------------------------------------------------------

def test_machine_scores_pairs():
    rng = np.random.default_rng(0)
    m = toxicity.Machine(6)
    m.w0, m.w, m.v = 0.3, rng.standard_normal(7), rng.standard_normal(m.v.shape)
    rows = [(np.array([0, 2, 5]), np.array([1.0, 0.5, 2.0])), (np.array([6]), np.zeros(1)), (np.array([1, 3]), np.array([3.0, 1.0]))]
    want = [0.3 + sum(m.w[i] * a for i, a in zip(s, v)) + sum(m.v[s[a]] @ m.v[s[b]] * v[a] * v[b] for a in range(len(s)) for b in range(a))
            for s, v in rows]
    assert np.allclose(m.raw(*toxicity.joined(rows))[0], want)


def test_machine_learns_what_weights_cannot():
    """Two terms are toxic together or not at all; apart they are not."""
    rng = np.random.default_rng(5)
    rows, label = [], []
    for _ in range(3000):
        a, b = rng.integers(0, 2, 2)
        rows.append((np.array([0 + a, 2 + b]), np.ones(2)))
        label.append(float(a == b))
    m = toxicity.Machine(4).fit(rows, np.array(label), rounds=20)
    p = toxicity.logistic(m.raw(*toxicity.joined(rows))[0])
    assert ((p >= 0.5) == np.array(label)).all()


def test_terms_of_texts():
    b, v = toxicity.term_values("The the, idiots IDIOTIC ähnlich!".encode())
    same, _ = toxicity.term_values("the THE idiots. idiotic; ähnlich".encode())
    assert b.tolist() == same.tolist() and len(np.unique(b)) == len(b)
    want = len({"the", "idiots", "idiotic", "ähnlich"}) + len({(n, w[:n]) for w in ("idiots".encode(), b"idiotic", "ähnlich".encode())
                                                               for n in (5, 6, 7) if len(w) >= n})
    assert len(b) == want
    assert [len(toxicity.term_values(t)[0]) for t in (b"", b" \n.!", b"\x00")] == [0, 0, 0]
    long, _ = toxicity.term_values(b"a word " * 100_000)
    assert long.tolist() == sorted(toxicity.term_values(b"word a")[0].tolist())


def corpus(n=1500, seed=2):
    """Toxic texts insult a group; insults alone and groups alone are clean."""
    rnd = random.Random(seed)
    vocab = [a + b for a in ("ba", "ro", "ti", "mel", "sun", "kor") for b in ("na", "lo", "rim", "tes", "gu")]
    docs, labels = [], []
    for i in range(n):
        w = [rnd.choice(vocab) for _ in range(rnd.randint(20, 60))]
        insult, group = rnd.random() < 0.5, rnd.random() < 0.5
        for word, put in ((rnd.choice(["idiot", "scum"]), insult), (rnd.choice(["northerners", "farmers"]), group)):
            for _ in range(3 if put else 0):
                w.insert(rnd.randrange(len(w)), word)
        docs.append((i, " ".join(w), "en", "s", 5, 0.5, 1))
        labels.append((i, 1, int(insult and group)))
    return docs, labels


DOCS = "doc_id long, text string, lang string, source string, toxic int, score double, label int"


def test_toxicity_on_held_out_documents(spark):
    docs, labels = corpus()
    odd = [(9000, None), (9001, ""), (9002, " \n\t"), (None, "idiot northerners " * 5), (9003, "idiot farmers " * 20_000), (3, docs[3][1])]
    docs += [(i, t, "en", None, None, None, None) for i, t in odd]
    known = labels + [(None, 1, 1), (9100, 1, 1), (9101, 1, None), (labels[4][0], 1, labels[4][2])]
    d = spark.createDataFrame(docs, DOCS).repartition(5)
    y = spark.createDataFrame(known, "doc_id long, quality int, toxic int")
    got = rows_of(toxicity.score_toxicity(d, y))
    assert len(got) == len(docs)
    truth = {i: t for i, _, t in labels}
    for i, held, score, predicted in got:
        assert held == (zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0)
        assert 0 <= score <= 1 and predicted == int(score >= 0.5)
    test = [(p, truth[i]) for i, held, _, p in got if held and i in truth]
    assert len(test) > 200 and sum(p == t for p, t in test) >= 0.95 * len(test)
    by_id = {i: (s, p) for i, _, s, p in got}
    assert by_id[9000] == by_id[9001] == by_id[9002] and by_id[9000][1] == 0
    assert by_id[9003][1] == 1 and by_id[None][1] == 1
    assert rows_of(toxicity.score_toxicity(d, y)) != [] and sorted(got, key=str) == sorted(rows_of(toxicity.score_toxicity(d, y)), key=str)
    # what held-out labels say changes nothing
    flipped = [(i, q, 1 - t if i is not None and t is not None and zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in known]
    again = rows_of(toxicity.score_toxicity(d, spark.createDataFrame(flipped, "doc_id long, quality int, toxic int")))
    assert sorted(again, key=str) == sorted(got, key=str)


def test_toxicity_without_classes(spark):
    d = spark.createDataFrame(corpus(20)[0], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r[2:] for r in rows_of(toxicity.score_toxicity(d, none))} == {(0.0, 0)}
    ones = spark.createDataFrame([(i, 1, 1) for i in range(20)], "doc_id long, quality int, toxic int")
    assert {r[2:] for r in rows_of(toxicity.score_toxicity(d, ones))} == {(1.0, 1)}
    assert rows_of(toxicity.score_toxicity(d.limit(0), ones)) == []


def test_term_selection_bounds_the_sample(spark):
    docs, labels = corpus(300)
    d, y = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    x = d.selectExpr("doc_id AS id", "CAST(text AS BINARY) AS text")
    machine, slots, _ = toxicity._learn(x, y, Scratch(spark, "t"), "doc_id", "toxic", 100)
    assert machine is not None and 0 < (slots >= 0).sum() <= toxicity.TERMS


# helpers ---------------------------------------------------------------------------------------------------------

def test_row_filter_loses_nothing(spark):
    from pyspark.sql import functions as F

    from linesift.llm.common import likely_rows
    df = spark.range(20_000).withColumnRenamed("id", "_word")
    keys = df.where("_word % 50 = 7")
    got = {r[0] for r in likely_rows(df, F.xxhash64("_word"), keys, F.xxhash64("_word"), 400).collect()}
    assert {k for k in range(20_000) if k % 50 == 7} <= got and len(got) < 1000
    assert likely_rows(df, F.xxhash64("_word"), keys, F.xxhash64("_word"), 1 << 40) is df

"""Each operator against a plain model on small tables with odd cases."""

from __future__ import annotations

import json
import math
import os
import random
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from helpers import SCHEMA, classes, documents, jaccard_classes, shingle_set, words  # noqa: E402

from linesift.llm import (embedding_dedup, hmm_scoring, importance, jaccard_join, line_templates, packing, quality_rules,  # noqa: E402
                          source_mixing, url_filters, warc_revisits)
from linesift.llm.common import Scratch  # noqa: E402


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# 1 ---------------------------------------------------------------------------------------------------------------

def test_automaton_against_regular_expressions():
    import re
    rnd = random.Random(1)
    globs = ["".join(rnd.choice(["a", "b", "/", "*", "**", "."]) for _ in range(rnd.randint(1, 40))) for _ in range(40)]
    texts = ["".join(rnd.choice("ab/.") for _ in range(rnd.randint(0, 30))).encode() for _ in range(300)] + [b""]
    auto = url_filters.Automaton(globs)
    assert auto.words > 1
    found = auto.match(texts)
    for k, g in enumerate(globs):
        pattern = re.compile(b"".join({"**": b".*", "*": b"[^/]*"}.get(p, re.escape(p.encode())) for p in re.findall(r"\*\*|\*|.", g)), re.S)
        assert [bool(pattern.fullmatch(t)) for t in texts] == found[:, k].tolist(), g


def test_url_rules(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    cases = {
        "http://a.Example.NET/en/x?q=/de/": ("a.example.net", "/en/x", "example.net/en/", "allow"),
        "http://example.net/EN/": ("example.net", "/EN/", "net/", "block"),
        "http://example.net": ("example.net", "", None, "allow"),
        "http://badexample.com/de/1": ("badexample.com", "/de/1", None, "allow"),
        "//x://example.com/de/": ("example.com", "/de/", "example.com/de/", "block"),
        "http://x.org/fr/a#b": ("x.org", "/fr/a", "org/fr/", "allow"),
        "http://foo.com/x.net/y": ("foo.com", "/x.net/y", None, "allow"),
        "no url": ("", "", None, "allow"), "": ("", "", None, "allow"), None: ("", "", None, "allow"),
        "http://" + "a." * 5000 + "net/" + "x" * 9000: ("a." * 5000 + "net", "/" + "x" * 9000, "net/", "block"),
    }
    data = [(i, u, "x", "y") for i, u in enumerate(cases)] + [(0, "http://a.Example.NET/en/x?q=/de/", "x", "y")]
    df = spark.createDataFrame(data, "page_id long, url string, host string, rule string")
    got = rows_of(url_filters.filter_urls(df, rules))
    assert sorted(got, key=str) == sorted([(i, *cases[u]) for i, u, *_ in data], key=str)
    assert url_filters.filter_urls(df.limit(0), rules).count() == 0


# 2 ---------------------------------------------------------------------------------------------------------------

def vectors(seed=0, n=900, dim=24):
    rng = np.random.default_rng(seed)
    out = []
    centres = rng.standard_normal((30, dim))
    for i in range(n):
        c = centres[i % 30]
        v = rng.standard_normal(dim) if i % 3 else c + rng.standard_normal(dim) * rng.choice([0.05, 0.15, 0.3])
        out.append((i, [float(np.float32(x)) for x in v], int(i % 2 if i % 7 else 0)))
    clump = rng.standard_normal(dim)
    for i in range(n, n + 150):
        out.append((i, [float(np.float32(x)) for x in clump + rng.standard_normal(dim) * 0.1], 0))
    for _ in range(40):
        out.append((len(out), out[3][1], out[3][2]))
    for v, label in (([0.0] * dim, 0), (None, 0), ([], 0), ([1.0] * dim, None), ([float("nan")] + [1.0] * (dim - 1), 0), ([None] + [1.0] * (dim - 1), 0),
                     ([float("inf")] + [1.0] * (dim - 1), 0), ([1.0, 2.0], 0), ([2.0, 4.0], 0), ([3e38] * dim, 1), ([1e-38] * dim, 1)):
        out.append((len(out), v, label))
    return out


def brute_vectors(rows, threshold=0.93):
    ok = {}
    for i, v, label in rows:
        if label is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        x = np.array(v) / max(abs(y) for y in v)
        ok[i] = (label, x / np.sqrt((x * x).sum()))
    groups = defaultdict(list)
    for i, (label, x) in ok.items():
        groups[label, len(x)].append(i)
    links = []
    for ids in groups.values():
        m = np.array([ok[i][1] for i in ids])
        a, b = np.nonzero(np.triu(m @ m.T >= threshold, 1))
        links += [(ids[x], ids[y]) for x, y in zip(a, b)]
    n = Counter(x for p in links for x in p)
    root = classes([r[0] for r in rows], links)
    return {i: (n[i], root[i], root[i] == i) for i, *_ in rows}, len(links)


def test_embedding_groups(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    expected, links = brute_vectors(rows)
    exact = embedding_dedup.near_duplicates(df)                    # one leaf for each label would do: all pairs
    assert {r[0]: r[1:] for r in rows_of(exact)} == expected
    small = {r[0]: r[1:] for r in rows_of(embedding_dedup.near_duplicates(df, leaf=64))}
    found = sum(v[0] for v in small.values()) / 2
    assert all(small[i][0] <= expected[i][0] for i in small)       # nothing below the threshold, nothing twice
    assert found >= 0.97 * links
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_links_of_a_concentrated_label(spark):
    """Vectors with a common direction (mean cosine 0.9): pairs at the threshold share a leaf, however large the label."""
    n, dim, pairs = 100_000, 64, 1000
    rng = np.random.default_rng(3)
    common = np.zeros(dim)
    common[0] = 3
    x = embedding_dedup.unit(common + rng.standard_normal((n, dim)) / math.sqrt(dim))
    step = rng.standard_normal((pairs, dim))
    step -= (step * x[:pairs]).sum(axis=1, keepdims=True) * x[:pairs]
    x[pairs:2 * pairs] = 0.935 * x[:pairs] + math.sqrt(1 - 0.935 ** 2) * embedding_dedup.unit(step)
    table = pa.table({"node": pa.array(np.arange(n)), "label": pa.array(np.zeros(n, np.int64)), "dim": pa.array(np.full(n, dim, np.int32)),
                      "v": pa.ListArray.from_arrays(np.arange(0, n * dim + 1, dim, dtype=np.int32), x.astype(np.float32).ravel())})
    nodes = spark.createDataFrame(table).repartition(8)
    leaves = embedding_dedup.forest(nodes, Scratch(spark, "concentrated"), threshold=0.93).where(f"node < {2 * pairs}").toPandas()
    codes = leaves.groupby("node")["code"].agg(set)
    assert sum(bool(codes[k] & codes[pairs + k]) for k in range(pairs)) >= 0.995 * pairs


def test_trees_follow_levels():
    for levels in (1, 8, 15, 24, 32):
        parted = 1 - (1 - embedding_dedup.CHANCE) ** levels
        assert parted ** embedding_dedup.trees_for(levels) <= embedding_dedup.MISS
    assert embedding_dedup.trees_for(32) > embedding_dedup.trees_for(8)


# 3 ---------------------------------------------------------------------------------------------------------------

def brute_lines(rows):
    """rows: (doc_id, text) -> cleaned text, by comparing template strings."""
    keys = defaultdict(set)
    per = {}
    for d, t in set(rows):
        for i, line in enumerate((t or "").split("\n")):
            w = ["<*>" if any(c in "0123456789@" for c in x) or "://" in x else x for x in (y.decode() for y in line.encode().split())]
            n = len(w)
            if n < 3:
                found = []
            elif n < 8:
                found = [(n, None, tuple(w))] if n - w.count("<*>") >= 3 else []
            else:
                found = []
                for p in range(4):
                    a, b = 2 + (n - 2) * p // 4, 2 + (n - 2) * (p + 1) // 4
                    if sum(x != "<*>" for x in w[:a] + w[b:]) >= 3:
                        found.append((n, p, tuple(w[:a]) + ("<*>",) + tuple(w[b:])))
            per[d, t, i] = found
            for k in found:
                keys[k].add(math.inf if d is None else d)
    out = {}
    for d, t in rows:
        if t is None:
            out[d, t] = None
            continue
        own = math.inf if d is None else d
        stay = []
        for i, line in enumerate(t.split("\n")):
            if not any(len(keys[k]) >= (5 if k[1] is None else 2) and min(keys[k]) != own for k in per[d, t, i]):
                stay.append(line)
        out[d, t] = "\n".join(stay)
    return out


def test_line_dedup(spark):
    rows = documents()
    notice = "Contact us at 4/2/{} or a{}@b.de for more of this offer today please"
    rows += [(500 + i, f"unique {i} text number here\n" + notice.format(i, i) + "\nAll rights reserved.", "en", "s", 1, "k", 1, "h", 7) for i in range(6)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = line_templates.drop_recurring(df, n_lines="_n", n_dropped="_d")
    assert got.columns == df.columns + ["_n", "_d"]
    expected = brute_lines([r[:2] for r in rows])
    found = rows_of(got.select("doc_id", "text", "kept", "_h"))
    assert sorted(found, key=str) == sorted([(r[0], expected[r[0], r[1]], "k", "h") for r in rows], key=str)
    assert sum("All rights" in (t or "") for d, t, *_ in found if d and d >= 500) == 1
    assert sum("offer" in (t or "") for d, t, *_ in found if d and d >= 500) == 1
    assert line_templates.drop_recurring(df.limit(0)).count() == 0


def test_line_dedup_counts_documents(spark):
    """Repeated rows are one document; texts without id are documents of their own."""
    rows = [(1, "one short line here")] * 4 + [(2, "one short line here\nother words stand alone")] + [(1, "one short line here\nmore of document one")]
    rows += [(None, f"t{c} alone\nthis longer passage is shared by rows without any id at all") for c in "abc"] * 2
    got = sorted(rows_of(line_templates.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string"))), key=str)
    assert [r for r in got if r[0]] == sorted([r for r in rows if r[0]], key=str)
    texts = [t for d, t in got if d is None]
    assert len(texts) == 6 and len({t for t in texts if "passage" in t}) == 1 and sum("passage" in t for t in texts) == 2


# 4 ---------------------------------------------------------------------------------------------------------------

def test_jaccard_components(docs, empty):
    rows = [r for r in documents() if r[0] is not None]
    expected = jaccard_classes([(r[0], r[1]) for r in dict((r[0], r) for r in rows).values()])
    got = rows_of(jaccard_join.jaccard_components(docs))
    assert len(got) == docs.count()
    for d, n, c in got:
        if d is None:
            assert c is None
        else:
            assert (n, c) == (len(shingle_set(rows[d][1])), expected[d]), d
    assert jaccard_join.jaccard_components(empty).count() == 0


def test_jaccard_big_blocks(spark, monkeypatch):
    """A block far over the bound is compared by pairs of chunks."""
    rnd = random.Random(5)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(250):
        w = list(base)
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(60)] = f"n{rnd.randrange(50)}"
        rows.append((i, " ".join(w[:rnd.randint(45, 60)])))
    monkeypatch.setattr(jaccard_join, "TASK_SHINGLES", 1500)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = jaccard_classes(rows)
    assert 1 < len(set(expected.values())) < 250
    assert {r[0]: r[2] for r in rows_of(jaccard_join.jaccard_components(df))} == expected


def test_one_document_of_each_group_stays(docs):
    out = jaccard_join.keep_one_of_each(docs)
    assert out.columns == docs.columns
    got = [r["doc_id"] for r in out.collect()]
    rows = dict((r[0], r) for r in documents() if r[0] is not None)
    expected = jaccard_classes([(d, r[1]) for d, r in rows.items()])
    stay = {d for d, c in expected.items() if d == c}
    assert set(got) - {None} == stay
    # a repeated row stays once, unless it has no words
    assert Counter(got)[5] == 1


# 5 ---------------------------------------------------------------------------------------------------------------

def brute_statistics(text):
    import re
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics(spark):
    rows = documents()
    rows += [(900, "a b c d e f a b c d e x y z " * 3 + "\nq\n q\nq\n\n\t\n", "en", "s", 0, "k", 1, "h", 7)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = quality_rules.judge(df)
    by = defaultdict(list)
    for r in got.collect():
        by[r["doc_id"]].append(r)
    for r in rows:
        n, chars, symbols, dup, repeat = brute_statistics(r[1])
        x = by[r[0]][0]
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == (n, chars, symbols, dup, repeat), r
        assert x["base_failed"] == (n < 10 or 100 * repeat > 20 * n)
        assert not (x["kept"] and x["base_failed"])
    assert quality_rules.judge(df.limit(0)).count() == 0


def test_blank_lines_of_every_separator(spark):
    texts = ["\f\nword\n\f\n\f", "f\nf\n f \nword", "\n".join([" ", "\t", "\v", "\f", "\r", " \t\v\f\r", "f"])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_lines"], r["n_dup_lines"]) for r in quality_rules.text_statistics(df, "text", ["doc_id"]).collect()}
    assert got == {0: (1, 0), 1: (4, 1), 2: (1, 0)}


def test_quality_outliers_against_numpy(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(400):
        junk = i % 9 == 0
        w = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 9))) + ("%%%" if junk else "") for _ in range(rnd.randint(30, 200))]
        rows.append((i, " ".join(w), "en" if i % 4 else None, "big" if i % 3 else f"small{i % 50}"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in quality_rules.judge(df).collect()}
    x = {}
    for d, t, *_ in rows:
        n, chars, symbols, dup, repeat = brute_statistics(t)
        v = (math.log((chars + 250) / (n + 50)), math.log(1 + 10 * symbols / (n + 10)), dup / (t.count("\n") + 1 + 4), repeat / (n + 50))
        x[d] = np.floor(np.array(v) * 1024 + 0.5)
    usable = [r for r in rows if not got[r[0]]["base_failed"]]
    count = Counter((r[2], r[3]) for r in usable)
    langs = Counter(r[2] for r in usable if count[r[2], r[3]] < 40)
    rest = sum(n for k, n in langs.items() if n < 40)

    def group(r):
        if count[r[2], r[3]] >= 40:
            return r[2], r[3]
        return ("lang", r[2]) if langs[r[2]] >= 40 else "rest" if rest >= 40 else None

    groups = defaultdict(list)
    for r in usable:
        groups[group(r)].append(r[0])
    scale = np.array(quality_rules.SCALES)
    for g, ids in groups.items():
        if g is None:
            continue
        v = np.array([x[d] for d in ids]) / 1024
        mean, cov = np.sort(v, axis=0)[(len(v) - 1) // 2], np.diag(scale ** 2)
        for step in range(quality_rules.STEPS):
            d2 = np.einsum("ij,jk,ik->i", v - mean, np.linalg.inv(cov), v - mean)
            bins = np.floor(32 * np.log(d2 + 1e-6))
            near = np.array([(bins < b).sum() < 0.75 * len(v) for b in bins])
            factor = quality_rules.CONSISTENCY if step == quality_rules.STEPS - 1 else 1.0
            mean, cov = v[near].mean(axis=0), factor * np.cov(v[near].T, bias=True) + np.diag(scale ** 2)
        d2 = np.einsum("ij,jk,ik->i", v - mean, np.linalg.inv(cov), v - mean)
        for d, y in zip(ids, d2):
            assert got[d]["distance"] == pytest.approx(y, rel=1e-6, abs=1e-9)
            assert got[d]["kept"] == (y <= quality_rules.CUTOFF)
    assert all(got[r[0]]["kept"] == (r[0] % 9 != 0) for r in usable if group(r) == ("en", "big"))


def test_quality_stage_keeps_columns(docs):
    out = quality_rules.keep_good(docs)
    assert out.columns == docs.columns
    kept = Counter(r["doc_id"] for r in quality_rules.judge(docs).where("kept").collect())
    assert Counter(r["doc_id"] for r in out.collect()) == kept


# 6 ---------------------------------------------------------------------------------------------------------------

def test_revisits(spark):
    rnd = random.Random(8)
    rows = []
    for i in range(600):
        url = rnd.choice(["http://www.a.com/x/?utm_source=1&b=2&a=1#f", "https://A.com:443/x?a=1&b=2", "http://b.org/y", None, "nothing"]) \
            if i % 4 else "http://hot.net/"
        tag = rnd.choice(['"1"', 'W/"1"', '"2"', None])
        h = {k: v for k, v in (("ETag" if i % 2 else "etag", tag), ("Last-Modified", rnd.choice(["mon", "tue", None])), ("Content-Length", str(i)),
                               ("X-A", str(i))) if v is not None}
        rows.append((i, rnd.choice(["response", "revisit", "request"]), None if i % 50 == 3 else rnd.randrange(200), url, None if i % 90 == 7 else h))
    df = spark.createDataFrame(rows, "record_id long, warc_type string, warc_date long, uri string, headers map<string,string>").repartition(6)

    def canon(u):
        return {"http://www.a.com/x/?utm_source=1&b=2&a=1#f": "a.com/x?a=1&b=2", "https://A.com:443/x?a=1&b=2": "a.com/x?a=1&b=2",
                "http://b.org/y": "b.org/y", "http://hot.net/": "hot.net"}.get(u)

    expected = {}
    for i, kind, t, u, h in rows:
        if kind != "revisit":
            continue
        own = {k.lower(): v for k, v in (h or {}).items()}
        best = max(((x[2], x[0], x) for x in rows if x[1] == "response" and canon(x[3]) == canon(u) and canon(u) and t is not None
                    and x[2] is not None and x[2] < t), default=None)
        if not best:
            status = "no_response"
        else:
            theirs = {k.lower(): v for k, v in (best[2][4] or {}).items()}
            plain = lambda x: x and x.removeprefix("W/")
            if "etag" in own:
                status = "resolved" if plain(own["etag"]) == plain(theirs.get("etag")) else "etag_mismatch"
            elif "last-modified" in own:
                status = "resolved" if own["last-modified"] == theirs.get("last-modified") else "date_mismatch"
            else:
                status = "no_validator"
            if status == "resolved":
                own = {**theirs, **{k: v for k, v in own.items() if k != "content-length"}}
        expected[i] = (canon(u), status, best and best[1], own)
    got = {r["record_id"]: tuple(r)[1:] for r in warc_revisits.resolve_revisits(df, parts=7).collect()}
    assert got == expected
    assert {v[1] for v in expected.values()} == {"resolved", "no_response", "etag_mismatch", "date_mismatch", "no_validator"}
    assert warc_revisits.resolve_revisits(df.limit(0)).count() == 0


# 7 ---------------------------------------------------------------------------------------------------------------

def test_water_filling():
    assert source_mixing.targets([10, 10], [1, 1]) == [15, 15]
    t = source_mixing.targets([10, 100, 50], [3, 1, 2])
    assert sum(t) == pytest.approx(240) and t[0] == 20 and t[1] / t[2] == pytest.approx(0.5) or t[2] == 100
    assert source_mixing.targets([], []) == [] and source_mixing.targets([0, 0], [1, 2]) == [0, 0]


def test_quota_tree():
    have = np.array([7, 0, 100, 33], np.int64)
    q = source_mixing.split_quotas(have, 5, 1)
    assert (q.sum(axis=0) == have).all() and abs(q.sum(axis=1) - 28).max() <= 1
    assert (q == source_mixing.split_quotas(have, 5, 1)).all()


def test_subtrees_are_the_tree():
    have = np.array([70, 3, 1000, 333], np.int64)
    whole = source_mixing.split_quotas(have, 53, 9)
    parts = source_mixing.split_tree((0, 53, have), 9, 7)
    assert all(hi - lo <= 7 for lo, hi, _ in parts) and len(parts) > 7
    assert np.array_equal(whole, np.concatenate([[h for _, _, h in source_mixing.split_tree(p, 9)] for p in parts]))


def test_quotas_follow_the_hypergeometric_distribution():
    have = np.array([30, 60, 10], np.int64)
    first = np.array([source_mixing.split_quotas(have, 4, seed)[1] for seed in range(4000)])       # 25 blocks of 100
    n, total = 25, have.sum()
    assert np.allclose(first.mean(axis=0), n * have / total, atol=0.15)
    want = n * have / total * (1 - have / total) * (total - n) / (total - 1)
    assert np.allclose(first.var(axis=0), want, rtol=0.12)


def test_shards_take_disjoint_runs_of_blocks(spark, monkeypatch):
    """The query's shards hold the tree's quotas, whatever part of the tree tasks split."""
    rows = [(i, " ".join(["w"] * (1 + i % 7)), "en", f"s{i % 3}" if i % 10 else None, 5) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    monkeypatch.setattr(source_mixing, "BLOCK_DOCS", 10)
    seen = []
    for top in (1024, 2):
        monkeypatch.setattr(source_mixing, "TOP_NODES", top)
        got = source_mixing.mix_sources(docs, shard_words=700).collect()
        assert all(len(r["shards"]) == r["copies"] for r in got)
        seen.append({(r["id"], tuple(r["shards"])) for r in got})
    assert seen[0] == seen[1]
    shards = 1 + max(s for r in got for s in r["shards"])
    assert shards == math.ceil(1.5 * sum(r["size"] for r in got) / 700)
    words = Counter(s for r in got for s in r["shards"] for _ in range(r["size"]))
    assert len(words) == shards and max(words.values()) < 2.5 * min(words.values())          # a shard is about as many blocks as another


def test_mix_query_equals_its_sql(spark):
    import duckdb

    from linesift.llm import queries
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = sorted((a, b, c, round(d, 4), e) for a, b, c, d, e in con.execute(queries.MIX_SQL).fetchall())
    got = queries.op7_source_mixing(spark, sf).collect()
    assert sorted((r.doc_id, r["size"], r.source_size, round(r.target, 4), r.taken) for r in got) == want
    assert all(r["size"] * len(r.shards) == r.taken for r in got)


def test_one_text_in_two_sources(spark):
    rows = [(1, "one two three four", "s1"), (1, "one two three four", "s2")] + [(k, f"t{k} u v w", "s1") for k in range(2, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = Counter({(r["id"], r["source"]): r["copies"] for r in source_mixing.mix_sources(docs).collect()})
    drawn = Counter((r["doc_id"], r["source"]) for r in source_mixing.draw(docs).collect())
    assert drawn == +mixed and len({s for i, s in drawn if i == 1}) == len([1 for (i, s), n in mixed.items() if i == 1 and n])


def test_mix(docs, empty):
    got = source_mixing.mix_sources(docs, shard_words=2000).collect()
    assert len(got) == docs.count()
    src = defaultdict(int)
    for r in documents():
        src[r[3]] += len(words(r[1]))
    order = sorted(src, key=lambda s: (s is None, s or ""))
    wanted = dict(zip(order, source_mixing.targets([src[s] for s in order], [(3, 1, 2)[k % 3] for k in range(len(order))])))
    source_of = {r[0]: r[3] for r in documents()}
    taken, longest = Counter(), Counter()
    for r in got:
        s = source_of[r["id"]]
        assert r["size"] * 2 >= r["taken"] == r["size"] * r["copies"] and len(r["shards"]) == r["copies"]
        assert r["source_size"] == src[s] and r["target"] == pytest.approx(wanted[s])
        taken[s] += r["taken"]
        longest[s] = max(longest[s], r["size"])
    for s in src:
        assert abs(taken[s] - wanted[s]) <= longest[s] / 2 + 1e-6
    assert sorted(map(str, got)) == sorted(map(str, source_mixing.mix_sources(docs.repartition(2), shard_words=2000).collect()))
    drawn = source_mixing.draw(docs, shard_words=2000)
    assert drawn.columns == docs.columns
    assert Counter(r["doc_id"] for r in drawn.collect()) == Counter(x for r in got for x in [r["id"]] * r["copies"])
    assert source_mixing.mix_sources(empty).count() == 0 and source_mixing.draw(empty).count() == 0


# 8 ---------------------------------------------------------------------------------------------------------------

def reference_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [tok.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]


def test_encoder_equals_the_tokenizer():
    rnd = random.Random(1)
    chars = [chr(i) for i in range(0x260)] + ["<|endoftext|>", "'s", "'LL", "_", "\u0301", "\u2003", "\u4e2d", " ", " "]
    texts = ["".join(rnd.choice(chars) for _ in range(30)) for _ in range(1500)] + [r[1] or "" for r in documents()]
    got = packing._encoder(None).encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [r[:-1] for r in reference_ids(texts)]


@pytest.mark.parametrize("max_len", [4096, 64])
def test_packing(docs, max_len):
    placed = packing.pack_documents(docs, max_len=max_len)
    rows = placed.collect()
    texts = {r[0]: r[1] for r in documents()}
    ids = dict(zip(texts, reference_ids(texts.values())))
    pieces, places = Counter(), defaultdict(list)
    for r in rows:
        part = ids[r["doc_id"]][r["start"]:r["start"] + max_len]
        assert (r["start"], r["length"]) == (r["piece"] * max_len, len(part))
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        pieces[r["doc_id"]] += r["length"]
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    times = Counter(r[0] for r in documents())
    assert pieces == {d: n * len(ids[d]) for d, n in times.items()}
    for got in places.values():
        at = 0
        for offset, length in sorted(got):
            assert offset == at
            at += length
        assert at <= max_len
    least = -(-sum(r["length"] for r in rows) // max_len)
    assert len(places) <= 1.1 * least + 1
    seqs = packing.sequences(placed, packing.tokenize_pieces(docs, max_len=max_len, with_ids=True)).collect()
    assert {r["sequence_id"]: r["n_tokens"] for r in seqs} == {s: sum(x for _, x in p) for s, p in places.items()}
    by = {(r["sequence_id"], r["offset"]): ids[r["doc_id"]][r["start"]:r["start"] + r["length"]] for r in rows}
    for r in seqs:
        assert np.frombuffer(r["ids"], "<u4").tolist() == [x for k in sorted(by) if k[0] == r["sequence_id"] for x in by[k]]


def test_patterns_place_everything():
    rnd = random.Random(4)
    for cap, n in ((50, 2000), (1000, 300), (7, 9)):
        hist = Counter(min(cap, int(rnd.expovariate(3 / cap)) + 1) for _ in range(n))
        plan = packing.plan_patterns(hist, cap)
        placed = Counter()
        for copies, times in plan:
            assert 0 < sum(s * c for s, c in copies.items()) <= cap and times > 0
            for s, c in copies.items():
                placed[s] += c * times
        assert placed == hist
        assert sum(t for _, t in plan) <= 1.05 * -(-sum(s * c for s, c in hist.items()) // cap) + 1
    assert packing.plan_patterns({}) == []


def test_columns_cover_all_but_the_rounding_remainder():
    rnd = random.Random(8)
    for cap, n in ((256, 3_000), (256, 60_000), (1000, 20_000)):
        hist = Counter(min(cap, int(rnd.expovariate(6 / cap)) + 1) for _ in range(n))
        tokens = sum(s * c for s, c in hist.items())
        got = packing.cover(hist, cap)
        used = Counter()
        for at, copies, times in got.runs:
            assert copies @ got.sizes[at] <= cap and times >= 1
            for k, c in zip(at.tolist(), copies.tolist()):
                used[int(got.sizes[k])] += c * times
        assert {int(s): hist[int(s)] - used[int(s)] for s in got.sizes} == dict(zip(got.sizes.tolist(), got.left.tolist()))
        assert got.left.min() >= 0 and got.left @ got.sizes <= 0.05 * tokens
        assert tokens / cap <= got.bound + 1e-9
        assert got.bound - 1e-6 <= sum(t for _, t in packing.plan_patterns(hist, cap)) <= 1.005 * got.bound + 1


def test_bound_of_lengths_that_share_no_sequence():
    got = packing.cover({60: 5, 80: 7}, 100)
    assert got.bound <= 12 == sum(t for _, t in packing.plan_patterns({60: 5, 80: 7}, 100))


def test_knapsack_values():
    sizes, prices = np.array([3, 5, 7]), np.array([2.0, 4.5, 5.0])
    best = packing._values(sizes, prices, 15)
    for room in range(16):
        assert best[room] == max(2.0 * a + 4.5 * b + 5.0 * c for a in range(6) for b in range(4) for c in range(3)
                                 if 3 * a + 5 * b + 7 * c <= room)


def test_packing_nothing(empty):
    assert packing.pack_documents(empty).count() == 0


# 9 ---------------------------------------------------------------------------------------------------------------

def test_importance_weights(docs, spark, empty):
    target = spark.createDataFrame([(i,) for i in (*range(20), None, 10 ** 9)], "doc_id long")
    got = importance.resample(docs, target, share=0.5).collect()
    n = importance.BUCKETS
    total, wanted, grams = np.ones(n), np.ones(n), {}
    for r in documents():
        b = np.bincount(importance.buckets((r[1] or "").encode()), minlength=n)
        grams[r[0]] = b
        total += b
        if r[0] in range(20):
            wanted += b
    ratio = np.log(wanted / wanted.sum()) - np.log(total / total.sum())
    for r in got:
        assert r["n_grams"] == grams[r["doc_id"]].sum()
        assert r["log_weight"] == pytest.approx(float(grams[r["doc_id"]] @ ratio), abs=1e-8)
    assert abs(sum(r["kept"] for r in got) - round(0.5 * len(got))) <= 1
    again = importance.resample(docs.repartition(2), target, share=0.5).collect()
    assert Counter((r["doc_id"], r["kept"]) for r in got) == Counter((r["doc_id"], r["kept"]) for r in again)
    assert importance.resample(empty, target, share=0.5).count() == 0


def test_kth_largest(spark):
    rnd = random.Random(3)
    values = [rnd.choice([rnd.gauss(0, 1), rnd.gauss(0, 1e6), 1.0]) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    few, importance.FEW = importance.FEW, 10
    try:
        for k in (1, 2, 700, 1500, 2999, 3000):
            assert importance.kth_largest(df, "x", k) == sorted(values, reverse=True)[k - 1]
    finally:
        importance.FEW = few


def test_gumbel_sampling_follows_the_weights(spark):
    """Of texts with equal weights each is as likely as any other to be kept."""
    df = spark.createDataFrame([(i, "same text") for i in range(4000)], "doc_id long, text string")
    got = importance.resample(df, df.limit(0).select("doc_id"), share=0.25)
    kept = [r["doc_id"] for r in got.where("kept").collect()]
    assert len(kept) == 1000 and 400 < sum(k < 2000 for k in kept) < 600


# 10 --------------------------------------------------------------------------------------------------------------

def brute_forward(model, seq):
    a, total = None, 0.0
    for s in seq:
        a = (model.start if a is None else a @ model.move) * model.emit[s]
        total += math.log(a.sum())
        a = a / a.sum()
    return total


def random_model(k=3, classes=7, seed=0):
    rng = np.random.default_rng(seed)
    p = lambda *s: rng.random(s) + 0.05
    start, move, emit = p(k), p(k, k), p(classes, k)
    return hmm_scoring.Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def test_forward_and_expected_counts():
    rng = np.random.default_rng(1)
    model = random_model()
    seqs = [rng.integers(0, 7, n).astype(np.int32) for n in (1, 2, 5, 5, 40, 3)]
    assert hmm_scoring.log_likelihood(model, seqs) == pytest.approx([brute_forward(model, s) for s in seqs])
    # all paths of a short sequence, one by one
    import itertools
    s = seqs[2]
    start, move, emit, whole = np.zeros(3), np.zeros((3, 3)), np.zeros((7, 3)), 0.0
    for path in itertools.product(range(3), repeat=len(s)):
        p = model.start[path[0]] * model.emit[s[0], path[0]]
        for t in range(1, len(s)):
            p *= model.move[path[t - 1], path[t]] * model.emit[s[t], path[t]]
        whole += p
        start[path[0]] += p
        for t in range(len(s)):
            emit[s[t], path[t]] += p
            if t:
                move[path[t - 1], path[t]] += p
    a, b, c, total = hmm_scoring.expected_counts(model, [s], 7)
    assert total == pytest.approx(math.log(whole))
    assert a == pytest.approx(start / whole) and b == pytest.approx(move / whole) and c == pytest.approx(emit / whole)
    assert sum(x.sum() for x in hmm_scoring.expected_counts(model, seqs, 7)[2:3]) == pytest.approx(sum(map(len, seqs)))


def brute_base(rows):
    train = Counter()
    for r in rows:
        if r[0] is None or zlib.crc32(str(r[0]).encode()) % 7 != 2:
            train.update([*words(r[1]), b""])
    n, v = sum(train.values()), len(train)
    out = defaultdict(list)
    for r in rows:
        t = [*words(r[1]), b""]
        out[r[0]].append((r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2, len(t), sum(train[x] > 0 for x in t), n,
                          sum(math.log10((train[x] + 1) / (n + v + 1)) for x in t)))
    return out


@pytest.mark.parametrize("head", [50_000, 30, 1])
def test_language_model(docs, head):
    expected = brute_base(documents())
    got = hmm_scoring.score_texts(docs, head=head, states=3, rounds=2).collect()
    assert len(got) == docs.count()
    for r in got:
        e = expected[r["doc_id"]][0]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == e[:4]
        assert r["base_score"] == pytest.approx(e[4], rel=1e-9)
        assert math.isfinite(r["score"]) and r["score"] < 0


def test_head_takes_part_of_a_tied_bin(spark, monkeypatch):
    """Words of equal counts: the head is full, by count and then word, and scores stay finite."""
    seen = []
    encode = hmm_scoring._encode
    monkeypatch.setattr(hmm_scoring, "_encode", lambda head: seen.append(head) or encode(head))
    df = spark.createDataFrame([(i, "top top " + " ".join(f"w{i:02}{k}" for k in range(5))) for i in range(20)], "doc_id long, text string")
    rows = [tuple(r) for r in df.collect()]
    train = Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            train.update([*t.split(), ""])
    for head in (0, 2, 10, 1000):
        got = hmm_scoring.score_texts(df, head=head, states=2, rounds=1).collect()
        assert seen[-1] == sorted(train, key=lambda w: (-train[w], w))[:head]
        expected = brute_base(rows)
        for r in got:
            assert (r["n_known"], r["train_tokens"]) == expected[r["doc_id"]][0][2:4]
            assert r["base_score"] == pytest.approx(expected[r["doc_id"]][0][4], rel=1e-9)


def test_language_model_is_a_distribution(spark):
    """Over all next words, unseen ones together included, probabilities add up to one."""
    rows = [(i, "a b c" if i % 2 else "a b d e") for i in range(40)]
    df = spark.createDataFrame(rows + [(1000 + k, t) for k, t in enumerate(["a", "b", "c", "d", "e", "unseen", ""])], "doc_id long, text string")
    df = df.where("crc32(cast(doc_id as string)) % 7 = 2 OR doc_id < 1000")
    got = {r["doc_id"]: r["score"] for r in hmm_scoring.score_texts(df, head=3, states=2, rounds=2).collect()}
    assert all(v < 0 for v in got.values())


def test_language_model_learns(spark):
    """Text with latent structure scores better, held out, than by word counts."""
    rnd = random.Random(6)
    rows = []
    for i in range(300):
        vocab = [f"x{k}" for k in range(40)] if i % 2 else [f"y{k}" for k in range(40)]
        rows.append((i, " ".join(rnd.choice(vocab) for _ in range(60))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r for r in hmm_scoring.score_texts(df, states=2).collect() if r["held_out"]]
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got) + 0.25 * sum(r["n_tokens"] for r in got)


def test_language_model_without_rows(empty, spark):
    assert hmm_scoring.score_texts(empty).count() == 0
    only = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2]
    df = spark.createDataFrame([(i, "a b") for i in only], "doc_id long, text string")
    got = hmm_scoring.score_texts(df).collect()
    assert all(r["held_out"] and r["n_known"] == 0 and r["train_tokens"] == 0 and r["base_score"] == 0 for r in got)


# pipeline --------------------------------------------------------------------------------------------------------

def test_pipeline_stages(docs, spark, tmp_path):
    import corpus_pipeline
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard_join", "source_mixing", "best_fit_packing"]
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, "")
        assert out.columns == docs.columns, name
        at = spark.createDataFrame(out.collect(), out.schema)
        if name == "ngram_jaccard_join":
            left = at.collect()
            sets = jaccard_classes([(k, r["text"]) for k, r in enumerate(left)])
            assert all(k == c for k, c in sets.items())
    last = corpus_pipeline.STAGES[-1][1](spark, at, "").collect()
    assert Counter(r["doc_id"] for r in last if r["piece"] == 0) == Counter(r["doc_id"] for r in at.collect())
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_queries_are_registered():
    import __spark_entry__ as entry
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert json.dumps(sorted(entry.oracle_sql()))

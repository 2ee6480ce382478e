"""Plain models of the operators' contracts, and small inputs with every odd case."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size int, _h string, rank int"


def words(text):
    return (text or "").encode().lower().split()


def shingle_set(text, k=5):
    w = words(text)
    k = min(k, len(w))
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if k else frozenset()


def classes(nodes, links):
    """node -> least node of its component."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def jaccard_classes(rows):
    """rows: (key, text); exact by all pairs."""
    sets = [(k, shingle_set(t)) for k, t in rows]
    links = []
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                links.append((a, b))
    return classes([k for k, _ in sets], links)


def documents(seed=3, n=60):
    """Rows of SCHEMA: groups of copies, near copies, a hot source, nulls, empty and
    blank texts, few words, a long text, odd characters, a repeated row."""
    rnd = random.Random(seed)
    vocab = [a + b + c for a in "bcdfghkl" for b in "aeiou" for c in ("n", "r", "st", "mple", "x", "lt", "s", "t", "nd", "ck")] + ["the", "of", "Ärger", "naïve", "x.", "#*", "42"]
    rows = []

    def add(text, source=None, lang="en"):
        i = len(rows)
        rows.append((i, text, lang, source if source is not None else f"s{i % 3 and i % 5}", None if text is None else len(text), "k", 1, "h", 7))

    base = [rnd.choice(vocab) for _ in range(120)]
    for _ in range(n):
        add("\n".join(" ".join(rnd.choice(vocab) for _ in range(rnd.randint(3, 30))) for _ in range(rnd.randint(1, 6))))
    for k in range(12):                 # near copies: ever more words changed
        w = list(base)
        for j in range(k):
            w[(37 * j) % len(w)] = f"new{j}"
        add(" ".join(w))
    for _ in range(5):
        add("An exact copy of one text,\nwith two lines of it. " + " ".join(base[:20]))
    for t in (None, None, "", " \t\n ", "one", "One", "two words", "a b c d", "a\x1cb c\x85d e", "e\u0301t\u00e9 \u2003 x", "### *** $$$ %%% " * 30,
              "\n\n\nall rights reserved", "word " * 4000, "\ufeffbom \u4e2d\u6587 text", "<|endoftext|> a<|startoftext|>b"):
        add(t)
    add("null source", source="")
    rows[-1] = rows[-1][:2] + (None, None) + rows[-1][4:]
    rows.append(rows[5])                # a repeated row
    rows.append((None, "a text without id and some more words", "en", "s1", 10, "k", 1, "h", 7))
    return rows

"""Operator 1: URL rules by a bit-parallel wildcard automaton.

Every rule becomes glob patterns over the canonical URL ``host`` + ``path``:
``*`` stands for any run of bytes without ``/``, ``**`` for any run.  A rule
``example.com/de/`` is the two globs ``example.com/de/**`` and
``*.example.com/de/**``; since ``*`` stops at ``/``, a host pattern never matches
inside a path.  All globs lie side by side in one multiword Shift-And state, one
bit per literal byte plus a start bit: reading byte c,

    D = ((D << 1) & next[c]) | (D & stay[c])

where ``stay[c]`` holds the bits whose state is followed by a star that accepts
c.  A numpy row per URL simulates all patterns of all URLs of a batch at once;
URLs are taken longest first, so a step touches only the URLs that still have
bytes, and the work is the sum of the lengths.

The rules are a parameter of the job (bytes of masks: 256 x words x 16); the
URLs stay where the scan put them: no shuffle, nothing to skew.

Defined results: a null URL or one without ``://`` has an empty host and path,
no rule and the default verdict.  Repeated rows give repeated results, extra
columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Rule = tuple[str, str, str]          # (host, path, verdict)

GLOB_STAR, GLOB_ANY = -1, -2


def rule_globs(host: str, path: str) -> list[str]:
    """The globs of a host rule: the host itself and its subdomains."""
    return [f"{host}{path}**", f"*.{host}{path}**"]


def _tokens(glob: str) -> list[int]:
    out: list[int] = []
    raw, i = glob.encode(), 0
    while i < len(raw):
        if raw[i:i + 2] == b"**":
            out.append(GLOB_ANY)
            i += 2
        elif raw[i:i + 1] == b"*":
            out.append(GLOB_STAR)
            i += 1
        else:
            out.append(raw[i])
            i += 1
    return out


class Automaton:
    """Multiword Shift-And masks of a list of globs."""

    def __init__(self, globs: Sequence[str]):
        parts = [_tokens(g) for g in globs]
        bits = sum(1 + sum(t >= 0 for t in p) for p in parts)
        self.words = max(1, (bits + 63) // 64)
        self.next = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        self.accept: list[tuple[int, np.uint64]] = []
        bit = 0
        for p in parts:
            w, b = divmod(bit, 64)
            self.start[w] |= np.uint64(1) << np.uint64(b)
            for t in p:
                w, b = divmod(bit, 64)
                if t == GLOB_ANY:
                    self.stay[:, w] |= np.uint64(1) << np.uint64(b)
                elif t == GLOB_STAR:
                    keep = np.arange(256) != ord("/")
                    self.stay[keep, w] |= np.uint64(1) << np.uint64(b)
                else:
                    bit += 1
                    w, b = divmod(bit, 64)
                    self.next[t, w] |= np.uint64(1) << np.uint64(b)
            w, b = divmod(bit, 64)
            self.accept.append((w, np.uint64(1) << np.uint64(b)))
            bit += 1

    def match(self, texts: Sequence[bytes]) -> np.ndarray:
        """Boolean matrix: text x glob, whole-text matches."""
        n = len(texts)
        length = np.fromiter(map(len, texts), np.int64, n)
        order = np.argsort(-length, kind="stable")
        flat = np.frombuffer(b"".join(texts), np.uint8)
        begin = np.concatenate([[0], np.cumsum(length)])[:-1][order]
        state = np.repeat(self.start[None, :], n, axis=0)
        falling = length[order]
        for i in range(int(falling[0]) if n else 0):
            live = int(np.searchsorted(-falling, -i, side="left"))      # texts longer than i
            d, c = state[:live], flat[begin[:live] + i]
            moved = d << np.uint64(1)
            moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
            state[:live] = (moved & self.next[c]) | (d & self.stay[c])
        out = np.zeros((n, len(self.accept)), bool)
        for k, (w, bit) in enumerate(self.accept):
            out[order, k] = (state[:, w] & bit) != 0
        return out


def split_url(df: DataFrame, url_col: str, host: str, path: str) -> DataFrame:
    """Add the host (after the first ``://``, A-Z lower-cased) and the path (up
    to ``?`` or ``#``); both empty without ``://``."""
    rest = F.expr(f"CASE WHEN instr(`{url_col}`, '://') > 0 THEN substring(`{url_col}`, instr(`{url_col}`, '://') + 3) ELSE '' END")
    raw = F.regexp_extract(rest, r"(?s)^([^/?#]*)([^?#]*)", 1)
    return df.withColumns({
        host: F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
        path: F.regexp_extract(rest, r"(?s)^([^/?#]*)([^?#]*)", 2)})


def filter_urls(df: DataFrame, rules: Sequence[Rule], *, id_col: str = "page_id", url_col: str = "url",
                default: str = "allow") -> DataFrame:
    """Judge every URL: (id, host, path, rule, verdict).

    The longest rule (characters of host and path) that fits wins; among rules of
    one length the one listed first.  ``default`` is the verdict without a rule.
    """
    names = [f"{h}{p}" for h, p, _ in rules]
    globs = [g for h, p, _ in rules for g in rule_globs(h, p)]
    best_first = sorted(range(len(rules)), key=lambda k: -len(names[k]))
    verdicts = [v for _, _, v in rules]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = Automaton(globs)
        for batch in batches:
            hosts, paths = batch.column("host"), batch.column("path")
            seen = [(h + p).encode() for h, p in zip(hosts.to_pylist(), paths.to_pylist())]
            hit = auto.match(seen).reshape(len(seen), len(rules), 2).any(axis=2)
            chosen = np.full(len(seen), -1)
            for k in reversed(best_first):
                chosen[hit[:, k]] = k
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), hosts, paths,
                pa.array([names[k] if k >= 0 else None for k in chosen], pa.string()),
                pa.array([verdicts[k] if k >= 0 else default for k in chosen], pa.string())],
                names=[id_col, "host", "path", "rule", "verdict"])

    kind = df.schema[id_col].dataType.simpleString()
    d = split_url(df.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url")),
                  "url", "host", "path").select("id", "host", "path")
    return d.mapInArrow(judge, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")

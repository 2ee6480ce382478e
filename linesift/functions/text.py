"""Column expressions on captured text.

All are built-in Spark expressions: they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for equal results.
BINARY_SAMPLE_BYTES = 4096          # bytes looked at by the binary test
BINARY_NON_TEXT_SHARE = 0.30        # share of non-text bytes above which output is binary
BYTES_PER_TOKEN = 4.0               # token estimate divisor
HEADER_MIN_LINES_SAVED = 5          # header "N -> M lines" only from this saving on

# Line terminators of bytes.splitlines: \n, \r\n, \r.  A lookbehind split keeps
# the terminator at the end of each piece.
_SPLIT_BYTES_LINES = "(?<=\\n)|(?<=\\r)(?!\\n)"
# str.splitlines also breaks on \x0b \x0c \x1c \x1d \x1e \x85    .
_SPLIT_STR_LINES = "(?<=\\n)|(?<=\\r)(?!\\n)|(?<=[\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029])"


# Whitespace sets (fixed values): bytes.strip() and str.strip() of Python.
ASCII_WS = " \t\n\r\x0b\x0c"
PY_WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200b))
               + "\u2028\u2029\u202f\u205f\u3000")


def ws_strip(c: Column) -> Column:
    """bytes.strip(): remove [ \\t\\n\\r\\x0b\\f] at both ends (Spark trim() alone removes spaces only).
    TRIM with a character set: no regex engine."""
    return F.trim(c, F.lit(ASCII_WS))


def ws_lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(ASCII_WS))


def ws_rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(ASCII_WS))


def py_strip(c: Column) -> Column:
    """str.strip() (Unicode whitespace)."""
    return F.trim(c, F.lit(PY_WS_CHARS))


def py_lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(PY_WS_CHARS))


def py_rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(PY_WS_CHARS))


def eol_strip(c: Column) -> Column:
    """rstrip(b'\\n\\r'): the line without its terminator."""
    return F.rtrim(c, F.lit("\n\r"))


def split_lines(text: Column, universal: bool = False) -> Column:
    """Array of lines with terminators kept; a trailing '' piece is removed.

    ``universal=True`` gives str.splitlines (checklists), else bytes.splitlines.
    (``operators.lines.to_lines`` explodes without this lookbehind split when
    the text has only '\\n' terminators.)
    """
    parts = F.split(text, _SPLIT_STR_LINES if universal else _SPLIT_BYTES_LINES, -1)
    return F.when(F.element_at(parts, -1) == F.lit(""), F.slice(parts, 1, F.size(parts) - 1)) \
        .otherwise(parts)


def other_terminators(text: Column, universal: bool = False) -> Column:
    """True when the text has a line terminator other than '\\n' (plain
    substring searches: no regex engine, no copy of the text)."""
    chars = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029" if universal else "\r"
    found = F.lit(False)
    for ch in chars:
        found = found | (F.instr(text, ch) > 0)
    return found


def newline_count(text: Column) -> Column:
    """Count of '\\n' bytes (the log's ``stdout_lines``, QUIRK 1)."""
    return F.size(F.split(text, "\n", -1)) - 1          # single-char split: no regex engine


def octets(c: Column) -> Column:
    return F.octet_length(c).cast("long")


def token_estimate(n_bytes: Column) -> Column:
    """ceil(bytes / 4), 0 when empty."""
    return F.ceil(n_bytes / F.lit(BYTES_PER_TOKEN)).cast("long")


def probably_binary(stdout: Column) -> Column:
    """Heuristic binary test on the first 4096 bytes.

    ``stdout`` is BINARY.  Empty -> false; NUL byte -> true; valid UTF-8 ->
    false; else share of bytes outside tab/LF/FF/CR/printable ASCII > 0.30.
    """
    sample = F.substring(stdout, 1, BINARY_SAMPLE_BYTES)
    latin = F.decode(sample, "ISO-8859-1")           # one char per byte
    n = F.length(latin)
    non_text = F.length(F.regexp_replace(latin, "[\\t\\n\\f\\r\\x20-\\x7e]", ""))
    return (F.when(n == 0, F.lit(False))
            .when(F.instr(latin, "\u0000") > 0, F.lit(True))
            .when(F.is_valid_utf8(sample.cast("string")), F.lit(False))
            .otherwise(non_text / n > F.lit(BINARY_NON_TEXT_SHARE)))


def header_shown(lines_in: Column, lines_out: Column, bytes_out: Column,
                 min_saved: int = HEADER_MIN_LINES_SAVED) -> Column:
    """The "N -> M lines" header is shown iff output non-empty and saving >= min."""
    return (bytes_out > 0) & ((lines_in - lines_out) >= F.lit(min_saved))


def strip_graph(line: Column) -> Column:
    """Strip the commit-graph decoration prefix."""
    return F.regexp_replace(line, "^[*|/\\\\ ]+", "")


def is_commit_header(stripped: Column) -> Column:
    """``commit <7-40 hex>`` at the start (after E14)."""
    return stripped.rlike("^commit [0-9a-f]{7,40}")


def is_oneline_commit(stripped: Column) -> Column:
    """``<7-40 hex> `` at the start (after E14)."""
    return stripped.rlike("^[0-9a-f]{7,40} ")


def compact_hint(text: Column, max_chars: int = 80) -> Column:
    """Collapse whitespace runs; cut to ``max_chars`` with '...'."""
    compact = ws_strip(F.regexp_replace(text, "[ \\t\\n\\r\\x0b\\f\\x1c-\\x1f\\x85\\u00a0\\u1680"
                                              "\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+", " "))
    return F.when(F.length(compact) <= max_chars, compact) \
        .otherwise(F.concat(F.rtrim(F.substring(compact, 1, max_chars - 3)), F.lit("...")))

"""Column expressions over agent shell commands.

``wrapper`` is the name of the compaction wrapper whose use is counted; it is a
parameter (the reports are about whichever wrapper the runs used).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ws_strip

DEFAULT_WRAPPER = "linesift"
# Fixed value: the login-shell prefix that agents put before the real command.
SHELL_PREFIX = "/bin/zsh -lc "


def _first_token(s: Column) -> Column:
    return F.regexp_extract(s, "^\\s*(\\S+)", 1)


def program_name(command: Column, wrapper: str = DEFAULT_WRAPPER) -> Column:
    """E7: '?' for empty; the wrapper name if ``'<wrapper> '`` occurs; the first
    word of a ``/bin/zsh -lc '...'`` payload (quotes removed, 'zsh' if empty);
    else the first word."""
    payload = ws_strip(F.substr(command, F.instr(command, SHELL_PREFIX) + F.lit(len(SHELL_PREFIX))))
    unq1 = F.when(payload.startswith("'") & payload.endswith("'"),
                  F.substring(payload, F.lit(2), F.greatest(F.length(payload) - 2, F.lit(0)))).otherwise(payload)
    unq2 = F.when(unq1.startswith('"') & unq1.endswith('"'),
                  F.substring(unq1, F.lit(2), F.greatest(F.length(unq1) - 2, F.lit(0)))).otherwise(unq1)
    shell_prog = F.when(_first_token(unq2) == "", F.lit("zsh")).otherwise(_first_token(unq2))
    return (F.when(F.coalesce(command, F.lit("")) == "", F.lit("?"))
            .when(F.instr(command, wrapper + " ") > 0, F.lit(wrapper))
            .when(F.instr(command, SHELL_PREFIX) > 0, shell_prog)
            .otherwise(_first_token(command)))


def wrapper_used_thread(command: Column, wrapper: str = DEFAULT_WRAPPER) -> Column:
    """E8, flavour A: ' w ' in ' cmd ', ends with '/w', contains '`w`', or contains 'w '."""
    padded = F.concat(F.lit(" "), command, F.lit(" "))
    return ((F.instr(padded, f" {wrapper} ") > 0) | command.endswith(f"/{wrapper}")
            | (F.instr(command, f"`{wrapper}`") > 0) | (F.instr(command, f"{wrapper} ") > 0))


def wrapper_used_message(command: Column, wrapper: str = DEFAULT_WRAPPER) -> Column:
    """E8, flavour B: the wrapper is one of the whitespace-separated words, or the
    command starts with / contains it followed by a space."""
    words = F.split(ws_strip(command), "\\s+")
    padded = F.concat(F.lit(" "), command, F.lit(" "))
    return (F.array_contains(words, wrapper) | command.startswith(f"{wrapper} ")
            | (F.instr(padded, f" {wrapper} ") > 0))

"""Registered queries: importing this package fills ``catalog.QUERIES`` / ``catalog.ORACLE``."""

from . import checklists, compaction, documents, listing, search, sessions, trials, usage, vcs  # noqa: F401
from . import dispatch, edges, odd_keys, streams  # noqa: F401  (use the oracles registered above)
from .catalog import ORACLE, QUERIES  # noqa: F401

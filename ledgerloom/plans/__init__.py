"""Queries over the driver tables, each with its SQL oracle where SQL can express it."""

from . import archive_window, causes, coherence, context, coupling, days, evaluation, forensics, live, money, more, peeling, reports, rest, serving, trace  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401

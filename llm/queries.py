"""Imports every module of this package that registers queries."""

from . import queries_a, queries_b, queries_c  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401

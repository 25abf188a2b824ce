"""Imports every module that registers queries."""

from . import conversations, documents, events, paths, summaries  # noqa: F401

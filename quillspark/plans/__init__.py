"""Queries over the given tables."""

from . import answers, catalogue, corpus, streams  # noqa: F401

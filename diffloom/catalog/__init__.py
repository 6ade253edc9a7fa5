"""Registered queries over the driver tables and the SQL they are checked against."""

from .base import REGISTRY
from . import assembly, blocks, changes, datasets, examples, replays, scores, surface, text  # noqa: F401

__all__ = ["REGISTRY"]

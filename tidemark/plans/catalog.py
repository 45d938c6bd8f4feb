"""Importing this module registers every query."""

from tidemark.plans import clickstream, orders, storage, streams  # noqa: F401
from tidemark.plans.registry import REGISTRY

__all__ = ["REGISTRY"]

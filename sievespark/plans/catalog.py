"""All registered queries."""

from . import arriving, balance, encoding, evaluation, features, learning, nearby, scans, screening  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

"""One query per inventory entry, each with its check where SQL can express it."""

from . import aggregates, cleaning, encoders, io, joins, modelling, monitoring, scalars  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

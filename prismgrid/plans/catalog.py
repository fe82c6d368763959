"""All registered queries."""

from .registry import ORACLES, QUERIES
from . import spectra, agreement, blocked, grids, pairing, members, streams  # noqa: F401

__all__ = ["QUERIES", "ORACLES"]

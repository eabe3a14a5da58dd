"""Every query of the library by name, with its SQL where SQL can express it."""

from .plans import analysis, codec, container, corpus, entropy, frames, reports  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

"""All registered queries."""

from . import analysis, preparing, profiling, relational  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401

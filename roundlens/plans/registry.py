"""All queries of the library's own operators."""

from . import diagrams, fights, live, replay, rosters, scoring, sessions, social, summaries, surface  # noqa: F401
from .base import ORACLE, QUERIES  # noqa: F401

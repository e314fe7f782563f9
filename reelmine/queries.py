"""All registered queries of the library."""

from . import sinks  # noqa: F401
from .operators import cards, catalog, citations, corpus, health, merges, reports, search  # noqa: F401
from .plans.registry import ORACLE, QUERIES  # noqa: F401
from .sources import captions, payloads  # noqa: F401
from .streaming import jobs  # noqa: F401

"""All queries over the driver's tables."""

from . import agreements, graphs, harmonised, integrated, more, neighbourhoods, panels, reported, results, selections  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401

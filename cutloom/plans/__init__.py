"""The named queries, one module a theme; importing a module registers its queries."""

from . import containers, delivery, geometry, media, motion, sessions, signals, timelines  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401

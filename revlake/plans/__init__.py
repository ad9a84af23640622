"""All registered queries of the engine."""

from . import context, leave, lifecycle, more, retrieval, stores, streams, text  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401

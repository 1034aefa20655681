"""All registered queries: importing the modules registers them."""

from . import queries_base, queries_history, queries_models, queries_score, queries_streaming  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401

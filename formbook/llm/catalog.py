"""All registered queries of this package: importing the modules registers them."""

from . import queries_a, queries_b, queries_c, queries_d, queries_e  # noqa: F401
from .common import ORACLES, QUERIES  # noqa: F401

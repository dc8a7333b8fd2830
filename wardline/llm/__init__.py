"""Operators for preparing training text: cleaning, deduplication, mixing, sharding and output."""

import sys

from ..session import ship

# executors then need no copy of this subpackage
ship(sys.modules[__name__])

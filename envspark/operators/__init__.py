"""Relational operators built from DataFrame primitives."""

from .latest import latest_per_key, top_k_per_key  # noqa: F401
from .positional import exact_percentiles, positional_index, running_total  # noqa: F401,E402

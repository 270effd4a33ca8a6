"""What the Python workers share: code shipped by value and state kept between tasks."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable

from pyspark import cloudpickle


def ship(name: str) -> None:
    """Send the module's functions to the executors by value; they need not have it installed."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


ship(__name__)


def kept(key: object, make: Callable[[], object]) -> object:
    """The value made once for ``key`` in this worker process and kept for its later tasks.

    A worker keeps few keys (tokenizers, automata), each of a size that does not depend on
    the data; a lost worker makes them again.
    """
    state = sys.modules.setdefault("_llm_worker_state", types.ModuleType("_llm_worker_state"))
    values = state.__dict__.setdefault("values", {})
    if key not in values:
        values[key] = make()
    return values[key]

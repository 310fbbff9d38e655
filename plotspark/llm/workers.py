"""What a Python worker keeps from one task to the next."""

from __future__ import annotations

import sys
from collections.abc import Callable
from types import ModuleType

import pyarrow as pa


def kept(kind: str, path: str, make: Callable):
    """``make(path)``, made once per worker: the package's own globals travel with every task and end with it."""
    held = sys.modules.setdefault("plotspark_worker", ModuleType("plotspark_worker")).__dict__
    key = f"{kind} {path}"
    if key not in held:
        held[key] = make(path)
    return held[key]


def dropped(kind: str) -> None:
    """Let go of everything of a kind that this worker keeps; ``kept`` makes it again. Arrow gives back what it holds in reserve, too."""
    held = sys.modules["plotspark_worker"].__dict__ if "plotspark_worker" in sys.modules else {}
    old = [key for key in held if key.startswith(f"{kind} ")]
    for key in old:
        del held[key]
    if old:
        pa.default_memory_pool().release_unused()

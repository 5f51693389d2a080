"""State that a Python worker keeps from task to task."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable
from typing import Any


def kept(key: tuple, make: Callable[[], Any]) -> Any:
    """What this worker keeps under ``key``, made on first use.

    Functions of the package reach the workers by value, so a global of their
    own would be new in every task; a module entry stays with the process.
    """
    name = "_ledgerlens_kept"
    module = sys.modules.setdefault(name, types.ModuleType(name))
    state = module.__dict__.setdefault("state", {})
    if key not in state:
        state[key] = make()
    return state[key]

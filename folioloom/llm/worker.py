"""What a Python worker keeps from one task to the next."""

from __future__ import annotations

import sys
from collections.abc import Callable
from types import ModuleType
from typing import Any


def kept(name: str, make: Callable[[], Any]) -> Any:
    """The object of that name in this process, made on first use; objects of another kind (what stands before a colon) go, as a worker outlives the operator it worked for."""
    home = sys.modules.setdefault("_folioloom_worker", ModuleType("_folioloom_worker"))
    if not hasattr(home, name):
        kind = name.partition(":")[0]
        for other in [x for x in vars(home) if not x.startswith("__") and x.partition(":")[0] != kind]:
            delattr(home, other)
        setattr(home, name, make())
    return getattr(home, name)

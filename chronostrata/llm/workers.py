"""What a Python worker keeps from one batch or task to the next."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

_KEPT: dict[str, Any] = {}
#: Things kept at once by one worker.
MOST = 3


def kept(name: str, make: Callable[[], Any]) -> Any:
    """The thing of this name, made when it is first asked for; the oldest goes if there are too many."""
    if name not in _KEPT:
        while len(_KEPT) >= MOST:
            del _KEPT[next(iter(_KEPT))]
        _KEPT[name] = make()
    return _KEPT[name]

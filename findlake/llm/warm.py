"""What a Python worker keeps between its tasks: one object, that of the operator it ran last."""

from __future__ import annotations

import ctypes
from collections.abc import Callable
from typing import Any

_key: Any = None
_object: Any = None
_asked = False


def _drop() -> None:
    global _key, _object
    _key = _object = None
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no such call here: the allocator keeps what is free
        pass


def keep_warm(key: Any, make: Callable[[], Any]) -> Any:
    """The kept object of ``key``, or a new one in place of whatever was kept."""
    global _key, _object, _asked
    _asked = True
    if _key != key:
        if _key is not None:
            _drop()
        _key, _object = key, make()
    return _object


def only(make: Callable[[], Any]) -> Any:
    """What ``make`` returns; an object that it doesn't ask for is let go, with its memory."""
    global _asked
    _asked = False
    out = make()
    if not _asked and _key is not None:
        _drop()
    return out

"""What can go wrong with an input or a provider, and functions that turn it into a value."""

from __future__ import annotations

import functools
import logging
from collections.abc import Callable, Mapping, Sequence
from typing import Any, TypeVar

T = TypeVar("T")
log = logging.getLogger("millrace")


class EngineError(Exception):
    """Of all that this package raises on its own account."""


class InvalidInput(EngineError, ValueError):
    """An input lacks something or has the wrong shape."""


class ProviderFailed(EngineError):
    """A model or an embedding service gave no usable answer."""


def safely(default: Any = None, caught: tuple[type[BaseException], ...] = (Exception,)) -> Callable[[Callable[..., T]], Callable[..., T]]:
    """A function that logs what it would raise and gives the default instead."""

    def wrap(f: Callable[..., T]) -> Callable[..., T]:
        @functools.wraps(f)
        def run(*args: Any, **kwargs: Any) -> T:
            try:
                return f(*args, **kwargs)
            except caught as e:
                log.warning("%s: %s: %s", f.__name__, type(e).__name__, e)
                return default() if callable(default) else default

        return run

    return wrap


def required(value: Mapping[str, Any], keys: Sequence[str], what: str = "input") -> Mapping[str, Any]:
    """value, if it has all the keys and none of them is null or blank."""
    missing = [k for k in keys if value.get(k) is None or value.get(k) == ""]
    if missing:
        raise InvalidInput(f"{what} lacks {', '.join(missing)}")
    return value


def within(value: float, low: float, high: float, what: str = "value") -> float:
    if not low <= value <= high:
        raise InvalidInput(f"{what} must lie between {low} and {high}, not {value}")
    return value

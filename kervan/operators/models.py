"""Models that a Python worker holds: loaded once, when first needed, and given back on request."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark import cloudpickle

_LOADED: dict[str, object] = {}


def model_key(name: str, load: Callable[[], object]) -> str:
    """Name of a model and of what loads it, the same in every worker: another loader under the same name is another model."""
    return f"{name}:{hashlib.blake2b(cloudpickle.dumps(load), digest_size=8).hexdigest()}"


def loaded(key: str, load: Callable[[], object]):
    """The model of that key in this process; `load` runs if it isn't there yet."""
    if key not in _LOADED:
        _LOADED[key] = load()
    return _LOADED[key]


def unload(name: str | None = None) -> list[str]:
    """Forget the models of one name in this process, or all; one with an `unload` method is told first. Keys that went; safe to repeat."""
    gone = [k for k in list(_LOADED) if name is None or k == name or k.startswith(f"{name}:")]
    for k in gone:
        model = _LOADED.pop(k)
        if callable(getattr(model, "unload", None)):
            model.unload()
    return gone

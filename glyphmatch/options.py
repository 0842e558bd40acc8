"""Options that all distance functions share, and their checks."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

METHODS = ("osa", "lv", "dl", "hamming", "lcs", "qgram", "cosine", "jaccard", "jw", "soundex")
#: Only for searching in texts; equal to cosine.
RUNNING = "running_cosine"
_WEIGHTS = {"osa": 4, "dl": 4, "lv": 3, "jw": 3}


def method_named(name: str, choices: Sequence[str] = METHODS) -> str:
    """A method by its name or the start of it that no other has."""
    if name in choices:
        return name
    found = [m for m in choices if m.startswith(name)] if name else []
    if len(found) != 1:
        raise ValueError(f"method {name!r} is not one of {', '.join(choices)}")
    return found[0]


@dataclass(frozen=True)
class Options:
    """weight: deletion, insertion, substitution, transposition (jw: first string, second string, transpositions)."""

    method: str = "osa"
    weight: tuple[float, ...] = (1.0, 1.0, 1.0, 1.0)
    q: int = 1
    p: float = 0.0
    bt: float = 0.0
    use_bytes: bool = False

    @property
    def unit_weights(self) -> bool:
        return all(w == 1 for w in self.weight)


def options(
    method: str = "osa",
    weight: Sequence[float] | None = None,
    q: float = 1,
    p: float = 0.0,
    bt: float = 0.0,
    use_bytes: bool = False,
    nthread: float | None = None,
    choices: Sequence[str] = METHODS,
) -> Options:
    """Checked options. nthread is checked and has no effect: Spark's tasks are the threads."""
    method = method_named(method, choices)
    weights = tuple(float(w) for w in (weight if weight is not None else (1.0,) * 4))
    if any(not (math.isfinite(w) and 0 < w <= 1) for w in weights):
        raise ValueError("weights must be above 0 and at most 1")
    if len(weights) < _WEIGHTS.get(method, 0):
        raise ValueError(f"{method} needs {_WEIGHTS[method]} weights")
    if not isinstance(q, (int, float)) or isinstance(q, bool) or not math.isfinite(q) or q < 0:
        raise ValueError("q must be 0 or more")
    if not 0 <= p <= 0.25:
        raise ValueError("p must lie in 0 to 0.25")
    if not isinstance(use_bytes, bool):
        raise ValueError("use_bytes must be true or false")
    if nthread is not None and (isinstance(nthread, (bool, str)) or not isinstance(nthread, (int, float)) or nthread <= 0):
        raise ValueError("nthread must be one number above 0")
    return Options(method, (*weights, *(1.0,) * (4 - len(weights)))[:4], int(q), float(p), float(bt), use_bytes)

"""The same hashed draws as functions.noise, for the stateful cores."""

from __future__ import annotations

import hashlib
import math


def uniform(seed: object, *ids: object) -> float:
    text = "|".join([str(seed), *(str(x) for x in ids)])
    return (int(hashlib.md5(text.encode()).hexdigest()[:8], 16) + 0.5) / 4294967296.0


def laplace(scale: float, seed: object, *ids: object) -> float:
    u = uniform(seed, *ids)
    return scale * math.log(2 * u) if u < 0.5 else -scale * math.log(2 * (1 - u))

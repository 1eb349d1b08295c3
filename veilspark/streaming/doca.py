"""Delta-DOCA: bounds the value domain by running quantiles, then clusters online and adds noise.

With delta = 1 no domain is bounded and sensitivities come from the running ranges. A pure core
like castle.py.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from veilspark.config import DocaConfig, weights_of
from veilspark.streaming.castle import Cluster, Item, Ranges, joined, loss, point
from veilspark.streaming.draws import laplace
from veilspark.streaming.quantiles import QuantileSummary

# Error of the quantile summary before and after the first stable domain.
FIRST_EPSILON, LATER_EPSILON = 0.002, 0.02


def mean(values: list[float]) -> float:
    return sum(values) / len(values)


def deviation(values: list[float]) -> float:
    """Population standard deviation."""
    m = mean(values)
    return math.sqrt(sum((v - m) ** 2 for v in values) / len(values))


def settled(estimates: list[float], window: int, spread: float) -> bool:
    """Whether the last window estimates vary by less than spread of their mean."""
    last = estimates[-window:]
    return len(last) >= window and (m := mean(last)) != 0 and deviation(last) / abs(m) < spread


@dataclass
class Noised:
    id: str
    values: dict[str, float]
    cluster: int
    size: int
    passed: object = None


@dataclass
class State:
    summary: QuantileSummary = field(default_factory=lambda: QuantileSummary(FIRST_EPSILON))
    lower: list[float] = field(default_factory=list)
    upper: list[float] = field(default_factory=list)
    held: list[Item] = field(default_factory=list)
    ranges: Ranges = field(default_factory=dict)
    sensitivity: dict[str, float] = field(default_factory=dict)
    open: dict[int, Cluster] = field(default_factory=dict)
    waiting: list[Item] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)
    next_cluster: int = 0
    suppressed: int = 0


class Doca:
    def __init__(self, config: DocaConfig, state: State | None = None):
        self.c, self.s = config, state or State()
        self.weights = weights_of(config.headers, config.weights)

    def _tau(self) -> float:
        recent = self.s.losses[-self.c.history :]
        return mean(recent) if recent else 0.0

    def _stable_domain(self, item: Item) -> list[Item]:
        """Hold a tuple; once both quantiles are settled, the held tuples between them by mean."""
        s = self.s
        middle = lambda x: mean(list(x.values.values()))
        s.held.append(item)
        if self.c.held and len(s.held) > self.c.held:
            s.held.pop(0)
            s.suppressed += 1
        s.summary.add(middle(item))
        s.lower = [*s.lower, s.summary.quantile((1 - self.c.delta) / 2)][-self.c.window :]
        s.upper = [*s.upper, s.summary.quantile((1 + self.c.delta) / 2)][-self.c.window :]
        if not (settled(s.lower, self.c.window, self.c.spread) and settled(s.upper, self.c.window, self.c.spread)):
            return []
        lo, hi = s.lower[-1], s.upper[-1]
        domain = sorted((x for x in s.held if lo <= middle(x) <= hi), key=lambda x: (middle(x), str(x.id)))
        s.suppressed += len(s.held) - len(domain)
        s.held, s.lower, s.upper, s.summary = [], [], [], QuantileSummary(LATER_EPSILON)
        return domain

    def _new_domain(self, domain: list[Item]) -> list[Noised]:
        """Release what is open under the old ranges, then start over with those of the domain."""
        out = self.flush()
        whole: Ranges = {}
        for x in domain:
            whole = joined(whole, point(x))
        self.s.sensitivity = {h: abs(hi - lo) if hi != lo else 1.0 for h, (lo, hi) in whole.items()}
        self.s.ranges, self.s.losses = {}, []
        return out

    def _choose(self, item: Item) -> int | None:
        off = {n: sum(max(0.0, item.values[h] - hi) - min(0.0, item.values[h] - lo) for h, (lo, hi) in x.ranges.items()) for n, x in self.s.open.items()}
        if not off:
            return None
        nearest = [n for n, d in off.items() if d == min(off.values())]
        whole, tau = joined(self.s.ranges, {}), self._tau()
        if whole:
            fine = [n for n in nearest if loss(joined(self.s.open[n].ranges, point(item)), whole, self.weights) / len(self.c.headers) <= tau]
            if fine:
                return min(fine, key=lambda n: (len(self.s.open[n].items), n))
        if len(self.s.open) < self.c.beta:
            return None
        return min(nearest, key=lambda n: (len(self.s.open[n].items), n))

    def _release(self, number: int) -> list[Noised]:
        cluster = self.s.open.pop(number)
        self.s.losses = [*self.s.losses, loss(cluster.ranges, self.s.ranges, self.weights) / len(self.c.headers)][-self.c.history :]
        size, values = len(cluster.items), {}
        for h, (lo, hi) in cluster.ranges.items():
            glo, ghi = self.s.ranges[h]
            sensitivity = self.s.sensitivity.get(h, abs(ghi - glo) if ghi != glo else 1.0)
            values[h] = mean([x.values[h] for x in cluster.items]) + laplace(sensitivity / size / self.c.eps, self.c.seed, "noise", h, cluster.items[0].id)
        gone = {id(x) for x in cluster.items}
        self.s.waiting = [x for x in self.s.waiting if id(x) not in gone]
        return [Noised(x.id, dict(values), number, size, x.passed) for x in cluster.items]

    def _cluster(self, item: Item) -> list[Noised]:
        number = self._choose(item)
        if number is None:
            number = self.s.next_cluster
            self.s.next_cluster += 1
            self.s.open[number] = Cluster()
        self.s.open[number].insert(item)
        self.s.ranges = joined(self.s.ranges, point(item))
        self.s.waiting.append(item)
        if len(self.s.waiting) <= self.c.delay:
            return []
        oldest = self.s.waiting.pop(0)
        return self._release(next(n for n, x in self.s.open.items() if any(y is oldest for y in x.items)))

    def push(self, item: Item) -> list[Noised]:
        if self.c.delta == 1:
            return self._cluster(item)
        domain = self._stable_domain(item)
        if not domain:
            return []
        out = self._new_domain(domain)
        for x in domain:
            out += self._cluster(x)
        return out

    def flush(self) -> list[Noised]:
        """Release all open clusters; tuples that wait for a stable domain stay held."""
        out = []
        for number in list(self.s.open):
            out += self._release(number)
        return out

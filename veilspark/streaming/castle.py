"""CASTLEGUARD: delay-bound clustering of a stream under k-anonymity, l-diversity and noise.

A pure core: State holds all there is (and pickles), push() takes one tuple and returns what it
releases. Randomness is hashed from the seed and the tuple's id, so replays give equal output.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from veilspark.config import CastleConfig, weights_of
from veilspark.streaming.draws import laplace, uniform


@dataclass
class Item:
    id: str
    values: dict[str, float]
    sensitive: object = None
    pid: object = None
    passed: object = None


@dataclass
class Cluster:
    """Tuples and their range of each header; ranges always fit the present contents."""

    items: list[Item] = field(default_factory=list)
    ranges: dict[str, tuple[float, float]] = field(default_factory=dict)

    @staticmethod
    def of(items: list[Item]) -> Cluster:
        out = Cluster()
        for x in items:
            out.insert(x)
        return out

    def insert(self, item: Item) -> None:
        if not any(x is item for x in self.items):
            self.items.append(item)
            for h, v in item.values.items():
                lo, hi = self.ranges.get(h, (v, v))
                self.ranges[h] = min(lo, v), max(hi, v)

    def remove(self, item: Item) -> None:
        kept = [x for x in self.items if x is not item]
        if len(kept) < len(self.items):
            self.items, self.ranges = [], {}
            for x in kept:
                self.insert(x)

    @property
    def k_size(self) -> int:
        """Distinct individuals; tuples without pid are one."""
        return len({x.pid for x in self.items})

    @property
    def individuals(self) -> int:
        """Distinct individuals; a tuple without pid is one by itself."""
        return len({x.pid for x in self.items if x.pid is not None}) + sum(x.pid is None for x in self.items)

    @property
    def diversity(self) -> int:
        return len({x.sensitive for x in self.items})

    def bounds(self, item: Item) -> bool:
        return bool(self.ranges) and all(lo <= item.values[h] <= hi for h, (lo, hi) in self.ranges.items())

    def distance(self, item: Item) -> float:
        return sum(abs(item.values[h] - abs(hi - lo)) for h, (lo, hi) in self.ranges.items())


Ranges = dict[str, tuple[float, float]]


def joined(a: Ranges, b: Ranges) -> Ranges:
    if not a or not b:
        return dict(a or b)
    return {h: (min(a[h][0], b[h][0]), max(a[h][1], b[h][1])) for h in a}


def loss(ranges: Ranges, whole: Ranges, weights: dict[str, float]) -> float:
    total = 0.0
    for h, (lo, hi) in ranges.items():
        width = abs(whole[h][1] - whole[h][0])
        total += weights.get(h, 1.0) * abs(hi - lo) / width if width else 0.0
    return total


def point(item: Item) -> Ranges:
    return {h: (v, v) for h, v in item.values.items()}


def enlargement(ranges: Ranges, more: Ranges, whole: Ranges, weights: dict[str, float]) -> float:
    if not ranges:
        return 0.0
    return (loss(joined(ranges, more), whole, weights) - loss(ranges, whole, weights)) / len(ranges)


def split(cluster: Cluster, k: int, l: int, whole: Ranges, weights: dict[str, float], seed: object) -> list[Cluster]:  # noqa: E741
    """Sub-clusters of at least k individuals and l sensitive values each; [cluster] where that is impossible.

    One tuple an individual stands for it. Every round takes from each sensitive value's bucket
    its proportional share nearest to a seed tuple; what is left joins the sub-cluster it
    enlarges least, and an individual's further tuples follow it. The input is not changed.
    """
    chosen: dict[object, Item] = {}
    for x in sorted(cluster.items, key=lambda x: (uniform(seed, "pid", x.id), str(x.id))):
        chosen.setdefault(x.pid, x)
    buckets: dict[object, list[Item]] = {}
    for x in chosen.values():
        buckets.setdefault(x.sensitive, []).append(x)
    parts: list[Cluster] = []
    while len(buckets) >= l and (total := sum(map(len, buckets.values()))) >= k:
        start = min((x for b in buckets.values() for x in b), key=lambda x: (uniform(seed, "start", len(parts), x.id), str(x.id)))
        near = lambda x, r=point(start): (enlargement(r, point(x), whole, weights), str(x.id))
        taken: list[Item] = []
        for name in buckets:
            quota = int(max(k * len(buckets[name]) / total, 1))
            taken += sorted(buckets[name], key=near)[:quota]
        ids = set(map(id, taken))
        for x in sorted((x for b in buckets.values() for x in b if id(x) not in ids), key=near)[: max(0, k - len(taken))]:
            taken.append(x)
        part = Cluster.of(taken)
        if part.k_size < k or part.diversity < l:
            break
        parts.append(part)
        ids = set(map(id, taken))
        buckets = {name: rest for name, b in buckets.items() if (rest := [x for x in b if id(x) not in ids])}
    if not parts:
        return [cluster]
    for x in (x for b in buckets.values() for x in b):
        min(enumerate(parts), key=lambda p: (enlargement(p[1].ranges, point(x), whole, weights), p[0]))[1].insert(x)
    home = {x.pid: p for p in parts for x in p.items}
    standing = {id(x) for p in parts for x in p.items}
    for x in cluster.items:
        if id(x) not in standing:
            home[x.pid].insert(x)
    return parts


@dataclass
class Released:
    id: str
    values: dict[str, float]
    ranges: Ranges
    sample: dict[str, float]
    cluster: int
    size: int
    passed: object = None


@dataclass
class State:
    ranges: Ranges = field(default_factory=dict)
    waiting: list[Item] = field(default_factory=list)
    open: dict[int, Cluster] = field(default_factory=dict)
    published: list[tuple[int, int, Ranges, dict[str, float]]] = field(default_factory=list)
    uses: dict[int, int] = field(default_factory=dict)
    losses: list[float] = field(default_factory=list)
    next_cluster: int = 0
    next_release: int = 0
    suppressed: int = 0


class Castle:
    def __init__(self, config: CastleConfig, state: State | None = None):
        self.c, self.s = config, state or State()
        self.weights = weights_of(config.headers, config.weights)

    # Clusters.

    def _tau(self) -> float:
        if self.c.shipped:
            return math.inf
        if recent := self.s.losses[-self.c.mu :]:
            return sum(recent) / len(recent)
        if self.s.open:
            return sum(loss(x.ranges, self.s.ranges, self.weights) for x in self.s.open.values()) / len(self.s.open)
        return math.inf

    def _choose(self, item: Item) -> int | None:
        """Number of the cluster for the tuple; None: a new one."""
        here = point(item)
        grown = {n: enlargement(x.ranges, here, self.s.ranges, self.weights) for n, x in self.s.open.items()}
        if not grown:
            return None
        least = min(grown.values())
        least_grown = [n for n, g in grown.items() if g == least]
        tau = self._tau()
        fine = [n for n in least_grown if loss(joined(self.s.open[n].ranges, here), self.s.ranges, self.weights) <= tau]
        if fine:
            return min(fine, key=lambda n: (len(self.s.open[n].items), n))
        if len(self.s.open) < self.c.beta:
            return None
        return min(least_grown, key=lambda n: (len(self.s.open[n].items), n))

    def _many(self, cluster: Cluster) -> int:
        """What k counts: individuals, or tuples in the shipped behaviour."""
        return len(cluster.items) if self.c.shipped else cluster.individuals

    def _ready(self, cluster: Cluster) -> bool:
        varied = cluster.diversity > self.c.l if self.c.shipped else cluster.diversity >= self.c.l
        return self._many(cluster) >= self.c.k and varied

    def _home(self, item: Item) -> int | None:
        return next((n for n, x in self.s.open.items() if any(y is item for y in x.items)), None)

    def _leave(self, number: int, item: Item) -> None:
        cluster = self.s.open[number]
        cluster.remove(item)
        if not cluster.items:
            del self.s.open[number]

    # Output.

    def _as(self, item: Item, number: int, size: int, ranges: Ranges, sample: dict[str, float]) -> Released:
        return Released(item.id, {h: (lo + hi) / 2 for h, (lo, hi) in ranges.items()}, ranges, sample, number, size, item.passed)

    def _release(self, number: int) -> list[Released]:
        cluster = self.s.open.pop(number)
        parts = [cluster]
        if cluster.k_size >= 2 * self.c.k and cluster.diversity >= self.c.l:
            parts = split(cluster, self.c.k, self.c.l, self.s.ranges, self.weights, self.c.seed)
        out = []
        for part in parts:
            self.s.next_release += 1
            sample = {h: min(part.items, key=lambda x: uniform(self.c.seed, "sample", h, x.id)).values[h] for h in part.ranges}
            out += [self._as(x, self.s.next_release, len(part.items), part.ranges, sample) for x in part.items]
            lost = loss(part.ranges, self.s.ranges, self.weights)
            good = lost < self._tau()
            self.s.losses = [*self.s.losses, lost][-self.c.mu :]
            if good:
                self._publish((self.s.next_release, len(part.items), dict(part.ranges), sample))
        gone = {id(x) for x in cluster.items}
        self.s.waiting = [x for x in self.s.waiting if id(x) not in gone]
        return out

    def _publish(self, made: tuple[int, int, Ranges, dict[str, float]]) -> None:
        """Keep a cluster for reuse. The first that bounds a tuple is reused, so one that lies in an earlier one never is."""
        if not self.c.published and self.c.outlier == "suppress" and any(all(lo <= made[2][h][0] and made[2][h][1] <= hi for h, (lo, hi) in x[2].items()) for x in self.s.published):
            return
        self.s.published.append(made)
        if self.c.published:
            del self.s.published[: -self.c.published]

    def _reuse(self, item: Item) -> Released | None:
        for number, size, ranges, sample in self.s.published:
            if all(lo <= item.values[h] <= hi for h, (lo, hi) in ranges.items()):
                self.s.uses[number] = self.s.uses.get(number, 0) + 1
                return self._as(item, number, size, ranges, sample)
        return None

    def _outlier(self, number: int, item: Item) -> list[Released]:
        self._leave(number, item)
        if self.c.outlier == "most_used" and self.s.published:
            best = max(self.s.published, key=lambda p: (self.s.uses.get(p[0], 0), p[0]))
            return [self._as(item, *best)]
        self.s.suppressed += 1
        return []

    def _expire(self, item: Item) -> list[Released]:
        number = self._home(item)
        if number is None:
            return []
        cluster = self.s.open[number]
        if self._ready(cluster):
            return self._release(number)
        if reused := self._reuse(item):
            self._leave(number, item)
            return [reused]
        larger = sum(len(x.items) > len(cluster.items) for x in self.s.open.values())
        everyone = Cluster([x for c in self.s.open.values() for x in c.items])
        if larger > len(self.s.open) // 2 or self._many(everyone) < self.c.k or everyone.diversity < self.c.l:
            return self._outlier(number, item)
        while self._many(cluster) < self.c.k or cluster.diversity < self.c.l:
            other = min((n for n in self.s.open if n != number), key=lambda n: (enlargement(cluster.ranges, self.s.open[n].ranges, self.s.ranges, self.weights), n))
            for x in self.s.open.pop(other).items:
                cluster.insert(x)
        return self._release(number)

    # Input.

    def push(self, item: Item) -> list[Released]:
        """Take a tuple; return what is released now."""
        if self.c.noise and uniform(self.c.seed, "keep", item.id) > self.c.sample:
            return []
        self.s.ranges = joined(self.s.ranges, point(item))
        if self.c.noise:
            scales = {h: max(self.s.ranges[h][1] - self.s.ranges[h][0], 1.0) / self.c.phi for h in item.values}
            item = Item(item.id, {h: v + laplace(scales[h], self.c.seed, "noise", h, item.id) for h, v in item.values.items()}, item.sensitive, item.pid, item.passed)
        number = self._choose(item)
        if number is None:
            number = self.s.next_cluster
            self.s.next_cluster += 1
            self.s.open[number] = Cluster()
        self.s.open[number].insert(item)
        self.s.waiting.append(item)
        if len(self.s.waiting) > self.c.delta:
            return self._expire(self.s.waiting.pop(0))
        return []

    def flush(self) -> list[Released]:
        """Evaluate all tuples that still wait, oldest first."""
        out = []
        while self.s.waiting:
            out += self._expire(self.s.waiting.pop(0))
        return out

    def suppress(self, item: Item) -> None:
        """Forget a tuple; one that is not held changes nothing."""
        self.s.waiting = [x for x in self.s.waiting if x is not item]
        number = self._home(item)
        if number is not None:
            self._leave(number, item)

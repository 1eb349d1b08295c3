"""Golden values of the cluster arithmetic, and invariants of both algorithms."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veilspark.config import CastleConfig, DocaConfig, PipelineConfig, weights_of
from veilspark.streaming.castle import Castle, Cluster, Item, enlargement, joined, loss, point, split
from veilspark.streaming.doca import Doca, deviation, settled
from veilspark.streaming.draws import laplace, uniform
from veilspark.streaming.quantiles import QuantileSummary

HEADERS = ("series", "energy")
WHOLE = {"series": (0.0, 100.0), "energy": (0.0, 1000.0)}
ONE = {h: 1.0 for h in HEADERS}


def tuples(*pairs):
    return [Item(str(i), {"series": float(a), "energy": float(b)}, sensitive=float(b), pid=i) for i, (a, b) in enumerate(pairs)]


def cluster(*pairs):
    return Cluster.of(tuples(*pairs))


@pytest.mark.parametrize(("has", "tuple_", "expected"), [([(5, 300), (4, 200)], (2, 250), 0.01), ([(2, 200), (5, 300)], (2, 250), 0.0)])
def test_tuple_enlargement(has, tuple_, expected):
    assert enlargement(cluster(*has).ranges, point(tuples(tuple_)[0]), WHOLE, ONE) == pytest.approx(expected, abs=1e-9)


@pytest.mark.parametrize(("a", "b", "expected"), [([(5, 300), (4, 200)], [(2, 250), (1, 500)], 0.115), ([(5, 300), (1, 500)], [(4, 200), (2, 250)], 0.05)])
def test_cluster_enlargement(a, b, expected):
    assert enlargement(cluster(*a).ranges, cluster(*b).ranges, WHOLE, ONE) == pytest.approx(expected, abs=1e-9)


@pytest.mark.parametrize(("has", "more", "expected"), [([], [(1, 200)], 0), ([(1, 200)], [(5, 300)], 0.14), ([(1, 200), (5, 300)], [(2, 250)], 0.14), ([(1, 200), (5, 300)], [(2, 250), (2, 100)], 0.24), ([], [], 0)])
def test_loss_given(has, more, expected):
    assert loss(joined(cluster(*has).ranges, cluster(*more).ranges), WHOLE, ONE) == pytest.approx(expected, abs=1e-9)


def test_distance_bounds_and_contents():
    c = cluster((1, 200), (4, 400))
    t = tuples((4, 400))[0]
    assert c.distance(t) == 201.0
    assert not Cluster().bounds(t)
    assert c.bounds(t) and not cluster((1, 200)).bounds(t)
    first, second, third = tuples((1, 2), (5, 1), (4, 6))
    c = Cluster.of([first, second, third])
    c.insert(first)
    assert len(c.items) == 3
    c.remove(first)
    assert c.ranges == {"series": (4.0, 5.0), "energy": (1.0, 6.0)} and c.diversity == 2
    c.insert(first)
    c.remove(second)
    assert c.ranges == {"series": (1.0, 4.0), "energy": (2.0, 6.0)}
    c.remove(second)
    assert len(c.items) == 2


def test_quantiles():
    q = QuantileSummary(0.01)
    for v in (10, 20, 30, 40, 50):
        q.add(v)
    assert [q.quantile(p) for p in (0.25, 0.5, 0.75)] == [20, 30, 40]
    for v in (60, 70, 80, 90, 100):
        q.add(v)
    assert [q.quantile(p) for p in (0.25, 0.5, 0.75)] == [30, 50, 80]
    with pytest.raises(ValueError):
        QuantileSummary(0.01).quantile(0.5)


def test_quantile_summary_stays_small_and_near():
    rng, q = random.Random(1), QuantileSummary(0.02)
    values = [rng.random() for _ in range(5000)]
    for v in values:
        q.add(v)
    assert len(q.values) < 500
    for p in (0.05, 0.3, 0.9):
        rank = sorted(values).index(q.quantile(p)) + 1
        assert abs(rank - (p * 4999 + 1)) <= 0.02 * 5000 + 1


def test_shipped_default_is_a_tumbling_window():
    rng, core, out = random.Random(2), Castle(CastleConfig(shipped=True, headers=("v",), sensitive="v")), []
    values = [rng.random() * 100 for _ in range(500)]
    for i, v in enumerate(values):
        out += core.push(Item(str(i), {"v": v}, sensitive=v))
    expected = []
    for lo in range(0, 495, 11):
        block = values[lo : lo + 11]
        expected += [(str(lo + k), (min(block) + max(block)) / 2) for k in range(11)]
    assert [(x.id, x.values["v"]) for x in out] == expected


CG = [(1, 200, 5), (2, 300, 5), (3, 400, 3), (4, 500, 2), (5, 600, 1), (6, 700, 0)]


def cg_item(i, row):
    return Item(str(i), dict(zip(("series", "energy", "station"), map(float, row), strict=True)), sensitive=float(row[2]), pid=row[0])


def cg(**changes):
    return Castle(CastleConfig(k=3, delta=10, beta=5, mu=5, l=1, phi=100 * math.log(2), headers=("series", "energy", "station"), sensitive="station", **changes))


def test_first_insert_with_and_without_noise():
    noisy = cg(noise=True)
    assert noisy.push(cg_item(0, CG[0])) == []
    assert len(noisy.s.open) == 1 and next(iter(noisy.s.open.values())).items[0].values["station"] != 5.0
    assert noisy.s.ranges == {"series": (1, 1), "energy": (200, 200), "station": (5, 5)}
    plain = cg()
    plain.push(cg_item(0, CG[0]))
    assert next(iter(plain.s.open.values())).items[0].values == {"series": 1.0, "energy": 200.0, "station": 5.0}


def test_sampling_nothing_and_waiting():
    none = cg(noise=True, sample=0.0)
    assert none.push(cg_item(0, CG[0])) == [] and not none.s.open
    waiting = cg()
    assert [x for i, row in enumerate(CG) for x in waiting.push(cg_item(i, row))] == []


def test_suppress():
    core = cg()
    items = [cg_item(i, row) for i, row in enumerate(CG)]
    for x in items:
        core.push(x)
    core.suppress(cg_item(99, CG[0]))
    assert len(core.s.waiting) == 6
    for x in items:
        core.suppress(x)
    assert not core.s.waiting and not core.s.open


MERGE = [(1, 7000, 44.5, 7000, 1), (2, 8000, 55.5, 9000, 1), (3, 9000, 66.5, 9000, 1), (4, 10000, 77.5, 12000, 2), (5, 6000, 38.5, 20000, 2), (6, 7000, 44.5, 15000, 3), (2, 2000, 10.5, 9000, 1)]
MERGE_WHOLE = {"time": (100.0, 20000.0), "kwh": (0.0, 100.0), "potential": (0.0, 20000.0)}


def merge_item(i, row):
    return Item(str(i), {"time": float(row[1]), "kwh": float(row[2]), "potential": float(row[3])}, sensitive=row[4], pid=row[0])


def test_merge_reaches_k_and_l():
    core = Castle(CastleConfig(k=4, l=3, delta=0, headers=("time", "kwh", "potential"), sensitive="x"))
    items = [merge_item(i, r) for i, r in enumerate(MERGE)]
    core.s.ranges = dict(MERGE_WHOLE)
    core.s.open = {0: Cluster.of(items[3:5]), 1: Cluster.of(items[:3]), 2: Cluster.of(items[5:])}
    core.s.losses = [0.0]
    out = core._expire(items[0])
    assert len(out) >= 4 and len({items[int(x.id)].sensitive for x in out}) >= 3


@pytest.mark.parametrize(
    ("rows", "k", "l"),
    [(MERGE, 3, 3), ([(p, 1000, 44.5, 7000, 0) for p in (2, 3, 3, 1, 1, 4, 1, 1, 5, 1)], 3, 1), ([(p, 100 * p, p, 10 * p, s) for s in (0, 1) for p in range(1, 11)], 3, 2)],
)
def test_split_invariants(rows, k, l):  # noqa: E741
    items = [merge_item(i, r) for i, r in enumerate(rows)]
    parts = split(Cluster.of(items), k, l, MERGE_WHOLE, {}, 3)
    assert sorted(x.id for p in parts for x in p.items) == sorted(x.id for x in items)
    for p in parts:
        assert p.k_size >= k and p.diversity >= l
    home = {}
    for n, p in enumerate(parts):
        for x in p.items:
            assert home.setdefault(x.pid, n) == n


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(-1e3, 1e3), st.integers(0, 4), st.integers(0, 12)), max_size=120), st.integers(1, 5), st.integers(1, 3), st.integers(0, 15), st.booleans())
def test_castle_releases_are_private(rows, k, l, delta, noise):  # noqa: E741
    core, out = Castle(CastleConfig(k=k, l=l, delta=delta, beta=3, headers=("v",), noise=noise)), []
    sensitive = {}
    for i, (v, s, p) in enumerate(rows):
        sensitive[str(i)] = s
        out += core.push(Item(str(i), {"v": v}, sensitive=s, pid=p))
        assert len(core.s.waiting) <= delta and len(core.s.losses) <= core.c.mu
    out += core.flush()
    assert len({x.id for x in out}) == len(out)
    assert len(out) + core.s.suppressed == len(rows)
    fresh = {}
    for x in out:
        fresh.setdefault(x.cluster, []).append(x)
        lo, hi = x.ranges["v"]
        assert lo <= x.values["v"] <= hi and x.size >= k
        if not noise and x.id in sensitive:
            assert lo <= rows[int(x.id)][0] <= hi
    for members in fresh.values():
        assert len(members) >= k and len({sensitive[x.id] for x in members}) >= l


@settings(max_examples=40, deadline=None)
@given(st.lists(st.floats(-1e3, 1e3), max_size=150), st.integers(0, 20), st.sampled_from([1.0, 0.8]))
def test_doca_outputs_each_tuple_at_most_once(values, delay, delta):
    core, out = Doca(DocaConfig(headers=("v",), delay=delay, delta=delta, window=20)), []
    for i, v in enumerate(values):
        out += core.push(Item(str(i), {"v": v}))
        assert len(core.s.open) <= core.c.beta and len(core.s.waiting) <= delay
    out += core.flush()
    assert len({x.id for x in out}) == len(out)
    assert len(out) + core.s.suppressed + len(core.s.held) == len(values)


def test_doca_members_share_a_value_and_noise_is_scaled():
    core = Doca(DocaConfig(headers=("v",), delay=4, eps=1e9))
    out = []
    for i in range(60):
        out += core.push(Item(str(i), {"v": float(i % 7)}))
    groups = {}
    for x in out:
        groups.setdefault(x.cluster, set()).add(x.values["v"])
    assert groups and all(len(v) == 1 for v in groups.values())


def test_stability_and_deviation():
    assert deviation([1, 1, 4, 4]) == 1.5
    assert settled([5.0] * 10, 10, 0.8) and not settled([5.0] * 9, 10, 0.8)
    assert not settled([0.0] * 10, 10, 0.8)


def test_draws():
    draws = [laplace(2.0, 1, i) for i in range(20000)]
    assert abs(sum(draws) / 20000) < 0.1 and abs(sum(map(abs, draws)) / 20000 - 2.0) < 0.1
    assert 0 < uniform(0, "a") < 1 and uniform(0, "a") == uniform(0, "a") != uniform(1, "a")


def test_configuration():
    text = "k=3\ndelta=10\nbeta=5\nbigBeta=1\nmu=5\nl=3\nphi=0.693148\nuseDiffPrivacy=False\nheaders=kwh\nsensitive_attribute=kwh\n# note"
    assert CastleConfig.from_properties(text) == CastleConfig()
    assert DocaConfig.from_properties("eps=200\ndelay_constraint=100\nbeta=5\ndelta=1\n") == DocaConfig()
    assert PipelineConfig.from_properties("input-topic=a\nanonymized_fields=x,y\nprioritization=1,2").weights == (1.0, 2.0)
    for bad in ({"k": 0}, {"phi": 0.0}, {"weights": (1.0, 2.0)}, {"outlier": "x"}):
        with pytest.raises(ValueError):
            CastleConfig(**bad)
    with pytest.raises(ValueError):
        PipelineConfig(algorithm="none")
    assert weights_of(("a", "b"), ()) == {"a": 1.0, "b": 1.0}


def test_outlier_most_used():
    core = Castle(CastleConfig(k=2, l=1, delta=0, beta=5, headers=("v",), outlier="most_used"))
    core.s.published = [(7, 2, {"v": (0.0, 10.0)}, {"v": 1.0})]
    out = core.push(Item("a", {"v": 99.0}, sensitive=1))
    assert [(x.id, x.values["v"], x.cluster) for x in out] == [("a", 5.0, 7)]


def full(**changes):
    """A core with 10,000 published clusters side by side that then releases [-1, 0], and [2.2, 2.4] within the third."""
    core = Castle(CastleConfig(k=2, l=1, delta=0, beta=5, headers=("v",), **changes))
    core.s.published = [(n, 2, {"v": (float(n), n + 0.5)}, {"v": float(n)}) for n in range(10_000)]
    core.s.next_release, core.s.ranges, core.s.losses = 20_000, {"v": (-100.0, 10_000.0)}, [1.0]
    for a, b in ((-1.0, 0.0), (2.2, 2.4)):
        core.s.open[0] = Cluster.of([Item(f"{a}", {"v": a}, sensitive=1, pid=1), Item(f"{b}", {"v": b}, sensitive=2, pid=2)])
        core._release(0)
    return core


def test_published_clusters_stay():
    core = full()
    assert core._reuse(Item("x", {"v": 0.25})).cluster == 0 and core._reuse(Item("x", {"v": -0.5})).cluster == 20_001
    assert core._reuse(Item("x", {"v": 2.3})).cluster == 2 and len(core.s.published) == 10_001
    few = full(published=5)
    assert few._reuse(Item("x", {"v": 0.25})) is None and [x[0] for x in few.s.published] == [9997, 9998, 9999, 20_001, 20_002]
    assert len(full(outlier="most_used").s.published) == 10_002
    assert CastleConfig.from_properties("published=7").published == 7


def test_yaml_and_pipeline_values():
    from veilspark.config import PipelineConfig, parse_yaml

    text = "# settings\ndata:\n  type: \"ev\"  # kind\n  delay: 0.3\nfields:\n  - kwh\n  - power\nlist: [a, 'b']\n"
    assert parse_yaml(text) == {"data.type": "ev", "data.delay": "0.3", "fields": "kwh,power", "list": "a,b"}
    config = PipelineConfig.from_yaml("algorithm: doca-alt\nanonymized_fields: [kwh, power]\ninput-topic: in\nenable-metrics: false")
    assert config.algorithm == "doca-alt" and config.anonymized_fields == ("kwh", "power") and config.source == "in" and not config.metrics


def test_held_tuples_can_be_bounded():
    from veilspark.config import DocaConfig
    from veilspark.streaming.castle import Item
    from veilspark.streaming.doca import Doca

    core = Doca(DocaConfig(delta=0.5, held=10, window=1000))
    for i in range(50):
        assert core.push(Item(str(i), {"kwh": float(i)})) == []
    assert len(core.s.held) == 10 and core.s.suppressed == 40


def test_day_seed():
    import datetime

    from veilspark.operators.forecast import day_seed

    assert day_seed(datetime.datetime(2024, 2, 1)) == 32 and 1 <= day_seed() <= 366

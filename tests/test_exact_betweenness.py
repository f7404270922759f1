"""Betweenness over all sources, whatever their number, against plain Brandes in whole numbers."""

import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from depweave.operators import centrality, metrics


def brandes(pairs, n, sources):
    out = defaultdict(list)
    for a, b in pairs:
        out[a].append(b)
    total = [Fraction(0)] * n
    for s in sources:
        dist, sigma, order, before = {s: 0}, defaultdict(int, {s: 1}), [s], defaultdict(list)
        for v in order:
            for w in out[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    order.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v]
                    before[w].append(v)
        delta = defaultdict(Fraction)
        for w in reversed(order):
            for v in before[w]:
                delta[v] += Fraction(sigma[v], sigma[w]) * (1 + delta[w])
            if w != s:
                total[w] += delta[w]
    return [float(x) for x in total]


def band(rng, n, reach, edges):
    """Repeated edges and loops between near numbers, islands beside them, all renumbered at random."""
    pairs = [(a, min(n - 1, max(0, a + rng.randint(-reach, reach)))) for a in (rng.randrange(n) for _ in range(edges))]
    pairs = [(a, b) for a, b in pairs if not n // 3 in (a, b)]
    name = rng.sample(range(n), n)
    return [(name[a], name[b]) for a, b in pairs]


def sums(pairs, n, sources, kernel=centrality.dependencies):
    src, dst = (np.array(x) for x in zip(*sorted(pairs), strict=True))
    return kernel(src, dst, n, np.array(sources))


@pytest.mark.parametrize("n, reach, edges", [(400, 4, 2400), (300, 3, 700), (250, 250, 900), (60, 2, 40)])
def test_kernels(n, reach, edges):
    pairs = band(random.Random(n), n, reach, edges)
    expected = pytest.approx(brandes(pairs, n, range(n)), rel=1e-12, abs=1e-9)
    assert sums(pairs, n, range(n)) == expected
    assert sums(pairs, n, range(n), centrality.by_states) == expected


def test_fronts_are_shared():
    """On a long graph later sources join what is kept, and the sums stay the same."""
    rng, n = random.Random(5), 3000
    pairs = sorted({(a, b) for a in range(n) for b in rng.sample(range(max(0, a - 3), min(n, a + 4)), 4)})
    starts, ends = (np.array(x) for x in zip(*pairs, strict=True))
    fronts, sources = centrality.Fronts(starts, ends, np.ones(len(pairs)), n), np.arange(1200, 1500)
    for group in np.split(sources, range(48, 300, 48)):
        fronts.add(group)
    joined = sum(len(run.joined) for run in fronts.runs)
    assert fronts.sums() == pytest.approx(centrality.by_states(starts, ends, n, sources), rel=1e-12, abs=1e-9) and joined > 2


def test_more_paths_than_a_double_holds():
    """1,100 diamonds in a row have 2 ** 1100 shortest paths; beside them a way of single edges."""
    pairs, n = [], 3301
    for k in range(0, 3300, 3):
        pairs += [(k, k + 1), (k, k + 2), (k + 1, k + 3), (k + 2, k + 3)]
    pairs += [(0, n)] + [(n + k, n + k + 1) for k in range(2300)]
    n += 2301
    expected = pytest.approx(brandes(pairs, n, [0, 30, 1500]), rel=1e-12, abs=1e-9)
    assert sums(pairs, n, [0, 30, 1500]) == expected
    assert sums(pairs, n, [0, 30, 1500], centrality.by_states) == expected


def test_full_metrics_take_every_source(make_graph):
    pairs = sorted(set(band(random.Random(7), 320, 5, 1500)))
    nodes, edges = make_graph(" ".join(f"{a:03}>{b:03}" for a, b in pairs))
    got = {r["id"]: r["betweenness"] for r in metrics.compute_metrics(nodes, edges).collect()}
    expected = brandes(pairs, 320, range(320))
    assert len(got) > 200 and got == pytest.approx({i: expected[int(i)] for i in got}, rel=1e-12, abs=1e-9)

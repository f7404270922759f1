"""Exact dependency sums (Brandes) of many sources over one graph, held as numbers by one task.

`Fronts` takes sources that lie close together as the columns of one matrix, a level at a time. Where the rest of the
graph falls apart into places that no edge joins, each is followed alone. Columns that have the same front, the same
nodes left to see and the same shares of paths (to rounding) have the same sums from there on: one of them stands for
all, also for those of later sources. `by_states` takes any graph, state by state; it is slower.
"""

from __future__ import annotations

import numpy as np

#: States (source and node) that are held at once, 40 bytes each.
STATES = 4_000_000
#: Numbers of the fronts that are held at once, and again of those kept for later sources.
HELD = 24_000_000
#: Sources followed side by side.
WIDTH = 48
#: Columns of at most so many sources are kept for later ones.
KEPT_WIDTH = 16
#: Multiplications of one call of the matrix library.
PRODUCT = 250_000
#: Levels between two looks at what can be followed alone or together, and how deep these may nest.
EVERY, DEEPEST = 4, 200
#: Shares of paths that differ by less are the same: a few units in the last place of a double.
SAME = 4e-15


class Unsuited(Exception):
    """The fronts of this graph are too wide or too uneven for matrices."""


def out_edges(first: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each edge out of the nodes: the place of its start among them, and its own place in the sorted edges."""
    counts = first[nodes + 1] - first[nodes]
    place = np.repeat(np.arange(len(nodes)), counts)
    return place, np.arange(len(place)) + np.repeat(first[nodes] - (np.cumsum(counts) - counts), counts)


def once(values: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Each value once; slot is room for a number a node."""
    slot[values] = np.arange(len(values))
    return values[slot[values] == np.arange(len(values))]


def by_states(starts: np.ndarray, ends: np.ndarray, n: int, sources: np.ndarray, times: np.ndarray | None = None, states: int = STATES) -> np.ndarray:
    """Dependency sums of some sources over the edges sorted by start; an edge counts as `times` paths.

    Several sources go level by level together, as states source * n + node, so that a long graph costs few steps. The
    number of paths to a state is sigma * 2 ** power, as it soon leaves the range of a double.
    """
    first = np.searchsorted(starts, np.arange(n + 1))
    times = np.ones(len(ends)) if times is None else times
    total = np.zeros(n)
    at_once = max(1, states // max(n, 1))

    def steps(level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each edge out of the states: the place of its start in the level, the state at its end, and its times."""
        node = level % n
        place, edge = out_edges(first, node)
        return place, (level - node)[place] + ends[edge], times[edge]

    for group in np.split(sources, range(at_once, len(sources), at_once)):
        size = n * len(group)
        dist, sigma, power, slot = np.full(size, -1, np.int32), np.zeros(size), np.zeros(size, np.int32), np.zeros(size, np.int32)
        level, levels = np.arange(len(group)) * n + group, []
        dist[level], sigma[level] = 0, 1
        while len(level):
            levels.append(level)
            place, v, m = steps(level)
            fresh = once(v[dist[v] < 0], slot)
            dist[fresh], slot[fresh] = len(levels), np.arange(len(fresh))
            on = dist[v] == len(levels)
            place, to = place[on], slot[v[on]]
            top = np.full(len(fresh), np.iinfo(np.int32).min, np.int32)
            np.maximum.at(top, to, power[level][place])
            sums = np.bincount(to, weights=np.ldexp(sigma[level][place] * m[on], power[level][place] - top[to]), minlength=len(fresh))
            sigma[fresh], more = np.frexp(sums)
            power[fresh] = top + more
            level = fresh
        delta = np.zeros(size)
        for depth in range(len(levels) - 2, -1, -1):
            level = levels[depth]
            place, v, m = steps(level)
            on = dist[v] == depth + 1
            place, v = place[on], v[on]
            share = np.ldexp(sigma[level][place] * m[on] / sigma[v], power[level][place] - power[v])
            delta[level] = np.bincount(place, weights=share * (1 + delta[v]), minlength=len(level))
        delta[levels[0]] = 0
        total += delta.reshape(len(group), n).sum(axis=0)
    return total


def local_order(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """The nodes so that neighbours lie close: component by component, by hops (either way) from a node at its rim."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[src], label[dst])
        new = label.copy()
        np.minimum.at(new, label[src], low)
        np.minimum.at(new, label[dst], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    both = np.concatenate([src, dst])
    order = np.argsort(both, kind="stable")
    ends, first = np.concatenate([dst, src])[order], np.searchsorted(both[order], np.arange(n + 1))

    def hops(level: np.ndarray) -> np.ndarray:
        dist, slot, d = np.full(n, -1), np.zeros(n, np.int64), 0
        while len(level):
            dist[level] = d
            d += 1
            v = ends[out_edges(first, level)[1]]
            level = once(v[dist[v] < 0], slot)
        return dist

    order = np.lexsort((hops(np.unique(label)), label))
    rim = order[np.append(label[order][1:] != label[order][:-1], True)] if n else order
    return np.lexsort((hops(rim), label))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b, in parts so small that the library does not start threads for them: every core has a task of its own."""
    columns = max(1, PRODUCT // max(a.size, 1))
    if columns >= b.shape[1]:
        return a @ b
    return np.concatenate([a @ np.ascontiguousarray(b[:, c:c + columns]) for c in range(0, b.shape[1], columns)], axis=1)


class _Run:
    """What is kept of some columns: the sums at each level, and the sources that join them there."""

    def __init__(self, width: int):
        self.width, self.rows, self.delta, self.joined, self.goes_on = width, [], [], {}, []

    def join(self, level: int, columns: np.ndarray, weight: np.ndarray) -> None:
        np.add.at(self.joined.setdefault(level, np.zeros(self.width)), columns, weight)


class Fronts:
    """Dependency sums over a graph whose distinct edges are sorted by start; nodes are numbered by local_order()."""

    def __init__(self, starts: np.ndarray, ends: np.ndarray, times: np.ndarray, n: int):
        self.n, self.ends, self.times = n, ends, times
        self.first = np.searchsorted(starts, np.arange(n + 1))
        far = np.arange(n)
        np.maximum.at(far, np.minimum(starts, ends), np.maximum(starts, ends))
        self.crossing = np.maximum.accumulate(far)  # the last node that an edge from here or before leads to or comes from
        self.mark = np.random.default_rng(1).integers(0, 2**64, (n, 2), np.uint64)
        self.reached = np.bincount(ends, minlength=n) > 0
        self.slot = np.zeros(n, np.int64)
        self.total = np.zeros(n)
        self.runs, self.known, self.kept, self.held = [], {}, 0, 0

    def add(self, sources: np.ndarray) -> None:
        """The sums of some sources that lie close together."""
        level, width = np.sort(sources), len(sources)
        unseen = np.repeat(self.reached[:, None], width, axis=1)
        unseen[level, np.arange(width)] = False
        before, self.held = self.total.copy(), 0
        runs = len(self.runs)
        try:
            self._follow(level, np.eye(width), unseen, 0, np.ones(width), 0)
        except Unsuited:
            if len(self.runs) == runs:
                self.total = before
            raise

    def sums(self) -> np.ndarray:
        """All sums, once all sources are added."""
        for run in reversed(self.runs):
            weight = np.zeros(run.width)
            for level, (rows, delta) in enumerate(zip(run.rows, run.delta, strict=True)):
                if level:
                    self.total[rows] += delta @ weight
                weight += run.joined.get(level, 0.0)
            for child, level, own, other in run.goes_on:
                child.join(level, other, weight[own])
        self.runs, self.known = [], {}
        return self.total

    def _keys(self, level: np.ndarray, sigma: np.ndarray, rest: np.ndarray) -> list[tuple]:
        return [(rest[0, c], rest[1, c], level[sigma[:, c] > 0].tobytes()) for c in range(sigma.shape[1])]

    def _alike(self, level: np.ndarray, sigma: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
        """(columns that stand for others, the number of its own for each column or -1, [(column, run, level, its column)])."""
        share = sigma / sigma.max(axis=0)
        of, found, group, hits = {}, [], np.full(sigma.shape[1], -1), []
        for c, key in enumerate(self._keys(level, sigma, rest)):
            own = share[sigma[:, c] > 0, c]
            total = own.sum()
            same = lambda other, its: abs(total - its) <= 2 * SAME * total and (np.abs(own - other) <= SAME * own).all()  # noqa: B023, E731
            hit = next((k for k in self.known.get(key, ()) if same(*k[3:])), None)
            if hit:
                hits.append((c, *hit[:3]))
                continue
            number = next((k for k, *other in of.setdefault(key, []) if same(*other)), None)
            if number is None:
                number = len(found)
                of[key].append((number, own, total))
                found.append(c)
            group[c] = number
        return np.array(found, np.int64), group, hits

    def _follow(self, level: np.ndarray, sigma: np.ndarray, unseen: np.ndarray, low: int, weight: np.ndarray | None, deep: int) -> tuple[np.ndarray, _Run | None]:
        """The sums at the first level, of each column; those beyond it are added to the total, by weight.

        `unseen` begins at node `low`. Without a weight the columns are kept, and what joins them counts in sums().
        """
        width = sigma.shape[1]
        run = _Run(width) if weight is None else None
        left = np.count_nonzero(unseen, axis=1)
        mark, some = self.mark[low:low + len(left)], np.flatnonzero((left > 0) & (left < width))
        rest = np.stack([mark[left == width, k].sum(dtype=np.uint64) + (unseen[some] * mark[some, k, None]).sum(axis=0, dtype=np.uint64) for k in (0, 1)])
        levels, looks, delta, scale = [], [], None, None

        def go_on(own_level, own_sigma, own_unseen, own_low, columns, others):
            """Follow some of the rows or columns alone; `others` are their numbers there."""
            kept = run is not None or (own_sigma.shape[1] <= KEPT_WIDTH and self.kept < HELD)
            some = None if kept else np.bincount(others, weight[columns], own_sigma.shape[1])
            sums, child = self._follow(own_level, own_sigma, own_unseen, own_low, some, deep + 1)
            hand_on(child, 0, columns, others)
            return sums

        def hand_on(child, at, columns, others):
            if child is not None:
                if run is not None:
                    run.goes_on.append((child, at, columns, others))
                else:
                    child.join(at, others, weight[columns])

        while True:
            levels.append((level, sigma, scale))
            self.held += sigma.size
            if self.held > HELD:
                raise Unsuited
            if len(levels) % (EVERY if width <= KEPT_WIDTH else 4 * EVERY) == 1 and deep < DEEPEST and len(levels) + deep > 1:
                active = left > 0
                active[level - low] = True
                active = np.flatnonzero(active) + low
                cut = np.flatnonzero(self.crossing[active[:-1]] < active[1:]) + 1
                bounds = np.unique(np.searchsorted(level, active[cut]))
                bounds = bounds[(bounds > 0) & (bounds < len(level))]
                if len(bounds):
                    delta = np.zeros(sigma.shape)
                    begin, end = np.append(0, cut), np.append(cut, len(active))
                    for a, b in zip(np.append(0, bounds), np.append(bounds, len(level)), strict=True):
                        own = np.flatnonzero(sigma[a:b].any(axis=0))
                        lo = active[begin[np.searchsorted(cut, np.searchsorted(active, level[a]), "right")]]
                        hi = active[end[np.searchsorted(cut, np.searchsorted(active, level[b - 1]), "right")] - 1] + 1
                        delta[a:b, own] = go_on(level[a:b], sigma[a:b, own], unseen[lo - low:hi - low, own], lo, own, np.arange(len(own)))
                    break
                found, group, hits = self._alike(level, sigma, rest)
                if hits or 4 * len(found) <= 3 * width or (len(found) == 1 < width):
                    delta = np.zeros(sigma.shape)
                    for c, other, at, column in hits:
                        mine, theirs = sigma[:, c] > 0, np.searchsorted(other.rows[at], level[sigma[:, c] > 0])
                        delta[mine, c] = other.delta[at][theirs, column]
                        hand_on(other, at, np.array([c]), np.array([column]))
                    more = np.flatnonzero(group >= 0)
                    if len(more):
                        delta[:, more] = go_on(level, sigma[:, found], unseen[:, found], low, more, group[more])[:, group[more]]
                    break
                if run is not None:
                    looks.append((len(levels) - 1, rest.copy()))
            place, edge = out_edges(self.first, level)
            v = self.ends[edge]
            at = v - low
            on = (at >= 0) & (at < len(left))
            on[on] = left[at[on]] > 0
            place, edge, v = place[on], edge[on], v[on]
            if not len(v):
                break
            fresh = np.sort(once(v, self.slot))
            if len(fresh) * len(level) > 64 * len(v) + 1_000_000:
                raise Unsuited
            self.slot[fresh] = np.arange(len(fresh))
            matrix = np.zeros((len(fresh), len(level)))
            matrix[self.slot[v], place] = self.times[edge]
            sums = product(matrix, sigma)
            sums *= unseen[fresh - low]
            mask = sums > 0
            some = mask.any(axis=1)
            if not some.any():
                break
            if not some.all():
                fresh, sums, mask = fresh[some], sums[some], mask[some]
            level = fresh
            top = sums.max(axis=0)
            scale = np.ldexp(1.0, -np.frexp(top)[1])
            sigma = sums * scale
            if (sigma + ~mask).min() < 2.0**-900:
                raise Unsuited
            unseen[level - low] ^= mask
            left[level - low] -= np.count_nonzero(mask, axis=1)
            for k in (0, 1):
                rest[k] -= (mask * self.mark[level, k, None]).sum(axis=0, dtype=np.uint64)
            if not top.all():  # columns that have ended
                own = np.flatnonzero(top)
                delta = np.zeros(sigma.shape)
                levels.append((level, sigma, scale))
                self.held += sigma.size
                delta[:, own] = go_on(level, sigma[:, own], unseen[:, own], low, own, np.arange(len(own)))
                break
        if delta is None:
            delta = np.zeros(sigma.shape)
        if run is not None:
            self.kept += sum(x[1].size for x in levels)
            run.rows = [x[0] for x in levels]
            run.delta = [None] * len(levels)
            fronts = [(at, r, levels[at][1]) for at, r in looks]
        for depth in range(len(levels) - 1, 0, -1):
            below, sigma, scale = levels.pop()
            self.held -= sigma.size
            level, upper, _ = levels[-1]
            if run is None:
                self.total[below] += delta @ weight
            else:
                run.delta[depth] = delta
            share = delta + (sigma > 0)
            share /= sigma + (sigma == 0)
            share *= scale
            self.slot[below] = np.arange(len(below))
            place, edge = out_edges(self.first, level)
            v = self.ends[edge]
            at = np.minimum(self.slot[v], len(below) - 1)
            on = below[at] == v
            matrix = np.zeros((len(level), len(below)))
            matrix[place[on], at[on]] = self.times[edge[on]]
            delta = product(matrix, share)
            delta *= upper
        self.held -= levels[0][1].size
        if run is not None:
            run.delta[0] = delta
            self.runs.append(run)
            for at, r, sigma in fronts:
                share = sigma / sigma.max(axis=0)
                for c, key in enumerate(self._keys(run.rows[at], sigma, r)):
                    own = share[sigma[:, c] > 0, c]
                    self.known.setdefault(key, []).append((run, at, c, own, own.sum()))
        return delta, run


def dependencies(src: np.ndarray, dst: np.ndarray, n: int, sources: np.ndarray, states: int = STATES) -> np.ndarray:
    """Dependency sums of some sources; an edge for each kind counts as a path of its own."""
    order = local_order(src, dst, n)
    number = np.empty(n, np.int64)
    number[order] = np.arange(n)
    src, dst = number[src], number[dst]
    pair, times = np.unique(src * n + dst, return_counts=True)
    starts, ends, times = pair // max(n, 1), pair % max(n, 1), times.astype(float)
    own = np.sort(number[sources])
    fronts, rest = Fronts(starts, ends, times, n), []
    at_once = max(1, min(WIDTH, states // max(n, 1)))
    for group in np.split(own, range(at_once, len(own), at_once)):
        if len(rest) < 3:
            try:
                fronts.add(group)
                continue
            except Unsuited:
                pass
        rest.append(group)
    total = fronts.sums()
    if rest:
        total += by_states(starts, ends, n, np.concatenate(rest), times, states)
    return total[number]

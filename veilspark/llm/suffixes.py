"""Suffix sorting by grouping on Lyndon prefixes, without recursion or renaming.

Every suffix begins with a longest Lyndon word. The first phase groups suffixes by that word:
groups are taken in descending order, and a group's word is appended to the word of each suffix
that its members point at, their previous suffix of a smaller group; suffixes pointed at
several times gain the word as often, and move to a group just above their old one. The second
phase walks the order being built: the suffix before the one just reached, and those it points
at in turn, follow in their groups until one is found that has its place.

suffix_order sorts one text. suffix_orders sorts many short ones at once: each step takes the
next group of every text, so what is a loop over suffixes above is array operations here.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def suffix_order(text: Sequence[int]) -> list[int]:
    """Start positions of the suffixes of text in ascending order; text may hold any integers from 0 on.

    Beyond the first ordering by single codes, time is linear.
    """
    n = len(text) + 1
    codes = np.zeros(n, np.int64)
    codes[:-1] = np.asarray(text, np.int64) + 1  # 0 ends the text
    by_code = np.argsort(codes, kind="stable")
    sorted_codes = codes[by_code]
    heads = np.flatnonzero(np.concatenate([[True], sorted_codes[1:] != sorted_codes[:-1]]))
    stops = np.append(heads[1:], n)
    line = by_code.tolist()  # suffixes in group order
    seat_array = np.empty(n, np.int64)
    seat_array[by_code] = np.arange(n)
    seat = seat_array.tolist()  # where a suffix is in line
    start_array = np.empty(n, np.int64)
    start_array[by_code] = np.repeat(heads, stops - heads)
    group = start_array.tolist()  # a group is named by where it begins in line
    stop = [0] * n
    for lo, hi in zip(heads.tolist(), stops.tolist(), strict=True):
        stop[lo] = hi
    smaller = [-1] * n  # previous suffix of a smaller group
    end = n
    while end > 1:
        name = group[line[end - 1]]
        if end - name == 1:
            i = line[name]
            j = i - 1
            while j >= 0 and group[j] >= name:
                j = smaller[j]
            smaller[i] = j
            if j >= 0:
                old = group[j]
                last = stop[old] - 1
                if last != old:
                    x, at = line[last], seat[j]
                    line[at], seat[x] = x, at
                    line[last], seat[j] = j, last
                    group[j] = last
                    stop[last], stop[old] = last + 1, last
            end = name
            continue
        members = line[name:end]
        # Up to a suffix of this group or of a smaller one, then along this group's to a smaller one.
        fellows = []
        for i in members:
            j = i - 1
            while j >= 0 and group[j] > name:
                j = smaller[j]
            smaller[i] = j
            if j >= 0 and group[j] == name:
                fellows.append(i)
        for i in fellows:
            path, j = [], i
            while j >= 0 and group[j] == name:
                path.append(j)
                j = smaller[j]
            for x in path:
                smaller[x] = j
        times: dict[int, int] = {}
        for i in members:
            j = smaller[i]
            times[j] = times.get(j, 0) + 1
        times.pop(-1, None)
        layers: dict[int, dict[int, list[int]]] = {}
        for j, count in times.items():
            layers.setdefault(count, {}).setdefault(group[j], []).append(j)
        end = name
        for count in sorted(layers, reverse=True):
            for old, moved in layers[count].items():
                hi = last = stop[old]
                for j in moved:
                    last -= 1
                    x, at = line[last], seat[j]
                    line[at], seat[x] = x, at
                    line[last], seat[j] = j, last
                if last != old:
                    for j in moved:
                        group[j] = last
                    stop[old] = last
                    stop[last] = hi
    placed = [False] * n
    free = list(range(n))  # next seat of a group, by its name
    order = [0] * n
    order[0] = n - 1
    placed[n - 1] = True
    for k in range(n):
        j = order[k] - 1
        while j >= 0 and not placed[j]:
            name = group[j]
            order[free[name]] = j
            free[name] += 1
            placed[j] = True
            j = smaller[j]
    return order[1:]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each start, sizes of them."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _point(members: np.ndarray, names: np.ndarray, group: np.ndarray, smaller: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The previous suffix of a smaller group of each member, noted in smaller, and its group."""
    target = members - 1
    of = group.take(target)
    left = (of > names).nonzero()[0]
    while len(left):
        there = smaller.take(target.take(left))
        target[left] = there
        there = group.take(there)
        of[left] = there
        left = left.take((there > names.take(left)).nonzero()[0])
    smaller[members] = target
    left = (of == names).nonzero()[0]
    while len(left):  # paths along the group halve
        there = smaller.take(target.take(left))
        target[left] = there
        smaller[members.take(left)] = there
        there = group.take(there)
        of[left] = there
        left = left.take((there == names.take(left)).nonzero()[0])
    return target, of


def _raise(targets: np.ndarray, old: np.ndarray, times: np.ndarray, line: np.ndarray, seat: np.ndarray, group: np.ndarray, stop: np.ndarray, moving: np.ndarray) -> None:
    """Move distinct suffixes to the top of their groups (old), those of most times highest; each number of times is a new group."""
    alike = times.max() == 1
    order = old.argsort() if alike else np.lexsort((times, old))
    targets, old = targets.take(order), old.take(order)
    fresh = np.empty(len(old), bool)
    fresh[0] = True
    np.not_equal(old[1:], old[:-1], out=fresh[1:])
    first = fresh.nonzero()[0]
    many = np.empty(len(first), np.int64)
    many[:-1] = first[1:] - first[:-1]
    many[-1] = len(old) - first[-1]
    name = old.take(first)
    low = stop.take(name) - many
    lows = low.repeat(many)
    room = lows + np.arange(len(old)) - first.repeat(many)
    there = line.take(room)
    moving[targets] = True
    stay = there.take((~moving.take(there)).nonzero()[0])
    moving[targets] = False
    if len(stay):
        seats = seat.take(targets)
        left = seats.take((seats < lows).nonzero()[0])
        line[left], seat[stay] = stay, left
    line[room], seat[targets] = targets, room
    stop[name] = low
    if alike:
        group[targets], stop[low] = lows, low + many
    else:
        times = times.take(order)
        fresh[1:] |= times[1:] != times[:-1]
        first = fresh.nonzero()[0]
        many = np.diff(np.append(first, len(old)))
        low = room.take(first)
        group[targets], stop[low] = low.repeat(many), low + many


def suffix_orders(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Positions of all suffixes, text after text, those of a text in ascending order.

    Text k is codes[starts[k] : starts[k + 1]] (starts has one more value), of integers from 0 to
    65534. Its suffixes are compared within it; an end sorts first.
    """
    sizes = np.diff(starts)
    texts = len(sizes)
    # Each text is followed by an end of code 0; position 0 belongs to none and is smallest of all.
    begin = starts[:-1] + np.arange(texts) + 1
    n = int(starts[-1]) + texts + 1
    owner = np.zeros(n, np.int64)
    owner[1:] = np.repeat(np.arange(texts), sizes + 1)
    key = owner << 16
    key[_ranges(begin, sizes)] += np.asarray(codes, np.int64) + 1
    line = key.argsort()
    base = begin  # a text's seats are as many as its positions and begin alike
    key = key.take(line)
    fresh = np.ones(n, bool)
    fresh[1:] = key[1:] != key[:-1]
    fresh[:2] = True
    heads = fresh.nonzero()[0]
    many = np.diff(np.append(heads, n))
    seat = np.empty(n, np.int64)
    seat[line] = np.arange(n)
    group = np.empty(n, np.int64)
    group[line] = np.repeat(heads, many)
    stop = np.zeros(n, np.int64)
    stop[heads] = heads + many
    smaller, rep = np.zeros(n, np.int64), np.zeros(n, np.int64)
    moving = np.zeros(n, bool)

    end, floor = base + sizes + 1, base
    while True:
        use = end > floor + 1  # the end's own group is the last
        if not use.all():
            end, floor = end[use], floor[use]
        if not len(end):
            break
        name = group.take(line.take(end - 1))
        many = end - name
        end = name
        if len(name) == many.sum():
            members, names, floors = line.take(name), name, floor
        else:
            names, floors = name.repeat(many), floor.repeat(many)
            members = line.take(names + np.arange(len(names)) - (many.cumsum() - many).repeat(many))
        target, of = _point(members, names, group, smaller)
        inside = (of >= floors).nonzero()[0]
        if not len(inside):
            continue
        target, of = target.take(inside), of.take(inside)
        each = np.arange(len(target))
        rep[target] = each
        first = rep.take(target)
        alone = (first == each).nonzero()[0]
        if len(alone) == len(each):
            times = np.ones(len(each), np.int64)
        else:
            times = np.bincount(first, minlength=len(each)).take(alone)
            target, of = target.take(alone), of.take(alone)
        _raise(target, of, times, line, seat, group, stop, moving)

    # The order: a text's end comes first; k steps on, each text's k-th suffix is known.
    order, free, placed = np.zeros(n, np.int64), np.arange(n), np.zeros(n, bool)
    order[base] = base + sizes
    placed[base + sizes] = True
    placed[base - 1] = True  # the end before, or position 0, ends each path
    at, stop_at = base, base + sizes + 1
    while len(at):
        j = order.take(at) - 1
        j = j.take((~placed.take(j)).nonzero()[0])
        while len(j):
            name = group.take(j)
            spot = free.take(name)
            order[spot] = j
            free[name] = spot + 1
            placed[j] = True
            j = smaller.take(j)
            j = j.take((~placed.take(j)).nonzero()[0])
        at = at + 1
        use = at < stop_at
        if not use.all():
            at, stop_at = at[use], stop_at[use]
    # Without the ends, and as positions in codes.
    found = np.delete(order, np.concatenate([[0], base]))
    return found - owner.take(found) - 1

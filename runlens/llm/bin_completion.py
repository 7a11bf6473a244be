"""Bin completion over a histogram of sizes.

Sizes are integers up to the capacity, so a table of any length is, for
packing, a histogram of at most ``capacity`` counts. The search fills bins
around the largest remaining size and repeats a filling as often as the counts
allow, so its work follows the number of distinct sizes, not of items.
"""

from __future__ import annotations

from dataclasses import dataclass

#: fillings kept per bin, steps to enumerate them, nodes of the whole search
#: beyond its first dive, and items up to which dominance is tried
WIDTH, STEPS, NODES, GROUPED = 4, 200, 2000, 6


@dataclass(frozen=True)
class Filling:
    """One bin's content as (size, copies) pairs, used for ``times`` bins."""

    sizes: tuple[tuple[int, int], ...]
    times: int


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs: by total size, and by items over a half.

    For each threshold k, items above capacity - k stand alone, items above a
    half need a bin each, and items of at least k that do not fit into the room
    left beside the latter need more (the classical second bound).
    """
    total = sum(s * c for s, c in counts.items())
    best = -(-total // capacity)
    sizes = sorted(counts)
    for k in [0, *(s for s in sizes if s <= capacity // 2)]:
        alone = sum(c for s, c in counts.items() if s > capacity - k)
        halves = [(s, c) for s, c in counts.items() if capacity // 2 < s <= capacity - k]
        bins = sum(c for _, c in halves)
        room = bins * capacity - sum(s * c for s, c in halves)
        small = sum(s * c for s, c in counts.items() if k <= s <= capacity // 2)
        best = max(best, alone + bins + max(0, -(-(small - room) // capacity)))
    return best


Content = list[tuple[int, int]]


def dominates(one: Content, other: Content) -> bool:
    """Whether the items of ``other`` fit, grouped, into the items of ``one``.

    Tried for fillings of a few items only; of longer ones none dominates.
    """
    room = [s for s, c in one for _ in range(min(c, GROUPED + 1))]
    items = [s for s, c in other for _ in range(min(c, GROUPED + 1))]
    if len(items) > GROUPED or len(room) > GROUPED or sum(items) > sum(room):
        return False

    def place(i: int) -> bool:
        if i == len(items):
            return True
        tried = set()
        for j, r in enumerate(room):
            if r >= items[i] and r not in tried:
                tried.add(r)
                room[j] -= items[i]
                if place(i + 1):
                    return True
                room[j] += items[i]
        return False
    return place(0)


def fillings(counts: dict[int, int], sizes: list[int], room: int) -> list[Content]:
    """Undominated ways to fill ``room``, least waste first, then largest items.

    ``sizes`` are the remaining sizes, descending. A size is taken as often as
    fits, or once less. A filling is listed once no smaller item can be added
    to it; dominated ones are then dropped. One item that fits exactly
    dominates everything else.
    """
    if counts.get(room, 0) > 0:
        return [[(room, 1)]]
    found: list[Content] = []
    budget = STEPS
    smallest = sizes[-1] if sizes else room + 1

    def walk(start: int, left: int, chosen: Content) -> bool:
        """Whether to stop: the room is filled exactly or the steps are used up."""
        nonlocal budget
        budget -= 1
        if left < smallest:
            found.append(list(chosen))
            return left == 0 or budget <= 0
        added = False
        for i in range(_first_at_most(sizes, left, start), len(sizes)):
            s = sizes[i]
            most = min(counts[s], left // s)
            for copies in range(most, max(most - 2, 0), -1):
                added = True
                if walk(i + 1, left - copies * s, [*chosen, (s, copies)]) or budget <= 0:
                    return True
        if not added:
            found.append(list(chosen))
        return budget <= 0

    # one start item each, so that the list holds fillings that differ
    for i in range(_first_at_most(sizes, room, 0), len(sizes)):
        s = sizes[i]
        if len(found) >= 4 * WIDTH or budget <= 0:
            break
        partner = room - s
        if s > partner > 0 and counts.get(partner, 0) > 0:
            found.append([(s, 1), (partner, 1)])
            break
        if counts[s] > 0 and walk(i + 1, room - s, [(s, 1)]):
            break
    if not found:
        return [[]]
    found.sort(key=lambda f: (room - sum(s * c for s, c in f), [-s for s, _ in f]))
    kept: list[Content] = []
    for f in found[:8 * WIDTH]:
        if f not in kept and not any(dominates(k, f) for k in kept):
            kept.append(f)
        if len(kept) == WIDTH:
            break
    return kept


def _first_at_most(sizes: list[int], limit: int, start: int) -> int:
    """Index of the first of the descending ``sizes`` from ``start`` not above ``limit``."""
    low, high = start, len(sizes)
    while low < high:
        mid = (low + high) // 2
        if sizes[mid] > limit:
            low = mid + 1
        else:
            high = mid
    return low


def best_fit(counts: dict[int, int], capacity: int) -> list[Filling]:
    """Best-fit decreasing: each item goes where it leaves the least room."""
    open_bins: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}
    done: list[Filling] = []
    for size in sorted(counts, reverse=True):
        left = counts[size]
        for room in sorted(r for r in open_bins if r >= size):
            if not left:
                break
            groups, stay = open_bins.pop(room), []
            for content, times in groups:
                fit = room // size
                full = min(times, left // fit)
                parts = [(fit, full)]
                if full < times and (rest := left - full * fit):
                    parts.append((rest, 1))
                    stay.append((content, times - full - 1))
                else:
                    stay.append((content, times - full))
                for copies, n in parts:
                    if n:
                        left -= copies * n
                        open_bins.setdefault(room - copies * size, []).append(
                            (content + ((size, copies),), n))
            stay = [(c, n) for c, n in stay if n]
            if stay:
                open_bins.setdefault(room, []).extend(stay)
        fit = capacity // size
        for copies, n in ((fit, left // fit), (left % fit, 1)):
            if copies and n:
                open_bins.setdefault(capacity - copies * size, []).append((((size, copies),), n))
    for groups in open_bins.values():
        done.extend(Filling(content, n) for content, n in groups)
    return done


def pack(counts: dict[int, int], capacity: int) -> list[Filling]:
    """Pack the items of a size histogram into as few bins as the search finds.

    Depth first: a node takes the largest remaining size and branches over its
    undominated fillings. A branch is cut once its waste exceeds what a packing
    better than the incumbent may waste. The incumbent starts as best-fit
    decreasing; the search ends at the lower bound or after ``NODES`` nodes.
    """
    counts = {s: c for s, c in counts.items() if c > 0}
    if any(s > capacity or s < 1 for s in counts):
        raise ValueError("sizes must lie between 1 and the capacity")
    if not counts:
        return []
    total = sum(s * c for s, c in counts.items())
    bound = lower_bound(counts, capacity)
    best = best_fit(counts, capacity)
    fewest = sum(f.times for f in best)
    if fewest == bound:
        return best
    # a level holds the untried fillings of its bin, and what taking one changed
    remaining = dict(counts)
    sizes = sorted(remaining, reverse=True)
    levels: list[dict] = []
    waste, nodes = 0, 0

    def undo(level: dict) -> None:
        nonlocal waste
        for s, c in level["taken"]:
            if remaining.get(s, 0) == 0:
                _insert(sizes, s)
            remaining[s] = remaining.get(s, 0) + c
        waste -= level["waste"]

    def open_level() -> None:
        largest = sizes[0]
        remaining[largest] -= 1
        options = fillings(remaining, [s for s in sizes if remaining[s] > 0], capacity - largest)
        remaining[largest] += 1
        levels.append({"largest": largest, "options": options[::-1], "taken": (), "waste": 0,
                       "filling": None})

    open_level()
    while levels and nodes < NODES + len(best):
        level = levels[-1]
        if level["filling"] is not None:
            undo(level)
            level["filling"] = None
        if not level["options"]:
            levels.pop()
            continue
        nodes += 1
        content = {level["largest"]: 1}
        for s, c in level["options"].pop():
            content[s] = content.get(s, 0) + c
        times = min(remaining[s] // c for s, c in content.items())
        spare = capacity - sum(s * c for s, c in content.items())
        level.update(taken=[(s, c * times) for s, c in content.items()], waste=spare * times,
                     filling=Filling(tuple(content.items()), times))
        for s, c in level["taken"]:
            remaining[s] -= c
            if not remaining[s]:
                sizes.remove(s)
        waste += level["waste"]
        if total + waste > (fewest - 1) * capacity:
            continue
        if sizes:
            open_level()
            continue
        best = [x["filling"] for x in levels]
        fewest = sum(f.times for f in best)
        if fewest <= bound:
            break
    return best


def _insert(sizes: list[int], size: int) -> None:
    sizes.insert(_first_at_most(sizes, size, 0), size)

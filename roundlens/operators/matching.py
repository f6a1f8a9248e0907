"""Least-cost matching between a few players and categories, by the Hungarian method.

A helper for one scope, which Spark hands to a task: rows enter one by one along the
cheapest path to a free column, so sixty players by twenty-five categories take milliseconds.
"""

from __future__ import annotations


def least_cost_pairs(costs: dict[tuple[int, int], int]) -> dict[int, int]:
    """Category of each matched player: as many pairs as there can be, and of these the least sum of ``costs`` (player, category), which aren't negative.

    The rows are the smaller side. Each may also stay alone, at a cost above that of all
    pairs together, in a column of its own.
    """
    if not costs:
        return {}
    players, categories = sorted({p for p, _ in costs}), sorted({c for _, c in costs})
    turned = len(players) > len(categories)
    rows, columns = (categories, players) if turned else (players, categories)
    n, m = len(rows), len(columns)
    alone = max(costs.values()) * n + 1
    never = alone * (n + 1)  # no optimum holds it: all rows may stay alone for less
    cost = [[costs.get((y, x) if turned else (x, y), never) for y in columns] + [alone if k == i else never for k in range(n)] for i, x in enumerate(rows)]
    free = m + n  # the column that stands for the row that enters
    owner = [-1] * (free + 1)
    high, low = [0] * n, [0] * (free + 1)
    for i in range(n):
        owner[free] = i
        at, least, before, reached, outside = free, [-1] * free, [free] * free, [free], list(range(free))
        while owner[at] >= 0:
            row, up = cost[owner[at]], high[owner[at]]
            best = nearest = -1
            for j in outside:
                step = row[j] - up - low[j]
                if least[j] < 0 or step < least[j]:
                    least[j], before[j] = step, at
                if best < 0 or least[j] < best:
                    best, nearest = least[j], j
            for j in reached:
                high[owner[j]] += best
                low[j] -= best
            for j in outside:
                least[j] -= best
            outside.remove(nearest)
            reached.append(nearest)
            at = nearest
        while at != free:
            owner[at] = owner[before[at]]
            at = before[at]
    pairs = {rows[owner[j]]: columns[j] for j in range(m) if owner[j] >= 0}
    return {p: c for c, p in pairs.items()} if turned else pairs


def best_assignment(ranks: dict[tuple[int, int], int]) -> dict[int, int]:
    """Category (numbered by priority) of each player: most players, then the least sum of ``ranks`` (player, category), then the least worst rank.

    Of equals the first by categories in order of priority: the one whose first
    category goes to the better rank, or is given at all, and so on.
    """
    if not ranks:
        return {}
    base = max(ranks.values()) + 2
    size = max(c for _, c in ranks) + 1
    above = base ** (size + 1)  # more than all ties together

    def pairs(worst: int) -> tuple[dict[int, int], tuple[int, int]]:
        # A category that isn't given counts as the digit base - 1, so that a given one takes off the difference; all pairs carry the same extra, so none costs less than nothing.
        found = least_cost_pairs({(p, c): r * above * size + base**size + (r - base + 1) * base ** (size - 1 - c) for (p, c), r in ranks.items() if r <= worst})
        return found, (-len(found), sum(ranks[p, c] for p, c in found.items()))

    found, best = pairs(base)
    while True:
        # Offers of worse ranks than those taken change nothing, so only smaller limits are left to try, until one costs pairs or ranks.
        limited, reached = pairs(max(ranks[x] for x in found.items()) - 1)
        if reached != best:
            return found
        found = limited

"""Orders of adding up objects that can be merged: left to right, in pairs, or small with large."""

from __future__ import annotations


def sequential_sum(items: list):
    """Left to right. Objects that know the sum of many (`joined`) are not added one by one, each sum copying all before."""
    joined = getattr(type(items[0]), "joined", None)
    if joined and len({type(x) for x in items}) == 1:
        return joined(items)
    total = items[0]
    for x in items[1:]:
        total = total + x
    return total


def pairwise_sum(items: list):
    """Neighbours are added in rounds; an odd last one waits for the next round."""
    items = list(items)
    while len(items) > 1:
        items = [items[i] + items[i + 1] if i + 1 < len(items) else items[i] for i in range(0, len(items), 2)]
    return items[0]


def minorization_sum(items: list, weights: list[float] | None = None):
    """Each round adds the lightest to the heaviest; of an odd number the one farthest from twice the mean waits."""
    items = list(items)
    weights = [float(w) for w in (weights if weights is not None else [getattr(x, "total_weight", 1.0) for x in items])]
    if len(items) != len(weights):
        raise ValueError("as many weights as items are needed")
    while len(items) > 1:
        order = sorted(range(len(items)), key=lambda i: weights[i])
        waiting = []
        if len(order) % 2:
            mean = sum(weights) / len(weights)
            odd = max(order, key=lambda i: abs(weights[i] - 2 * mean))
            order.remove(odd)
            waiting = [odd]
        pairs = [(order[i], order[-1 - i]) for i in range(len(order) // 2)]
        items, weights = [items[a] + items[b] for a, b in pairs] + [items[i] for i in waiting], [weights[a] + weights[b] for a, b in pairs] + [weights[i] for i in waiting]
    return items[0]

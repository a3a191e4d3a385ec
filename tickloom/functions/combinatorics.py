"""Numbering of condition subsets, and identities of what they mean. Plain numbers on the driver: nothing here grows with data."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable
from math import comb

from ..operators.search import upper_tail


def family_size(count: int, least: int, most: int, contracts: int = 1) -> int:
    """Members of a family: subsets of `least` to `most` of `count` conditions, each with every contract."""
    return sum(comb(count, k) for k in range(least, most + 1)) * contracts


def member_rank(count: int, least: int, chosen: list[int], contract: int = 0, contracts: int = 1) -> int:
    """Place of a subset (ascending indices) and contract: smaller subsets first, then lexicographic, contracts fastest.

    Counted from the end: the subsets of k that come after `chosen` number the sum of C(count - 1 - c_i, k - i) over its places i.
    """
    k = len(chosen)
    after = sum(comb(count - 1 - c, k - i) for i, c in enumerate(chosen))
    return (family_size(count, least, k) - 1 - after) * contracts + contract


def member_at(count: int, least: int, most: int, rank: int, contracts: int = 1) -> tuple[list[int], int]:
    """The subset and contract at a place; the inverse of member_rank. Each index is found by bisection among the binomials."""
    subset, contract = divmod(rank, contracts)
    sizes = [k for k in range(least, most + 1) if family_size(count, least, k) > subset]
    if not sizes or subset < 0:
        raise ValueError(f"no member {rank}")
    k = sizes[0]
    after, chosen = family_size(count, least, k) - 1 - subset, []
    for left in range(k, 0, -1):
        top = bisect_right(range(count), after, key=lambda x: comb(x, left)) - 1
        after -= comb(top, left)
        chosen.append(count - 1 - top)
    return chosen, contract


def logic_identity(conditions: Iterable[str]) -> str:
    """SHA-256 of a set of conditions, whatever their order and repeats."""
    return hashlib.sha256("\n".join(sorted(set(conditions))).encode()).hexdigest()


def break_even(win: float, loss: float) -> float:
    """Rate of wins at which gains of `win` and losses of `loss` cancel."""
    return loss / (win + loss)


def required_wins(decisive: int, p: float, limit: float) -> int:
    """Least number of wins among `decisive` whose upper tail at p is at most `limit`; decisive + 1 if none is."""
    low, high = 1, decisive + 1
    while low < high:
        mid = (low + high) // 2
        if upper_tail(mid, decisive - mid, p) <= limit:
            high = mid
        else:
            low = mid + 1
    return low

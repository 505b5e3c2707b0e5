"""Pair merging over a heap and a doubly linked list, for both kinds of vocabulary."""

from __future__ import annotations

from heapq import heapify, heappop, heappush

#: Bits of a symbol number in the keys and values of a pair table.
BITS = 20
MASK = (1 << BITS) - 1


def merge(symbols: list[int], pairs: dict[int, int]) -> tuple[int, list[int]]:
    """Merge adjacent symbols until no pair is left; ``(merges, successor list)``.

    ``pairs`` maps ``left << BITS | right`` to ``rank << BITS | merged``. The pair of the lowest
    rank goes first, the leftmost of equals. Heap entries are single integers, rank before
    place; an entry whose pair has changed since is skipped. Walking the successor list from 0
    gives where each remaining symbol starts. ``symbols`` is changed in place.
    """
    n = len(symbols)
    shift = n.bit_length()
    get = pairs.get
    heap = []
    left = symbols[0]
    for i in range(n - 1):
        right = symbols[i + 1]
        if (v := get(left << BITS | right)) is not None:
            heap.append(v >> BITS << shift | i)
        left = right
    after = list(range(1, n + 1))
    if not heap:
        return 0, after
    before = list(range(-1, n - 1))
    heapify(heap)
    low, merges = (1 << shift) - 1, 0
    while heap:
        entry = heappop(heap)
        i = entry & low
        j = after[i]
        if j >= n:
            continue
        v = get(symbols[i] << BITS | symbols[j])
        if v is None or v >> BITS != entry >> shift:
            continue
        merges += 1
        made = v & MASK
        symbols[i] = made
        k = after[i] = after[j]
        after[j] = n  # an entry for the symbol that is gone finds no neighbour
        if k < n:
            before[k] = i
            if (v := get(made << BITS | symbols[k])) is not None:
                heappush(heap, v >> BITS << shift | i)
        h = before[i]
        if h >= 0 and (v := get(symbols[h] << BITS | made)) is not None:
            heappush(heap, v >> BITS << shift | h)
    return merges, after

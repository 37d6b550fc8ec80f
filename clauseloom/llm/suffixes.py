"""Suffix sorting by linear grouping construction.

First the suffixes are grouped by their longest Lyndon prefix: groups are processed from the greatest
to the least; each suffix of a group finds, over previous-smaller pointers, the nearest suffix before
it that is in a lesser group, and those move, in one step, to a new group right above their old one.
Then each group's order is emitted: going through the sorted suffixes from the least, the suffix
before it and those on its chain of previous-smaller pointers come next in their groups. No renaming,
no recursion.
"""

from __future__ import annotations

from collections import Counter, defaultdict


def suffix_array(text: bytes | list[int]) -> list[int]:
    """Starts of all suffixes of ``text``, least first."""
    n = len(text)
    starts = [0] * (max(text, default=0) + 2)
    for c in text:
        starts[c + 1] += 1
    for c in range(1, len(starts)):
        starts[c] += starts[c - 1]
    group = [starts[c] for c in text]  # named by its first place
    place, last = [0] * n, [0] * n  # of a suffix; of a group by its first place
    order, free = [0] * n, starts[:-1]
    for i, c in enumerate(text):
        k = free[c]
        order[k] = i
        place[i] = k
        free[c] = k + 1
    for c, k in enumerate(starts[:-1]):
        if starts[c + 1] > k:
            last[k] = starts[c + 1] - 1

    smaller = [-1] * n  # nearest suffix before it in a lesser group
    end = n - 1
    while end >= 0:
        i = order[end]
        g = group[i]
        if g == end:
            p = i - 1
            while p >= 0 and group[p] >= g:
                p = smaller[p]
            smaller[i] = p
            if p >= 0:
                h = group[p]
                e = last[h]
                if e > h:
                    k, q = place[p], order[e]
                    order[k] = q
                    place[q] = k
                    order[e] = p
                    place[p] = e
                    last[h] = e - 1
                    group[p] = last[e] = e
            end -= 1
            continue
        counts: Counter[int] = Counter()
        for i in sorted(order[g : end + 1]):
            p = i - 1
            while p >= 0 and group[p] >= g:
                p = smaller[p]
            smaller[i] = p
            counts[p] += 1
        counts.pop(-1, None)
        if counts:
            # those that precede more suffixes of this group in a row are greater
            for times in sorted(set(counts.values()), reverse=True):
                moved = defaultdict(list)
                for p, k in counts.items():
                    if k == times:
                        moved[group[p]].append(p)
                for h, ps in moved.items():
                    old = e = last[h]
                    if len(ps) > e - h:
                        continue
                    for p in ps:
                        k, q = place[p], order[e]
                        order[k] = q
                        place[q] = k
                        order[e] = p
                        place[p] = e
                        e -= 1
                    last[h] = e
                    last[e + 1] = old
                    for p in ps:
                        group[p] = e + 1
        end = g - 1

    free, out, placed = list(range(n)), [0] * n, [False] * n
    k, i = -1, n
    while True:
        j = i - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = True
            j = smaller[j]
        k += 1
        if k >= n:
            return out
        i = out[k]

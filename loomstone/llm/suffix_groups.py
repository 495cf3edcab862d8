"""Suffix arrays by linear grouping, in pure Python over integers.

Suffixes start in groups of their first character. Groups are processed in
descending order. Each suffix of a group finds the previous suffix that is in
a lower group; those previous ones are followed by the group's context, so
they move out of their own group into a new one just above it, the higher
the more of the group's suffixes point to them. In the end a group holds the
suffixes of one longest Lyndon prefix. Then the order inside the groups
follows from the order of smaller suffixes alone, without renaming the text
and recursing.
"""

from __future__ import annotations

#: No pointer yet; -1 is before the text.
UNKNOWN = -2


def suffix_array(text: list[int]) -> list[int]:
    """Starts of the suffixes of text in ascending order; a prefix comes before what it is a prefix of. Characters should be few integers from 0: their range is walked once."""
    n = len(text)
    if n < 2:
        return list(range(n))
    members: list[list[int]] = []
    group = [0] * n
    by_char: list[list[int]] = [[] for _ in range(max(text) + 1)]
    for i, c in enumerate(text):
        by_char[c].append(i)
    for of in by_char:
        if of:
            for i in of:
                group[i] = len(members)
            members.append(of)
    lower = list(range(-1, len(members) - 1))
    upper = list(range(1, len(members) + 1))
    upper[-1] = -1
    #: Of groups: their place among the ones that were there when they were made is their parent's; done ones are higher.
    done = [False] * len(members)
    previous = [UNKNOWN] * n
    g = len(members) - 1
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        members[g] = own
        done[g] = True
        # at[i]: how far the search for the pointer of i has come; one that needs another's pointer waits for it.
        at = {i: i - 1 for i in own}
        for i in own:
            waiting = [i] if previous[i] == UNKNOWN else []
            while waiting:
                j = waiting[-1]
                q = at[j]
                # All that is in this or a higher group has its own pointer already, or gets it first.
                while q >= 0 and done[group[q]] and previous[q] != UNKNOWN:
                    q = previous[q]
                at[j] = q
                if q >= 0 and done[group[q]]:
                    waiting.append(q)
                else:
                    previous[j] = q
                    waiting.pop()
        pointed: dict[int, int] = {}
        for i in own:
            if previous[i] >= 0:
                pointed[previous[i]] = pointed.get(previous[i], 0) + 1
        if pointed:
            of_count: dict[int, dict[int, list[int]]] = {}
            for p, k in pointed.items():
                of_count.setdefault(k, {}).setdefault(group[p], []).append(p)
            for k in sorted(of_count, reverse=True):
                for old, moved in of_count[k].items():
                    new = len(members)
                    members.append(moved)
                    done.append(False)
                    above = upper[old]
                    lower.append(old)
                    upper.append(above)
                    upper[old] = new
                    lower[above] = new
                    for p in moved:
                        group[p] = new
        g = lower[g]
    return _order(n, members, group, lower, upper, previous)


def _order(n: int, members: list[list[int]], group: list[int], lower: list[int], upper: list[int], previous: list[int]) -> list[int]:
    """Each group's suffixes in order: a suffix comes after those whose next smaller suffix is smaller."""
    sizes = [0] * len(members)
    for x in group:
        sizes[x] += 1
    lowest = next(g for g in range(len(members)) if lower[g] == -1 and (sizes[g] or upper[g] != -1))
    front, at, g = [0] * len(members), 0, lowest
    while g != -1:
        front[g] = at
        at += sizes[g]
        g = upper[g]
    order, placed = [-1] * n, bytearray(n)
    for r in range(-1, n):
        j = (n if r < 0 else order[r]) - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            order[front[g]] = j
            front[g] += 1
            placed[j] = 1
            j = previous[j]
    return order


def repeated_starts(strings: list[bytes], weights: list[int], width: int) -> list[list[int]]:
    """For each string, the starts of its width-byte windows that are in the strings twice or more, by weight.

    One suffix array is built over all strings, each ended by a character of
    its own below all bytes, so no window spans two.
    """
    m, text, where = len(strings), [], []
    for k, s in enumerate(strings):
        text += [b + m for b in s]
        text.append(k)
        where += [(k, i) for i in range(len(s))]
        where.append((k, len(s)))
    out: list[list[int]] = [[] for _ in strings]
    run: list[tuple[int, int]] = []
    last, total = None, 0

    def close():
        if total > 1:
            for k, i in run:
                out[k].append(i)

    for x in suffix_array(text):
        k, i = where[x]
        if i + width > len(strings[k]):
            continue
        window = strings[k][i : i + width]
        if window != last:
            close()
            run, last, total = [], window, 0
        run.append((k, i))
        total += weights[k]
    close()
    return [sorted(x) for x in out]

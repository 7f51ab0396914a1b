"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0d]+")
_LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def shingles(text: str | None, width: int) -> frozenset:
    w = WORD.findall((text or "").translate(_LOWER))
    if len(w) < width:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))


def components(rows: list[tuple[int, str | None]], width: int, percent: int) -> dict[int, int]:
    sets = {i: shingles(t, width) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def counts(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    w = WORD.findall(text)
    at = defaultdict(list)
    for k in range(len(w) - 2):
        at[tuple(w[k : k + 3])].append(k)
    covered = {x for v in at.values() if len(v) > 1 for k in v for x in (k, k + 1, k + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)

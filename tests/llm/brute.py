"""Plain, slow statements of what the operators must return, for small inputs."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def shingle_set(text: str | None, k: int = 5) -> set:
    w = words(lower(text or ""))
    if not w:
        return set()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}


def near_components(docs: list[tuple[int, str | None]]) -> dict[int, int]:
    """doc_id to the least doc_id reachable over pairs with 100 * common >= 75 * union."""
    root = {d: d for d, _ in docs}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d
    sets = [(d, shingle_set(t)) for d, t in docs]
    holders: dict = {}
    for i, (_, s) in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    for i, (d, s) in enumerate(sets):
        common: dict[int, int] = {}
        for x in s:
            for j in holders[x]:
                if j < i:
                    common[j] = common.get(j, 0) + 1
        for j, c in common.items():
            if 100 * c >= 75 * (len(s) + len(sets[j][1]) - c):
                a, b = find(d), find(sets[j][0])
                root[max(a, b)] = min(a, b)
    return {d: find(d) for d in root}

"""Decoding token labels in the BIOES scheme: violations, greedy spans and the best legal path."""

from __future__ import annotations

import numpy as np

PARTS = "BIES"


def legal(before: str | None, after: str | None) -> bool:
    """Whether a tag may follow another; null stands for the ends of the sequence. Tags are O or part-label."""
    open_ = before is not None and before[0] in "BI"
    goes_on = after is not None and after[0] in "IE"
    if open_ or goes_on:
        return open_ and goes_on and before[2:] == after[2:]
    return True


def violations(tags: list[str]) -> int:
    steps = zip([None, *tags], [*tags, None])
    return sum(not legal(a, b) for a, b in steps)


def best_path(scores: np.ndarray, tags: list[str], outside_bias: float = 0.0) -> list[str]:
    """Legal sequence of the highest summed score; scores has a row for each token, and the bias is added to O."""
    n = len(scores)
    if n == 0:
        return []
    s = scores.astype(float).copy()
    s[:, tags.index("O")] += outside_bias
    ok = np.array([[0.0 if legal(a, b) else -np.inf for b in tags] for a in tags])
    best = s[0] + np.array([0.0 if legal(None, t) else -np.inf for t in tags])
    back = []
    for row in s[1:]:
        reach = best[:, None] + ok
        back.append(reach.argmax(0))
        best = reach.max(0) + row
    best = best + np.array([0.0 if legal(t, None) else -np.inf for t in tags])
    at = [int(best.argmax())]
    for b in reversed(back):
        at.append(int(b[at[-1]]))
    return [tags[k] for k in reversed(at)]


def spans(tags: list[str]) -> list[tuple[int, int, str]]:
    """(first, last + 1, label) by the tags as they are: B and S begin, E and S end, I without a span of its label begins one."""
    out, start, label = [], None, None
    for k, t in enumerate([*tags, "O"]):
        part, name = t[0], t[2:] or None
        if start is not None and (part in "OBS" or name != label):
            out.append((start, k, label))
            start = None
        if part in PARTS and start is None:
            start, label = k, name
        if part in "ES" and start is not None:
            out.append((start, k + 1, label))
            start = None
    return out

"""One-to-one assignment of greatest total score, with a named order where totals tie; runs on the pairs of one frame."""

from __future__ import annotations

from collections.abc import Hashable

import numpy as np

#: Totals that differ by less are ties; scores are of the order of one.
TIE = 1e-9
FORBIDDEN = 1e4
#: With up to so many columns the best of each set of taken ones is kept, which is faster than prices for few boxes.
FEW = 6


def shortest_paths(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimum-cost perfect matching of a square matrix by shortest augmenting paths.

    Returns the row of every column and the prices of rows and columns: no cost is below the sum of its two prices,
    and those of the matching, like those of every other optimum, equal it.
    """
    n = len(cost)
    rows, columns = np.zeros(n), np.zeros(n)
    row_of = np.full(n + 1, -1)  # the last place stands for the row that looks for a column
    for row in range(n):
        row_of[n], at = row, n
        near, back, done = np.full(n, np.inf), np.full(n, n), np.zeros(n + 1, bool)
        while row_of[at] >= 0:
            done[at] = True
            r = row_of[at]
            open_ = ~done[:n]
            away = cost[r] - rows[r] - columns
            closer = open_ & (away < near)
            near[closer], back[closer] = away[closer], at
            to = int(np.where(open_, near, np.inf).argmin())
            step = near[to]
            passed = np.flatnonzero(done[:n])
            rows[row_of[passed]] += step
            rows[row] += step
            columns[passed] -= step
            near[open_] -= step
            at = to
        while at != n:
            row_of[at] = row_of[back[at]]
            at = back[at]
    return row_of[:n], rows, columns


def first_optimum(score: np.ndarray, allowed: np.ndarray) -> list[tuple[int, int]]:
    """Of all one-to-one choices of allowed pairs with the greatest total score, the one that comes first: going through
    the rows in order, a row left free comes before a pair, and a smaller column before a larger one."""
    n, m = score.shape
    if min(n, m) == 1:
        # one pair at most: of the best, the first column of the only row, or the last row of the only column
        best = np.where(allowed, score, 0).max()
        good = np.argwhere(allowed & (score >= best - TIE))
        return [tuple(map(int, good[0] if n == 1 else good[-1]))] if best > TIE else []
    # each row may be free (its own column behind the others), and each column too (rows behind the others)
    cost = np.full((n + m, n + m), FORBIDDEN)
    cost[:n, :m][allowed] = -score[allowed]
    cost[np.arange(n), m + np.arange(n)] = 0
    cost[n + np.arange(m), np.arange(m)] = 0
    cost[n:, m:] = 0
    row_of, rows, columns = shortest_paths(cost)
    column_of = np.argsort(row_of)
    tight = cost - rows[:, None] - columns[None, :] < TIE
    settled = np.zeros(n + m, bool)
    for row in range(n):
        for column in [m + row, *np.flatnonzero(tight[row, :m])]:
            if settled[column] or not tight[row, column]:
                continue
            if column_of[row] != column and not _moved(row, column, row_of, column_of, tight, settled):
                continue
            settled[column] = True
            break
    return [(r, int(column_of[r])) for r in range(n) if column_of[r] < m]


def _moved(row: int, column: int, row_of: np.ndarray, column_of: np.ndarray, tight: np.ndarray, settled: np.ndarray) -> bool:
    """Gives column to row if the others can make room within the optima, along a circle of tight pairs."""
    goal, first = column_of[row], row_of[column]
    came: dict[int, int] = {}
    queue = [first]
    while queue and goal not in came:
        r = queue.pop(0)
        for c in np.flatnonzero(tight[r] & ~settled).tolist():
            if c != column and c not in came:
                came[c] = r
                queue.append(row_of[c])
    if goal not in came:
        return False
    c = goal
    while True:
        r = came[c]
        left = column_of[r]
        row_of[c], column_of[r] = r, c
        if r == first:
            break
        c = left
    row_of[column], column_of[row] = row, column
    return True


def first_of_few(options: list[list[tuple[int, float]]]) -> list[int]:
    """first_optimum() by the sets of columns taken so far: options are the columns of each row, in order, with their
    scores; the column of each row, or -1."""
    taken, reached = [{0}], {0}
    for own in options:
        reached = reached | {t | 1 << c for t in reached for c, _ in own if not t >> c & 1}
        taken.append(reached)
    # rest[r][t]: the most that rows from r on can add where t is taken
    rest: list[dict[int, float]] = [dict.fromkeys(reached, 0.0)]
    for own, sets in zip(reversed(options), reversed(taken[:-1])):
        after = rest[-1]
        rest.append({t: max([after[t], *(s + after[t | 1 << c] for c, s in own if not t >> c & 1)]) for t in sets})
    rest.reverse()
    enough, total, t, key = rest[0][0] - TIE, 0.0, 0, []
    for own, after in zip(options, rest[1:]):
        c, s = next(((c, s) for c, s in [(-1, 0.0), *own] if (c < 0 or not t >> c & 1) and total + s + after[t if c < 0 else t | 1 << c] >= enough), (-1, 0.0))
        key.append(c)
        total, t = total + s, t if c < 0 else t | 1 << c
    return key


def best_pairs(scores: dict[tuple[Hashable, Hashable], float]) -> set[tuple[Hashable, Hashable]]:
    """The chosen keys of scores, (left, right) each; boxes that cannot compete are settled apart."""
    by_left: dict = {}
    by_right: dict = {}
    for a, b in scores:
        by_left.setdefault(a, []).append(b)
        by_right.setdefault(b, []).append(a)
    chosen, seen = set(), set()
    for start in sorted(by_left):
        if start in seen:
            continue
        seen.add(start)
        lefts, rights, open_ = [start], set(), [start]
        while open_:
            for b in by_left[open_.pop()]:
                rights.add(b)
                for a in by_right[b]:
                    if a not in seen:
                        seen.add(a)
                        lefts.append(a)
                        open_.append(a)
        lefts.sort()
        columns = sorted(rights)
        if min(len(lefts), len(columns)) == 1:
            # one pair at most: of the best, the first column of the only row, or the last row of the only column
            pairs = [(a, b) for a in lefts for b in columns]
            enough = max(scores[k] for k in pairs) - TIE
            good = [k for k in pairs if scores[k] >= enough]
            if enough > 0:
                chosen.add(good[0] if len(lefts) == 1 else good[-1])
            continue
        if len(columns) <= FEW:
            place = {b: k for k, b in enumerate(columns)}
            options = [sorted((place[b], scores[a, b]) for b in by_left[a]) for a in lefts]
            chosen |= {(a, columns[c]) for a, c in zip(lefts, first_of_few(options)) if c >= 0}
            continue
        score, allowed = np.zeros((len(lefts), len(columns))), np.zeros((len(lefts), len(columns)), bool)
        for r, a in enumerate(lefts):
            for b in by_left[a]:
                score[r, columns.index(b)], allowed[r, columns.index(b)] = scores[a, b], True
        chosen |= {(lefts[r], columns[c]) for r, c in first_optimum(score, allowed)}
    return chosen

"""Links among the sets of one group, compared in memory."""

from __future__ import annotations

import numpy as np

#: Rows that are compared at once, and common elements that are gathered at once for them (a single row may have more).
ROWS, GATHERED = 256, 1 << 22
#: An element in fewer members than this is gathered from the members that hold it; one in more, and in an eighth of all, is a column.
RARE = 32


class _Shared:
    """The elements that at least two members of a group hold, by member and by element."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, percent: int):
        self.m, owner = len(n), np.repeat(np.arange(len(n)), n)
        _, at, f = np.unique(keys, return_inverse=True, return_counts=True)
        shared = np.bincount(owner[f[at] > 1], minlength=self.m)
        # A linked pair has so much of the larger set in common.
        self.able = (shared > 0) & (shared * 100 >= percent * n)
        keep = self.able[owner]
        owner, at = owner[keep], at[keep]
        f = np.bincount(at, minlength=len(f))
        keep = f[at] > 1
        owner, at = owner[keep], at[keep]
        self.weight = np.bincount(owner, weights=f[at], minlength=self.m)
        dense = f >= max(RARE, self.m / 8)
        self.width, column = int(dense.sum()), np.cumsum(dense) - 1
        often = dense[at]
        self.columns = self._by(owner[often], column[at[often]])
        self.rare = self._by(owner[~often], at[~often])
        self.elements = len(f)

    def _by(self, owner: np.ndarray, element: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bounds by member, elements)."""
        return np.r_[0, np.cumsum(np.bincount(owner, minlength=self.m))], element

    @staticmethod
    def _of(table: tuple[np.ndarray, np.ndarray], members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``members``, element) of these members."""
        bounds, element = table
        size = bounds[members + 1] - bounds[members]
        place = np.repeat(np.arange(len(members)), size)
        return place, element[np.arange(len(place)) + np.repeat(bounds[members] - np.r_[0, np.cumsum(size)[:-1]], size)]

    def _dense(self, members: np.ndarray) -> np.ndarray:
        out = np.zeros((len(members), self.width), np.float32)
        out[self._of(self.columns, members)] = 1
        return out

    def common(self, rows: np.ndarray, cols: np.ndarray, wanted=None):
        """(some of the rows, how many elements each has in common with each of ``cols``), piece by piece; of ``wanted`` rows when a piece begins."""
        held = self._dense(cols).T
        place, element = self._of(self.rare, cols)
        order = np.argsort(element, kind="stable")
        holders = place[order]
        bounds = np.r_[0, np.cumsum(np.bincount(element, minlength=self.elements))]
        place, element = self._of(self.rare, rows)
        gathers = np.cumsum(np.bincount(place, weights=bounds[element + 1] - bounds[element], minlength=len(rows)))
        first = 0
        while first < len(rows):
            last = int(np.searchsorted(gathers, (gathers[first - 1] if first else 0) + GATHERED, side="right"))
            last = min(max(last, first + 1), first + ROWS, len(rows))
            some = rows[first:last]
            first = last
            if wanted is not None:
                some = some[wanted(some)]
            if not len(some):
                continue
            out = (self._dense(some) @ held).astype(np.int64)
            place, element = self._of(self.rare, some)
            size = bounds[element + 1] - bounds[element]
            at = np.arange(size.sum()) + np.repeat(bounds[element] - np.r_[0, np.cumsum(size)[:-1]], size) if len(size) else np.zeros(0, np.int64)
            out += np.bincount(np.repeat(place, size) * len(cols) + holders[at], minlength=out.size).reshape(out.shape)
            yield some, out


def spanning_links(keys: np.ndarray, n: np.ndarray, comp: np.ndarray, block: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that bring together what the links among these sets bring together, fewer than sets: (member, member).

    ``keys`` holds the ``n`` elements of each set one after another; members of one ``comp`` are together already. If there are two
    blocks, only links from one to the other are asked for, others may be among the result. A pair links by ``100 * common >= percent * union``;
    every pair of two components is compared, but for those that are too large for what they share with anybody here.
    """
    sets, (_, comp) = _Shared(keys, n, percent), np.unique(comp, return_inverse=True)
    found: list[tuple[int, int]] = []

    def join(rows: np.ndarray, cols: np.ndarray, wanted=None) -> None:
        for some, common in sets.common(rows, cols, wanted):
            linked = common * 100 >= (n[some][:, None] + n[cols][None, :] - common) * percent
            linked &= comp[some][:, None] != comp[cols][None, :]
            for r in np.flatnonzero(linked.any(axis=1)):
                a, others = some[r], cols[linked[r]]
                others = others[comp[others] != comp[a]]
                names, at = np.unique(comp[others], return_index=True)
                found.extend((a, b) for b in others[at])
                comp[np.isin(comp, names)] = comp[a]

    everybody = np.flatnonzero(sets.able)
    if len(everybody):
        # What links to the member of the most common elements is together first: pairs among it need no look.
        join(np.array([everybody[np.argmax(sets.weight[everybody])]]), everybody)
        most = np.argmax(np.bincount(comp[everybody]))
        sides = [everybody[block[everybody] == b] for b in np.unique(block)]
        for mine, others in zip(sides, sides[::-1]):  # one block: with itself
            join(mine, others, lambda some: comp[some] != most)
    ab = np.array(found, np.int64).reshape(-1, 2)
    return ab[:, 0], ab[:, 1]

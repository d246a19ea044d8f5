"""A prefix tree of ordered sets and its walk by one probe.

Sets are sequences in one global order. Sets that begin alike share a path, so
what the probe shares with that path is counted once for all of them. Nodes
with one child are drawn together: an edge is a run of elements.
"""

from __future__ import annotations

import numpy as np

#: Elements of an edge that are compared before the bound is looked at again.
RUN = 256


class PrefixTree:
    """Tree over sequences of unsigned 64-bit elements, kept as the sorted sequences and the lengths of the prefixes that neighbours share."""

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].tobytes())
        self.sets = [sets[i] for i in self.order]
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        self.shared = np.zeros(len(sets), np.int64)
        for i in range(1, len(sets)):
            a, b = self.sets[i - 1], self.sets[i]
            k = min(len(a), len(b))
            differ = np.flatnonzero(a[:k] != b[:k])
            self.shared[i] = differ[0] if len(differ) else k

    def similar(self, probe: np.ndarray, parts: int = 4, whole: int = 5) -> list[int]:
        """Numbers of the sets whose Jaccard similarity with the probe is at least parts / whole.

        Overlap x of sets of n and m suffices when x (whole + parts) >= parts (n + m).
        Below a node at some depth a set can still share the rest of itself, or
        what of the probe comes after the last shared element: where that is too
        little for every size in the subtree, the subtree is left.
        """
        m, sizes = len(probe), self.sizes
        places = np.argsort(probe)
        known = probe[places]
        found, stack = [], [(0, len(self.sets), 0, 0, 0)] if self.sets else []
        while stack:
            low, high, depth, overlap, after = stack.pop()
            least, most = sizes[low:high].min(), sizes[low:high].max()
            end = self.shared[low + 1 : high].min() if high - low > 1 else sizes[low]
            alive = True
            while alive and depth < end and m:
                run = self.sets[low][depth : min(depth + RUN, end)]
                at = np.minimum(np.searchsorted(known, run), m - 1)
                hit = places[at[known[at] == run]]
                depth += len(run)
                if len(hit):
                    overlap, after = overlap + len(hit), int(hit.max()) + 1
                alive = (overlap + min(most - depth, m - after)) * (whole + parts) >= parts * (least + m)
            if not alive or not m:
                continue
            # The sets that end here come first; each other child begins where neighbours share no more than this.
            cuts = [low, *(low + 1 + np.flatnonzero(self.shared[low + 1 : high] == end)), high]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if sizes[a] == end:
                    if overlap * (whole + parts) >= parts * (end + m):
                        found.append(self.order[a])
                    a += 1
                if a < b:
                    stack.append((a, b, int(end), overlap, after))
        return found

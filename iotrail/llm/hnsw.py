"""Hierarchical navigable small-world graph over one shard of unit vectors, in numpy.

Nodes get a level from an exponential law. Layers are built from the top down; each takes its nodes in growing
batches: a batch searches the layer so far from where the layer above ends, adds its exact neighbours within
the batch, keeps diverse neighbours, and is linked back with pruning. Searches run many queries side by side.
"""

from __future__ import annotations

import pickle

import numpy as np

M, BUILD_BEAM, STEP = 12, 48, 4


class Graph:
    def __init__(self, vectors: np.ndarray, seed: int = 11):
        """``vectors``: unit rows, float32."""
        self.vectors = np.ascontiguousarray(vectors, np.float32)
        n = len(vectors)
        level = np.floor(-np.log(np.random.default_rng(seed).random(n)) / np.log(M)).astype(int)
        self.layers: list[tuple[np.ndarray, np.ndarray]] = []
        for depth in range(int(level.max()), -1, -1):
            nodes = np.flatnonzero(level >= depth)
            if depth and len(nodes) < 2:
                continue
            links = np.full((n, 2 * M if depth == 0 else M), -1, np.int32)
            self.layers.append((nodes, links))
            self._build(nodes, links)
        self._join_both_ways()

    def _join_both_ways(self) -> None:
        """Neighbours of the last layer in either direction, as offsets and ids: pruning leaves one-way links, and a
        node without any link to it is still met through its own."""
        links = self.layers[-1][1]
        source, slot = np.nonzero(links >= 0)
        target = links[source, slot]
        pair = np.unique(np.concatenate([source * len(links) + target, target.astype(np.int64) * len(links) + source]))
        self.around = pair % len(links)
        self.offset = np.searchsorted(pair, np.arange(len(links) + 1) * len(links))

    def to_bytes(self) -> bytes:
        return pickle.dumps((self.vectors, [(nodes, links[nodes]) for nodes, links in self.layers]), protocol=5)

    @classmethod
    def from_bytes(cls, data: bytes) -> Graph:
        graph = cls.__new__(cls)
        graph.vectors, layers = pickle.loads(data)
        graph.layers = []
        for nodes, own in layers:
            links = np.full((len(graph.vectors), own.shape[1]), -1, np.int32)
            links[nodes] = own
            graph.layers.append((nodes, links))
        graph._join_both_ways()
        return graph

    def _build(self, nodes: np.ndarray, links: np.ndarray) -> None:
        done, batch = 0, 32
        while done < len(nodes):
            new = nodes[done : done + batch]
            found = self._search(self.vectors[new], links, self._entries(self.vectors[new], nodes[:1]), BUILD_BEAM)[0] if done else np.empty((len(new), 0), np.int64)
            near = self.vectors[new] @ self.vectors[new].T
            np.fill_diagonal(near, -2)
            inner = np.argsort(-near, 1, kind="stable")[:, : min(BUILD_BEAM // 2, len(new) - 1)]
            candidates = np.concatenate([found, new[inner]], 1) if inner.size else found
            if candidates.size:
                chosen = self._diverse(new, candidates, min(M, candidates.shape[1]))
                links[new, : chosen.shape[1]] = chosen
                self._link_back(new, chosen, links)
            done += len(new)
            batch = min(512, max(32, done))

    def _diverse(self, of: np.ndarray, candidates: np.ndarray, keep: int) -> np.ndarray:
        """Up to ``keep`` candidates of each node, none nearer to a kept one than to the node; room left goes to the nearest of the rest."""
        sims = np.einsum("qd,qkd->qk", self.vectors[of], self.vectors[candidates])
        sims[(candidates < 0) | (candidates == of[:, None])] = -3
        order = np.argsort(-sims, 1, kind="stable")
        candidates, sims = np.take_along_axis(candidates, order, 1), np.take_along_axis(sims, order, 1)
        vectors = self.vectors[candidates]
        among = np.matmul(vectors, vectors.transpose(0, 2, 1))
        rows, width = candidates.shape
        kept, count = np.zeros((rows, width), bool), np.zeros(rows, int)
        for j in range(width):
            shadowed = (kept & (among[:, j] > sims[:, j : j + 1])).any(1)
            kept[:, j] = ~shadowed & (sims[:, j] > -2) & (count < keep)
            count += kept[:, j]
        twin = (candidates[:, :, None] == candidates[:, None, :]) & (np.arange(width)[None, :, None] > np.arange(width)[None, None, :])
        usable = (sims > -2) & ~twin.any(2)
        rank = np.where(kept & usable, 0, np.where(usable, 1, 2)) * width + np.arange(width)
        first = np.argsort(rank, 1, kind="stable")[:, :keep]
        out = np.take_along_axis(candidates, first, 1)
        out[np.take_along_axis(rank, first, 1) >= 2 * width] = -1
        return out

    def _link_back(self, new: np.ndarray, chosen: np.ndarray, links: np.ndarray) -> None:
        width = links.shape[1]
        source, target = np.repeat(new, chosen.shape[1]), chosen.ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.lexsort((-np.einsum("kd,kd->k", self.vectors[source], self.vectors[target]), target))
        source, target = source[order], target[order]
        first = np.concatenate([[True], target[1:] != target[:-1]])
        place = np.arange(len(target)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        source, target, place = source[place < width], target[place < width], place[place < width]
        hubs, at = np.unique(target, return_inverse=True)
        extra = np.full((len(hubs), width), -1, np.int64)
        extra[at, place] = source
        links[hubs] = self._diverse(hubs, np.concatenate([links[hubs], extra], 1), width)

    def _entries(self, queries: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Where each query enters the last layer: the end of the search through the layers above."""
        at = None
        for nodes, links in self.layers[:-1]:
            at = self._search(queries, links, np.repeat(nodes[:1][None], len(queries), 0) if at is None else at, 4)[0][:, :1]
        return np.repeat(start[None], len(queries), 0) if at is None else np.concatenate([at, np.repeat(start[None], len(queries), 0)], 1)

    def _search(self, queries: np.ndarray, links: np.ndarray, entries: np.ndarray, beam: int, least: float = 9.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """``(ids, similarities, seen, hits)``: the beam of each query, best first, -1 where there are fewer; ``hits`` are
        all nodes met of similarity ``least`` or more, also those that the beam had no room for."""
        hits: list[tuple[np.ndarray, np.ndarray]] = []
        n, q = len(self.vectors), len(queries)
        seen, mark = np.zeros(q * n, bool), np.zeros(q * n, np.int32)
        ids = np.full((q, beam), -1, np.int64)
        sims = np.full((q, beam), -4, np.float32)
        open_ = np.zeros((q, beam), bool)

        def take(rows: np.ndarray, nodes: np.ndarray) -> None:
            flat = rows[:, None] * n + nodes
            fresh = (nodes >= 0) & ~seen[flat]
            number = np.arange(nodes.size, dtype=np.int32).reshape(nodes.shape)
            mark[flat[fresh]] = number[fresh]
            fresh &= mark[flat] == number
            seen[flat[fresh]] = True
            value = np.where(fresh, np.einsum("qd,qkd->qk", queries[rows], self.vectors[nodes]), np.float32(-4))
            if least < 2:
                row, col = np.nonzero(value >= least)
                hits.append((rows[row], nodes[row, col]))
            both_ids, both = np.concatenate([ids[rows], np.where(fresh, nodes, -1)], 1), np.concatenate([sims[rows], value], 1)
            both_open = np.concatenate([open_[rows], fresh], 1)
            best = np.argpartition(-both, beam - 1, 1)[:, :beam] if both.shape[1] > beam else np.tile(np.arange(beam), (len(rows), 1))
            ids[rows], sims[rows], open_[rows] = (np.take_along_axis(x, best, 1) for x in (both_ids, both, both_open))

        take(np.arange(q), entries.astype(np.int64))
        while len(rows := np.flatnonzero(open_.any(1))):
            value = np.where(open_[rows], sims[rows], np.float32(-5))
            step = min(STEP, beam)
            pick = np.argpartition(-value, step - 1, 1)[:, :step]
            real = np.take_along_axis(value, pick, 1) > -4
            nodes = np.where(real, np.take_along_axis(ids[rows], pick, 1), 0)
            open_[rows[:, None], pick] = False
            around = np.where(real[:, :, None], links[nodes], -1).reshape(len(rows), -1)
            take(rows, around.astype(np.int64))
        order = np.argsort(-sims, 1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1), seen, hits

    def within(self, queries: np.ndarray, least: float, beam: int, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """``(query, node)`` pairs of similarity ``least`` or more: a beam search, then the ball of hits is walked to its edge."""
        found_q, found_n = [], []
        links = self.layers[-1][1]
        n = len(self.vectors)
        for start in range(0, len(queries), block):
            part = queries[start : start + block]
            _, _, seen, hits = self._search(part, links, self._entries(part, self.layers[-1][0][:1]), min(beam, n), least)
            row, node = (np.concatenate(x) for x in zip(*hits))
            while len(row):
                found_q.append(row + start)
                found_n.append(node)
                degree = self.offset[node + 1] - self.offset[node]
                ends = np.cumsum(degree)
                at = np.repeat(self.offset[node] - (ends - degree), degree) + np.arange(ends[-1])
                flat = np.unique(np.repeat(row, degree) * n + self.around[at])
                flat = flat[~seen[flat]]
                seen[flat] = True
                row, node = flat // n, flat % n
                hit = np.einsum("kd,kd->k", part[row], self.vectors[node]) >= least
                row, node = row[hit], node[hit]
        empty = np.empty(0, np.int64)
        return np.concatenate([empty, *found_q]), np.concatenate([empty, *found_n])

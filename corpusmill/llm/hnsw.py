"""A hierarchical navigable small-world graph in flat neighbour arrays, built and searched in batches with numpy.

Nodes are put in descending order of their level, so layer l holds the first sizes[l] nodes and is one int32
array of neighbours, padded with -1. The top layer is small and scanned whole; lower layers are walked by a
beam, many queries at a time.
"""

from __future__ import annotations

import numpy as np

DEGREE = 12
BEAM_BUILD = 24
BEAM_SEARCH = 24
TOP_LAYER = 256
STEP = 4
BATCH = 512


def _pair_dots(x: np.ndarray, rows: np.ndarray, q: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.einsum("nd,nd->n", x[rows], q[at])


def _diverse(x: np.ndarray, cand: np.ndarray, sim: np.ndarray, degree: int) -> np.ndarray:
    """Choose up to degree of each row's candidates (best first, -1 padded): those nearer to the row than to any chosen one, then the best left."""
    n, c = cand.shape
    v = x[np.maximum(cand, 0)]
    between = np.matmul(v, v.transpose(0, 2, 1))
    chosen = np.zeros((n, c), bool)
    worst = np.full((n, c), -np.inf, np.float32)  # each candidate's largest similarity to a chosen one
    count = np.zeros(n, np.int32)
    for j in range(c):
        ok = (cand[:, j] >= 0) & (count < degree) & (sim[:, j] > worst[:, j])
        chosen[:, j] = ok
        count += ok
        r = np.nonzero(ok)[0]
        worst[r] = np.maximum(worst[r], between[r, j])
    key = np.where(cand < 0, 2, np.where(chosen, 0, 1)) * c + np.arange(c)
    pick = np.argsort(key, axis=1)[:, :degree]
    out = np.take_along_axis(cand, pick, 1)
    if out.shape[1] < degree:
        out = np.pad(out, ((0, 0), (0, degree - out.shape[1])), constant_values=-1)
    return out.astype(np.int32)


class FlatHnsw:
    """Index over the rows of x (unit vectors, float32)."""

    def __init__(self, x: np.ndarray, degree: int = DEGREE, beam: int = BEAM_BUILD, seed: int = 7):
        n = len(x)
        level = np.floor(-np.log(np.random.default_rng(seed).random(n) + 1e-12) / np.log(degree)).astype(int)
        self.order = np.argsort(-level, kind="stable")
        self.place = np.argsort(self.order)
        self.x = np.ascontiguousarray(x[self.order])
        self.degree, self.beam = degree, beam
        self.sizes = [n]
        for lv in range(1, level.max(initial=0) + 1):
            if self.sizes[-1] <= TOP_LAYER:
                break
            self.sizes.append(max(int((level >= lv).sum()), min(TOP_LAYER, n)))
        self.layers: list[np.ndarray] = [np.empty((0, 0), np.int32)] * len(self.sizes)
        for lv in range(len(self.sizes) - 1, -1, -1):
            self._build(lv)

    def _build(self, lv: int) -> None:
        n, width = self.sizes[lv], self.degree * (2 if lv == 0 else 1)
        graph = np.full((n, width), -1, np.int32)
        self.layers[lv] = graph
        if lv + 1 < len(self.sizes):
            done = self.sizes[lv + 1]
            upper = self.layers[lv + 1]
            graph[:done, : upper.shape[1]] = upper
        else:
            done = min(n, TOP_LAYER)
            if done > 1:
                s = self.x[:done] @ self.x[:done].T
                np.fill_diagonal(s, -np.inf)
                k = min(2 * self.degree, done - 1)
                c = np.argsort(-s, axis=1)[:, :k]
                cs = np.take_along_axis(s, c, 1)
                graph[:done, : self.degree] = _diverse(self.x, c, cs, self.degree)
                self._link_back(graph, np.arange(done, dtype=np.int32), graph[:done, : self.degree].copy())
        while done < n:
            stop = min(n, done + min(done, 4 * BATCH))
            new = np.arange(done, stop, dtype=np.int32)
            ids, sims = self._walk(self.x[done:stop], lv, self.beam, limit=done)
            near = self.x[done:stop] @ self.x[done:stop].T  # the batch's rows don't see each other in the graph
            np.fill_diagonal(near, -np.inf)
            k = min(self.degree, stop - done - 1)
            if k > 0:
                c = np.argpartition(-near, k - 1, axis=1)[:, :k] if k < near.shape[1] else np.argsort(-near, axis=1)[:, :k]
                ids = np.hstack([ids, c + done])
                sims = np.hstack([sims, np.take_along_axis(near, c, 1)])
            rank = np.argsort(-sims, axis=1)[:, : 2 * self.degree]
            ids, sims = np.take_along_axis(ids, rank, 1), np.take_along_axis(sims, rank, 1)
            ids[~np.isfinite(sims)] = -1
            picked = _diverse(self.x, ids, sims, self.degree)
            graph[done:stop, : self.degree] = picked
            self._link_back(graph, new, picked)
            done = stop

    def _link_back(self, graph: np.ndarray, nodes: np.ndarray, picked: np.ndarray) -> None:
        """Add each node to its neighbours' lists; a list over its width keeps a diverse choice of the best."""
        width = graph.shape[1]
        src, dst = np.repeat(nodes, picked.shape[1]), picked.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        known = (graph[dst] == src[:, None]).any(axis=1)
        src, dst = src[~known], dst[~known]
        if not len(src):
            return
        sim = _pair_dots(self.x, src, self.x, dst)
        at = np.lexsort((-sim, dst))
        src, dst, sim = src[at], dst[at], sim[at]
        targets, first, counts = np.unique(dst, return_index=True, return_counts=True)
        rank = np.arange(len(dst)) - np.repeat(first, counts)
        row = np.repeat(np.arange(len(targets)), counts)
        keep = rank < width
        more = np.full((len(targets), width), -1, np.int32)
        more[row[keep], rank[keep]] = src[keep]
        for lo in range(0, len(targets), 4 * BATCH):
            t = targets[lo : lo + 4 * BATCH]
            both = np.hstack([graph[t], more[lo : lo + len(t)]])
            sims = np.einsum("nkd,nd->nk", self.x[np.maximum(both, 0)], self.x[t])
            sims[both < 0] = -np.inf
            full = (both >= 0).sum(1) > width
            by = np.argsort(-sims, axis=1)
            both, sims = np.take_along_axis(both, by, 1), np.take_along_axis(sims, by, 1)
            out = both[:, :width].copy()
            if full.any():
                out[full] = _diverse(self.x, both[full], sims[full], width)
            graph[t] = out

    def _walk(self, q: np.ndarray, floor: int, beam: int, limit: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Best nodes of layer `floor` for each query: ids and similarities, best first, -1 and -inf padded. limit: nodes in that layer so far."""
        found = [self._walk_batch(q[i : i + BATCH], floor, beam, limit) for i in range(0, len(q), BATCH)]
        return np.vstack([f[0] for f in found]), np.vstack([f[1] for f in found])

    def _walk_batch(self, q, floor, beam, limit):
        top = len(self.sizes) - 1
        head = min(self.sizes[top], TOP_LAYER)
        if limit is not None and floor == top:
            head = min(head, limit)
        s = q @ self.x[:head].T
        k = min(beam, head)
        ids = np.argpartition(-s, k - 1, axis=1)[:, :k].astype(np.int32)
        sims = np.take_along_axis(s, ids, 1)
        for lv in range(top, floor - 1, -1):
            width = beam if lv == floor else max(8, beam // 4)
            ids, sims = self._beam(q, lv, ids, sims, width)
        return ids, sims

    def _beam(self, q, lv, ids, sims, beam):
        graph, n, b = self.layers[lv], self.sizes[lv], len(q)
        rank = np.argsort(-sims, axis=1)[:, :beam]
        ids, sims = np.take_along_axis(ids, rank, 1), np.take_along_axis(sims, rank, 1)
        if ids.shape[1] < beam:
            pad = ((0, 0), (0, beam - ids.shape[1]))
            ids, sims = np.pad(ids, pad, constant_values=-1), np.pad(sims, pad, constant_values=-np.inf)
        seen = np.full((b, n), -1, np.int16)
        r = np.arange(b)[:, None]
        good = ids >= 0
        seen[np.broadcast_to(r, ids.shape)[good], ids[good]] = 0
        opened = ~good
        live = np.arange(b)
        while len(live):
            score = np.where(opened[live], -np.inf, sims[live])
            pick = np.argsort(-score, axis=1)[:, :STEP]
            usable = np.isfinite(np.take_along_axis(score, pick, 1))
            any_left = usable[:, 0]
            live, pick, usable = live[any_left], pick[any_left], usable[any_left]
            if not len(live):
                break
            opened[live[:, None], pick] = True
            nb = graph[np.where(usable, ids[live[:, None], pick], 0)]
            nb[~usable] = -1
            nb = nb.reshape(len(live), -1)
            rows = np.broadcast_to(live[:, None], nb.shape)
            fresh = nb >= 0
            rf, nf = rows[fresh], nb[fresh]
            col = np.broadcast_to(np.arange(nb.shape[1], dtype=np.int16), nb.shape)[fresh]
            new = seen[rf, nf] < 0
            rf, nf, col = rf[new], nf[new], col[new]
            seen[rf, nf] = col
            last = seen[rf, nf] == col  # a node met twice in one step counts once
            rf, nf, col = rf[last], nf[last], col[last]
            dots = _pair_dots(self.x, nf, q, rf)
            at = np.empty(b, np.int64)
            at[live] = np.arange(len(live))
            ns = np.full(nb.shape, -np.inf, np.float32)
            ns[at[rf], col] = dots
            all_s = np.hstack([sims[live], ns])
            all_i = np.hstack([ids[live], nb])
            all_o = np.hstack([opened[live], ~np.isfinite(ns)])
            part = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
            sims[live] = np.take_along_axis(all_s, part, 1)
            ids[live] = np.take_along_axis(all_i, part, 1)
            opened[live] = np.take_along_axis(all_o, part, 1)
        ids[~np.isfinite(sims)] = -1
        by = np.argsort(-sims, axis=1)
        return np.take_along_axis(ids, by, 1), np.take_along_axis(sims, by, 1)

    def search(self, q: np.ndarray, k: int, beam: int = BEAM_SEARCH, nodes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers of x and similarities of the k best found for each query, -1 and -inf padded.

        nodes: where each query is itself a row of x, its number; the walk then starts at its own neighbours and needs no upper layer.
        """
        if not len(self.x):
            return np.full((len(q), k), -1), np.full((len(q), k), -np.inf, np.float32)
        wide = max(beam, k)
        ids, sims = self._walk(q, 0, wide) if nodes is None else self._from_nodes(q, self.place[nodes], wide)
        ids, sims = ids[:, :k], sims[:, :k]
        return np.where(ids >= 0, self.order[np.maximum(ids, 0)], -1), sims

    def _from_nodes(self, q: np.ndarray, at: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        found = []
        for lo in range(0, len(q), BATCH):
            part, own = q[lo : lo + BATCH], at[lo : lo + BATCH]
            ids = np.hstack([own[:, None].astype(np.int32), self.layers[0][own]])
            sims = np.einsum("nkd,nd->nk", self.x[np.maximum(ids, 0)], part)
            sims[ids < 0] = -np.inf
            found.append(self._beam(part, 0, ids, sims, beam))
        return np.vstack([f[0] for f in found]), np.vstack([f[1] for f in found])

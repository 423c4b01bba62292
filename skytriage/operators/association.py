"""Per-frame association used inside the tracking fold.

Arrays over the tracks that are alive; nothing here grows with the length of a video.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class TrackerConfig:
    high_threshold: float = 0.5
    low_threshold: float = 0.1
    iou_threshold: float = 0.3
    max_age: int = 30
    min_hits: int = 3
    centre_distance_factor: float = 2.0

    def __post_init__(self) -> None:
        if not 0.0 <= self.low_threshold < self.high_threshold <= 1.0:
            raise ValueError("thresholds must satisfy 0 <= low < high <= 1")


def box_affinity(tracks: np.ndarray, boxes: np.ndarray, threshold: float, factor: float) -> np.ndarray:
    """Affinity of the boxes in the last axis of two arrays that go together."""
    (a, b, c, d), (e, f, g, h) = np.moveaxis(tracks, -1, 0), np.moveaxis(boxes, -1, 0)
    inter = np.clip(np.minimum(c, g) - np.maximum(a, e), 0.0, None) * np.clip(np.minimum(d, h) - np.maximum(b, f), 0.0, None)
    size = (c - a) * (d - b)
    overlap = inter / (size + (g - e) * (h - f) - inter)
    strong = np.where(overlap >= threshold, overlap, 0.0)
    if factor <= 0:
        return strong
    dx, dy = (a + c - e - g) / 2, (b + d - f - h) / 2
    scale = factor * np.maximum(np.sqrt(size), 1e-6)
    return np.maximum(strong, np.clip(1.0 - np.sqrt(dx * dx + dy * dy) / scale, 0.0, 1.0) * threshold * 0.999)


def pairwise_affinity(tracks: np.ndarray, boxes: np.ndarray, threshold: float, factor: float) -> np.ndarray:
    return box_affinity(tracks[:, None], boxes[None], threshold, factor)


def _assign(weights: np.ndarray) -> list[tuple[int, int]]:
    """Maximum-weight assignment of a small block by shortest augmenting paths."""
    flip = weights.shape[0] > weights.shape[1]
    cost = -(weights.T if flip else weights)
    n, m = cost.shape
    row_price, col_price = np.zeros(n), np.zeros(m)
    row_of = np.full(m, -1)
    for start in range(n):
        dist, back, open_cols = np.full(m, np.inf), np.full(m, -1), np.ones(m, dtype=bool)
        row, reached, col = start, 0.0, -1
        rows, cols = [start], []
        while True:
            through = reached + cost[row] - row_price[row] - col_price
            better = open_cols & (through < dist)
            dist[better], back[better] = through[better], row
            col = int(np.argmin(np.where(open_cols, dist, np.inf)))
            reached = dist[col]
            open_cols[col] = False
            if row_of[col] < 0:
                break
            cols.append(col)
            row = int(row_of[col])
            rows.append(row)
        row_price[start] += reached
        for c in cols:
            row_price[row_of[c]] += reached - dist[c]
            col_price[c] -= reached - dist[c]
        holder = {r: int(np.flatnonzero(row_of == r)[0]) for r in rows if r != start}
        while True:
            r = int(back[col])
            row_of[col] = r
            if r == start:
                break
            col = holder[r]
    pairs = [(int(row_of[c]), c) for c in range(m) if row_of[c] >= 0]
    return [(b, a) for a, b in pairs] if flip else pairs


def best_pairs(weights: np.ndarray) -> list[tuple[int, int]]:
    """Optimal pairing over the positive weights of a matrix."""
    rows, cols = np.nonzero(weights > 0)
    r, c = optimal_pairs(rows, cols, weights[rows, cols])
    return sorted(zip(r.tolist(), c.tolist()))


def optimal_pairs(rows: np.ndarray, cols: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Optimal pairing over listed pairs of positive weight; independent groups are solved on their own."""
    if not len(rows):
        return rows, cols
    alone = (np.bincount(rows)[rows] == 1) & (np.bincount(cols)[cols] == 1)
    by_row: dict[int, dict[int, float]] = {}
    by_col: dict[int, list[int]] = {}
    for r, c, w in zip(rows[~alone].tolist(), cols[~alone].tolist(), weights[~alone].tolist()):
        by_row.setdefault(r, {})[c] = w
        by_col.setdefault(c, []).append(r)
    out: list[tuple[int, int]] = []
    seen: set[int] = set()
    for first in by_row:
        if first in seen:
            continue
        group_r, group_c, todo = {first}, set(), [first]
        while todo:
            for c in by_row[todo.pop()]:
                if c not in group_c:
                    group_c.add(c)
                    new = set(by_col[c]) - group_r
                    group_r |= new
                    todo += new
        seen |= group_r
        rs, cs = sorted(group_r), sorted(group_c)
        block = np.array([[by_row[r].get(c, 0.0) for c in cs] for r in rs])
        out += [(rs[i], cs[j]) for i, j in _assign(block) if block[i, j] > 0]
    r, c = np.array(out, dtype=np.int64).reshape(-1, 2).T
    return np.concatenate([rows[alone], r]), np.concatenate([cols[alone], c])


#: Pairs of a track and a box that are looked at together.
_PAIRS = 1 << 20


class FrameTracker:
    """Tracks alive at one moment in any number of pieces of video, advanced one frame at a time.

    A piece is known by a number, its home; tracks and boxes meet within their home only, and a
    step costs a few operations on arrays however many homes it advances. Tracks are kept by
    home and, within it, in the order they started.

    The constant-velocity filter separates by coordinate: both centre coordinates share
    one 2x2 covariance and both sizes share one variance, so a track needs six means and
    four numbers of uncertainty. State is plain arrays, which makes it cheap to store.
    """

    def __init__(self, config: TrackerConfig) -> None:
        self.config = config
        self.home = np.zeros(0, dtype=np.int64)
        self.mean = np.zeros((0, 6))
        self.cov = np.zeros((0, 4))
        self.meta = np.zeros((0, 3), dtype=np.int64)  # number, hits, frames since update
        self.confirmed = np.zeros(0, dtype=bool)
        self.spawned = np.zeros(1, dtype=np.int64)  # per home
        # Observations of tracks not confirmed yet: place of the track, then (tag, box, score).
        self.waiting_at = np.zeros(0, dtype=np.int64)
        self.waiting: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def state(self) -> dict:
        """What a tracker of one home with one column of tags holds."""
        held: dict[int, list] = {}
        if self.waiting is not None:
            for n, (tag,), box, score in zip(self.meta[self.waiting_at, 0].tolist(), *(a.tolist() for a in self.waiting)):
                held.setdefault(n, []).append([n, tag, *box, score])
        return {"mean": self.mean.tolist(), "cov": self.cov.tolist(), "meta": self.meta.tolist(),
                "confirmed": self.confirmed.tolist(), "waiting": [[k, v] for k, v in held.items()], "spawned": int(self.spawned[0])}

    @classmethod
    def restore(cls, config: TrackerConfig, state: dict) -> FrameTracker:
        t = cls(config)
        t.mean = np.array(state["mean"], dtype=np.float64).reshape(-1, 6)
        t.cov = np.array(state["cov"], dtype=np.float64).reshape(-1, 4)
        t.meta = np.array(state["meta"], dtype=np.int64).reshape(-1, 3)
        t.home = np.zeros(len(t.meta), dtype=np.int64)
        t.confirmed = np.array(state["confirmed"], dtype=bool)
        rows = [row for _, held in state["waiting"] for row in held]
        if rows:
            t.waiting_at = np.searchsorted(t.meta[:, 0], [r[0] for r in rows])
            t.waiting = (np.array([r[1:2] for r in rows], dtype=np.int64), np.array([r[2:6] for r in rows], dtype=np.float64),
                         np.array([r[6] for r in rows], dtype=np.float64))
        t.spawned[0] = int(state["spawned"])
        return t

    def _predict(self) -> None:
        m, c = self.mean, self.cov
        m[:, 0] += m[:, 4]
        m[:, 1] += m[:, 5]
        c[:, 0] += 2 * c[:, 1] + c[:, 2] + 1.0
        c[:, 1] += c[:, 2]
        c[:, 2] += 10.0
        c[:, 3] += 1.0
        self.meta[:, 2] += 1

    def _boxes(self, idx: np.ndarray) -> np.ndarray:
        half = np.maximum(self.mean[idx, 2:4], 1e-6) / 2
        return np.hstack([self.mean[idx, :2] - half, self.mean[idx, :2] + half])

    def _pairs(self, free: np.ndarray, home: np.ndarray, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``free`` and in ``boxes`` (by home) of the tracks and boxes that go together."""
        cfg, own, tracks = self.config, self.home[free], self._boxes(free)
        first, last = np.searchsorted(own, home, "left"), np.searchsorted(own, home, "right")
        many, a = last - first, 0
        upto, found = np.cumsum(many), []
        while a < len(home):
            b = max(a + 1, int(np.searchsorted(upto, upto[a] - many[a] + _PAIRS, "right")))
            n = many[a:b]
            d = np.repeat(np.arange(a, b), n)
            t = np.arange(len(d)) - np.repeat(np.cumsum(n) - n - first[a:b], n)
            with np.errstate(invalid="ignore", divide="ignore"):
                w = box_affinity(tracks[t], boxes[d], cfg.iou_threshold, cfg.centre_distance_factor)
            near = w > 0
            found.append((t[near], d[near], w[near]))
            a = b
        if not found:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return optimal_pairs(*(np.concatenate(c) for c in zip(*found)))

    def _correct(self, i: np.ndarray, boxes: np.ndarray) -> None:
        z = _centred(boxes)
        m, c = self.mean[i], self.cov[i]
        gain, vgain, sgain = c[:, 0] / (c[:, 0] + 1), c[:, 1] / (c[:, 0] + 1), c[:, 3] / (c[:, 3] + 1)
        off = z - m[:, :4]
        m[:, 4:6] += vgain[:, None] * off[:, :2]
        m[:, :2] += gain[:, None] * off[:, :2]
        m[:, 2:4] += sgain[:, None] * off[:, 2:]
        c[:, 2] -= vgain * c[:, 1]
        c[:, 1] *= 1 - gain
        c[:, 0] *= 1 - gain
        c[:, 3] *= 1 - sgain
        self.mean[i], self.cov[i] = m, c
        self.meta[i, 1] += 1
        self.meta[i, 2] = 0

    def _keep(self, idx: np.ndarray) -> None:
        self.home, self.mean, self.cov, self.meta, self.confirmed = (
            a[idx] for a in (self.home, self.mean, self.cov, self.meta, self.confirmed))

    def skip(self, n_frames: int) -> None:
        """Frames without any detection: only ageing."""
        none = np.zeros(0, dtype=np.int64)
        for _ in range(n_frames):
            if not len(self.meta):
                return
            self.step(none, np.zeros((0, 4)), np.zeros(0), None)

    def step(self, home: np.ndarray, boxes: np.ndarray, scores: np.ndarray, tags: np.ndarray | None) -> tuple[np.ndarray, ...] | None:
        """One frame of every home; boxes come by home, with a row of tags each.

        Returns what became certain: home and number of the track, tags, box, score.
        Observations of a track that is not confirmed yet wait until it is; they vanish
        with it if it never gets there.
        """
        cfg = self.config
        self._predict()
        free = np.arange(len(self.meta))
        high = np.flatnonzero(scores >= cfg.high_threshold)
        low = np.flatnonzero((scores >= cfg.low_threshold) & (scores < cfg.high_threshold))
        unmatched_high = high
        at, seen = [self.waiting_at], []
        for pool in (high, low):
            if not len(pool) or not len(free):
                continue
            t, d = self._pairs(free, home[pool], boxes[pool])
            self._correct(free[t], boxes[pool[d]])
            at.append(free[t])
            seen.append(pool[d])
            free = np.delete(free, t)
            if pool is high:
                unmatched_high = np.delete(high, d)
        keep = np.ones(len(self.meta), dtype=bool)
        keep[free] = self.confirmed[free] & (self.meta[free, 2] <= cfg.max_age)
        n_left = int(keep.sum())
        self._keep(keep)
        self._spawn(home[unmatched_high], boxes[unmatched_high])
        at.append(len(keep) + np.arange(len(unmatched_high)))
        seen.append(unmatched_high)
        # Tracks go back to the order of their homes; places of observations follow.
        order = np.argsort(self.home, kind="stable")
        self._keep(order)
        self.confirmed |= self.meta[:, 1] >= cfg.min_hits
        moved = np.empty(len(order), dtype=np.int64)
        moved[order] = np.arange(len(order))
        place = np.full(len(keep) + len(unmatched_high), -1)
        place[:len(keep)][keep] = moved[:n_left]
        place[len(keep):] = moved[n_left:]
        where, new = place[np.concatenate(at)], np.concatenate(seen)
        if not len(where):
            return None
        held = self.waiting
        rows = held if not len(new) else tuple(a[new] for a in (tags, boxes, scores))
        if held is not None and len(new):
            rows = tuple(np.concatenate(p) for p in zip(held, rows))
        ready = np.zeros(len(where), dtype=bool)
        ready[where >= 0] = self.confirmed[where[where >= 0]]
        stay = (where >= 0) & ~ready
        self.waiting_at, self.waiting = where[stay], tuple(a[stay] for a in rows)
        i = where[ready]
        return (self.home[i], self.meta[i, 0], *(a[ready] for a in rows)) if len(i) else None

    def _spawn(self, home: np.ndarray, boxes: np.ndarray) -> None:
        n = len(home)
        if not n:
            return
        self.spawned = np.pad(self.spawned, (0, max(0, int(home[-1]) + 1 - len(self.spawned))))
        starts = np.flatnonzero(np.diff(home, prepend=-1))
        number = self.spawned[home] + 1 + np.arange(n) - np.repeat(starts, np.diff(starts, append=n))
        np.add.at(self.spawned, home, 1)
        self.home = np.concatenate([self.home, home])
        self.mean = np.vstack([self.mean, np.hstack([_centred(boxes), np.zeros((n, 2))])])
        self.cov = np.vstack([self.cov, np.tile([10.0, 0.0, 1000.0, 10.0], (n, 1))])
        self.meta = np.vstack([self.meta, np.column_stack([number, np.ones(n, dtype=np.int64), np.zeros(n, dtype=np.int64)])])
        self.confirmed = np.append(self.confirmed, np.zeros(n, dtype=bool))


def _centred(boxes: np.ndarray) -> np.ndarray:
    """Centre and size of corner boxes."""
    a, b, c, d = boxes.T
    return np.column_stack([(a + c) / 2, (b + d) / 2, c - a, d - b])

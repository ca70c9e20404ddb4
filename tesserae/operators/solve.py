"""Small numerical problems, one group each, in NumPy: peeling lines, pose graphs, greedy merges
of cell sets. Groups are captures or surfaces of bounded size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators import sequence
from tesserae.session import Steps


def peel(perp: np.ndarray, along: np.ndarray, height: np.ndarray, tolerance: float, least: int, extent: float, most: int) -> list[tuple]:
    """Lines at constant perp: the place with most points within the tolerance (the first of equals)
    is refitted to its points' median; its points go, and the next line is sought."""
    order = np.argsort(perp, kind="stable")
    p, a, h = perp[order], along[order], height[order]
    left, lines = np.ones(p.size, dtype=bool), []
    for _ in range(most):
        at = np.flatnonzero(left)
        if at.size < least:
            break
        q = p[at]
        counts = np.searchsorted(q, q + tolerance, side="right") - np.searchsorted(q, q - tolerance, side="left")
        best = int(counts.argmax())
        if counts[best] < least:
            break
        near = at[np.abs(q - q[best]) <= tolerance]
        middle = float(np.median(p[near]))
        near = at[np.abs(q - middle) <= tolerance]
        left[near] = False
        if near.size >= least and a[near].max() - a[near].min() >= extent:
            lines.append((middle, float(a[near].min()), float(a[near].max()), int(near.size), float(np.percentile(h[near], 98))))
    return lines


def peel_lines(points: DataFrame, keys: list[str], perp: str, along: str, height: str, tolerance: float = 0.05, least: int = 150, extent: float = 0.6, most: int = 14) -> DataFrame:
    kinds = dict(points.dtypes)
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "line int, coord double, lo double, hi double, inliers long, top double"])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        lines = peel(*(pdf[c].to_numpy(float) for c in (perp, along, height)), tolerance, least, extent, most)
        return pd.DataFrame([(*key, i, *x) for i, x in enumerate(lines)], columns=[*keys, "line", "coord", "lo", "hi", "inliers", "top"])

    return points.select(*keys, perp, along, height).groupBy(*keys).applyInPandas(run, schema)


def _turned(angle: np.ndarray) -> np.ndarray:
    return (angle + np.pi) % (2 * np.pi) - np.pi


def _walked(first: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Poses that start at `first` and take the moves, each in the frame of the pose before it."""
    yaw = np.concatenate([[first[3]], first[3] + np.cumsum(moves[:, 3])])
    c, s = np.cos(yaw[:-1]), np.sin(yaw[:-1])
    steps = np.column_stack([c * moves[:, 0] - s * moves[:, 1], s * moves[:, 0] + c * moves[:, 1], moves[:, 2]])
    return np.column_stack([np.vstack([first[:3], first[:3] + np.cumsum(steps, axis=0)]), yaw])


def _seen(pose: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Poses b in the frames of poses a."""
    d = pose[b] - pose[a]
    c, s = np.cos(pose[a, 3]), np.sin(pose[a, 3])
    return np.column_stack([c * d[:, 0] + s * d[:, 1], -s * d[:, 0] + c * d[:, 1], d[:, 2], d[:, 3]])


def _conjugate(product, right: np.ndarray, guess: np.ndarray, tolerance: float = 1e-13, rounds: int = 20) -> np.ndarray:
    """What a positive definite product takes to `right`, by conjugate gradients from a guess; `rounds` times as many steps as
    there are unknowns at most, since rounding takes more than the one each that exact numbers need."""
    x, left = guess, right - product(guess)
    along, size = left, float((left * left).sum())
    goal = tolerance**2 * float((right * right).sum())
    for _ in range(rounds * right.size):
        if not size > goal:
            break
        moved = product(along)
        share = size / float((along * moved).sum())
        x, left = x + share * along, left - share * moved
        size, before = float((left * left).sum()), size
        along = left + size / before * along
    return x


def solve_pose_graph(start: np.ndarray, edges: np.ndarray, weights: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Poses (x, y, z, yaw) whose relative poses fit the edges (a, b, dx, dy, dz, dyaw) in weighted
    least squares; pose 0 stays. Each pose has one edge to the next, its move; the others are closures.

    Gauss-Newton over the moves: these alone have a diagonal normal matrix, so that a step needs no more than a system of four
    equations a closure. It is solved by conjugate gradients, whose products are sums along the stretches between closures' ends:
    memory grows with poses and closures, not with the square of either. A step that makes the fit worse is halved."""
    a, b = edges[:, 0].astype(int), edges[:, 1].astype(int)
    n = len(start)
    chain = np.full(n - 1, -1)
    near = np.flatnonzero(b == a + 1)[::-1]
    chain[a[near]] = near  # the first of several
    if (chain < 0).any():
        raise ValueError("neighbouring poses need an edge")
    far = np.setdiff1d(np.arange(len(a)), chain)
    i, j, target = a[far], b[far], edges[far, 2:6]
    given, free, slack = edges[chain, 2:6], 1 / weights[chain, None] ** 2, 1 / weights[far, None] ** 2
    moves = _seen(start, np.arange(n - 1), np.arange(1, n))
    moves[:, 3] = given[:, 3] + _turned(moves[:, 3] - given[:, 3])

    def residual(pose: np.ndarray) -> np.ndarray:
        r = _seen(pose, i, j) - target
        r[:, 3] = _turned(r[:, 3])
        return r

    # the poses at which closures end, and where they lie among them; a stretch of moves between two of these bends as one
    nodes, places = np.unique(np.concatenate([i, j]), return_inverse=True)
    at_i, at_j = places[: len(i)], places[len(i) :]
    stretch = np.repeat(np.arange(len(nodes) - 1), np.diff(nodes))

    def derivatives(pose: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the shifts of all that follows by the moves, about the middle of the poses, and of the closures by the shifts of
        their ends: a closure's derivative by a move between its ends is the product of its own and the move's. One place each, last axis."""
        x, y = (pose[:, :2] - pose[:, :2].mean(axis=0)).T
        of_moves, of_ends = (np.repeat(np.eye(4)[:, :, None], k, axis=2) for k in (n - 1, len(i)))
        c, s = np.cos(pose[:-1, 3]), np.sin(pose[:-1, 3])
        of_moves[0, 0], of_moves[0, 1], of_moves[0, 3] = c, -s, y[1:]  # a turn swings what comes after it
        of_moves[1, 0], of_moves[1, 1], of_moves[1, 3] = s, c, -x[1:]
        c, s = np.cos(pose[i, 3]), np.sin(pose[i, 3])
        of_ends[0, 0], of_ends[0, 1], of_ends[0, 3] = c, s, s * x[j] - c * y[j]
        of_ends[1, 0], of_ends[1, 1], of_ends[1, 3] = -s, c, c * x[j] + s * y[j]
        return of_moves, of_ends

    def between(shifts: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        total = np.zeros((4, shifts.shape[1] + 1))
        np.cumsum(shifts, axis=1, out=total[:, 1:])
        return np.take(total, b, axis=1) - np.take(total, a, axis=1)

    def cost(moves: np.ndarray, r: np.ndarray) -> float:
        return float(((moves - given) ** 2 / free).sum() + (r * r / slack).sum())

    pose = _walked(start[0], moves)
    r = residual(pose)
    pull = np.zeros_like(r.T)
    for _ in range(rounds):
        of_moves, of_ends = derivatives(pose)
        right = r.T + np.einsum("abk,bk->ak", of_ends, between(np.einsum("abk,kb->ak", of_moves, given - moves), i, j))
        inner, loose = of_moves[:, :, nodes[0] : nodes[-1]], free[nodes[0] : nodes[-1]]
        bends = np.add.reduceat(np.einsum("ack,bck,k->abk", inner, inner, loose[:, 0]), nodes[:-1] - nodes[0], axis=2)

        def carried(p: np.ndarray) -> np.ndarray:
            """What the stretches carry if the closures pull by p."""
            pulls = np.einsum("bak,bk->ak", of_ends, p)  # noqa: B023
            ends = np.array([np.bincount(at_j, q, len(nodes)) - np.bincount(at_i, q, len(nodes)) for q in pulls])
            return np.cumsum(ends[:, :0:-1], axis=1)[:, ::-1]

        def product(p: np.ndarray) -> np.ndarray:
            shifts = between(np.einsum("abk,bk->ak", bends, carried(p)), at_i, at_j)  # noqa: B023
            return slack.T * p + np.einsum("abk,bk->ak", of_ends, shifts)  # noqa: B023

        pull = _conjugate(product, right, pull)
        step = given - moves
        step[nodes[0] : nodes[-1]] -= loose * np.einsum("bak,bk->ka", inner, np.take(carried(pull), stretch, axis=1))
        was, share = cost(moves, r), 1.0
        while True:
            tried = _walked(start[0], moves + share * step)
            r_tried = residual(tried)
            if share < 1e-6 or cost(moves + share * step, r_tried) <= was + 1e-12 * max(was, 1e-300):
                break
            share /= 2
        moved = np.abs(tried - pose).max(initial=0)
        moves, pose, r = moves + share * step, tried, r_tried
        if moved < 1e-10:
            break
    pose = pose.copy()
    pose[:, 3] = _turned(pose[:, 3])
    return pose


def pose_graph(frames: DataFrame, keys: list[str], index: str, axes: list[str], yaw: str, radius: float, apart: int = 15, most: int | None = None) -> DataFrame:
    """Corrected poses of each sequence: edges between neighbours (weight 10) and loop closures
    (weight 1) between far frames that come within `radius`, longest first and spaced: all of them, or `most`. Closures are
    found by joins; a sequence is chosen from and solved in one task, in memory that grows with its frames."""
    kinds = dict(frames.dtypes)
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], f"{index} {kinds[index]}, x double, y double, z double, yaw double, closures int"])
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(index, *axes, yaw)) - 1
    rows = Steps(frames.sparkSession).keep(frames.select(*keys, index, *axes, yaw).withColumn("__place", place), "frames")
    closures = sequence.longest_near(rows, keys, "__place", axes, radius, apart, most)
    # a sequence is little to ship and much to solve: adaptive execution would put many into one task
    tasks = min(4 * max(rows.select(*keys).distinct().count(), 1), 2000)

    def run(key: tuple, pdf: pd.DataFrame, far: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__place", ignore_index=True)
        pose = pdf[[*axes, yaw]].to_numpy(float)
        n, used = len(pose), far.sort_values("place")[["i", "j"]].to_numpy() if len(far) else np.zeros((0, 2), int)
        if n > 1 and len(used):
            k = np.arange(n - 1)
            steps = _seen(pose, k, k + 1)
            steps[:, 3] = _turned(steps[:, 3])
            edges = np.vstack([np.column_stack([k, k + 1, steps]), np.column_stack([used, np.zeros((len(used), 4))])])
            pose = solve_pose_graph(pose, edges, np.concatenate([np.full(n - 1, 10.0), np.ones(len(used))]))
        out = pd.DataFrame({index: pdf[index], "x": pose[:, 0], "y": pose[:, 1], "z": pose[:, 2], "yaw": pose[:, 3], "closures": np.int32(len(used))})
        for k, v in zip(reversed(keys), reversed(key)):
            out.insert(0, k, v)
        return out

    dealt = [x.repartition(tasks, *keys).groupBy(*keys) for x in (rows, closures)]
    return dealt[0].cogroup(dealt[1]).applyInPandas(run, schema)


def merge_sets(sets: DataFrame, keys: list[str], index: str, members: str, share: float = 0.15) -> DataFrame:
    """(keys, index, into): each set, largest first (then by index), joins the first merged set that
    it shares at least `share` of the smaller with, which grows by it; else it starts one."""
    kinds = dict(sets.dtypes)
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], f"{index} {kinds[index]}, into {kinds[index]}"])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(((set(m), i) for m, i in zip(pdf[members], pdf[index])), key=lambda r: (-len(r[0]), r[1]))
        grown: list[set] = []
        names: list = []
        holder: dict = {}  # element -> the merged sets that hold it
        out = []
        for own, i in rows:
            shared: dict[int, int] = {}
            for e in own:
                for g in holder.get(e, ()):
                    shared[g] = shared.get(g, 0) + 1
            fits = [g for g, n in shared.items() if n / min(len(grown[g]), len(own)) >= share]
            g = min(fits) if fits else len(grown)
            if not fits:
                grown.append(set())
                names.append(i)
            for e in own - grown[g]:
                holder.setdefault(e, []).append(g)
            grown[g] |= own
            out.append((*key, i, names[g]))
        return pd.DataFrame(out, columns=[*keys, index, "into"])

    return sets.select(*keys, index, members).groupBy(*keys).applyInPandas(run, schema)


def clip_convex(subject: np.ndarray, clip: np.ndarray) -> float:
    """Area of the intersection of two convex rings, the second counter-clockwise."""
    ring = [tuple(p) for p in subject]
    for (ax, ay), (bx, by) in zip(clip, np.roll(clip, -1, axis=0)):
        side = lambda p: (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax)  # noqa: B023, E731
        out = []
        for p, q in zip(ring, ring[1:] + ring[:1]):
            sp, sq = side(p), side(q)
            if sp >= 0:
                out.append(p)
            if (sp > 0 > sq) or (sp < 0 < sq):
                f = sp / (sp - sq)
                out.append((p[0] + f * (q[0] - p[0]), p[1] + f * (q[1] - p[1])))
        ring = out
        if not ring:
            return 0.0
    x, y = np.array(ring).T
    return float(abs((x * np.roll(y, -1) - np.roll(x, -1) * y).sum()) / 2)

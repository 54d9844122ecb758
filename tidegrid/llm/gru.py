"""A small gated recurrent language model in numpy: batched, with a class-factored softmax.

In scoring, documents run in step, longest first, so that those still running are a prefix; in training they
follow each other in lanes of equal length. The state is carried from window to window; training cuts the
gradient there (truncated backpropagation through time). A word's probability is its class's times its own within the class. The last class holds
all words without a place of their own; their share within it is not part of the model.
"""

from __future__ import annotations

import numpy as np

HIDDEN, EMBED = 24, 16
WINDOW = 16
RATE = 0.2
#: Lanes that run side by side in training at most, and the steps each has at least where there are several.
LANES, LANE_STEPS = 512, 4096
#: Inputs for words without a place of their own, told apart by their last byte.
RARE_INPUTS = 32


class Gru:
    """words: places in class order; cls: class of each place; class `classes` is for all other words."""

    def __init__(self, cls: np.ndarray, log_class: np.ndarray, log_within: np.ndarray, seed: int = 1):
        r = np.random.Generator(np.random.PCG64(seed))
        n, c = len(cls), len(log_class)
        self.cls = cls
        self.first = np.searchsorted(cls, np.arange(c))  # places of class k: first[k]:first[k + 1]
        self.last = np.searchsorted(cls, np.arange(c), side="right")
        f = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        h = HIDDEN
        self.p = {
            "E": (r.standard_normal((n + RARE_INPUTS, EMBED)) * 0.3).astype(np.float32),
            "W": f(EMBED, 3 * h), "U": f(h, 3 * h), "b": np.zeros(3 * h, np.float32),
            "C": np.zeros((h, c), np.float32), "c": log_class.astype(np.float32),
            "O": np.zeros((n, h), np.float32), "o": log_within.astype(np.float32),
        }

    def step(self, gx: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        k = HIDDEN
        gh = h @ self.p["U"]
        zr = 1 / (1 + np.exp(-(gx[:, : 2 * k] + gh[:, : 2 * k])))
        z, r, u = zr[:, :k], zr[:, k:], gh[:, 2 * k :]
        n = np.tanh(gx[:, 2 * k :] + r * u)
        return n + z * (h - n), z, r, u, n

    def output(self, h: np.ndarray, target: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log-probabilities of the targets (of the last class for targets without a place), and d loss / d h."""
        p, rare = self.p, len(self.p["c"]) - 1
        cls = np.where(target >= 0, self.cls[np.maximum(target, 0)] if len(self.cls) else 0, rare)
        ex, total, out = softmax(h @ p["C"] + p["c"], cls)
        dh = None
        if grads is not None:
            d = _less_one(ex, total, cls)
            grads["C"] += h.T @ d
            grads["c"] += d.sum(0)
            dh = d @ p["C"].T
        order = np.argsort(cls.astype(np.uint8), kind="stable")
        cut = np.searchsorted(cls[order], np.arange(rare + 1))
        for k in range(rare):
            m = order[cut[k] : cut[k + 1]]
            a, b = self.first[k], self.last[k]
            if not len(m) or b - a < 2:
                continue
            w = p["O"][a:b]
            hm = h[m]
            goal = target[m] - a
            e, t, lp = softmax(hm @ w.T + p["o"][a:b], goal)
            out[m] += lp
            if grads is not None:
                d = _less_one(e, t, goal)
                grads["O"][a:b] += d.T @ hm
                grads["o"][a:b] += d.sum(0)
                dh[m] += d @ w
        return out, dh

    def windows(self, lengths: np.ndarray):
        """(rows in order of length, [(steps a..b, documents still running at each)])."""
        order = np.argsort(-lengths, kind="stable")
        size = lengths[order]
        longest = int(size[0]) if len(size) else 0
        running = np.searchsorted(-size, -np.arange(1, longest + 1), side="right")
        return order, [(a, running[a : a + WINDOW].tolist()) for a in range(0, longest, WINDOW)]

    def score(self, inputs: np.ndarray, targets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Log-probability of each document: the sum over its tokens, which lie back to back."""
        start = np.cumsum(lengths) - lengths
        order, windows = self.windows(lengths)
        at = start[order]
        table = self.p["E"] @ self.p["W"] + self.p["b"]
        h = np.zeros((len(lengths), HIDDEN), np.float32)
        total = np.zeros(len(lengths))
        for a, running in windows:
            states, places = [], []
            h = h[: running[0]]
            for k, m in enumerate(running):
                h = h[:m]
                states.append(h)
                places.append(at[:m] + a + k)
                h = self.step(table[inputs[places[-1]]], h)[0]
            lp, _ = self.output(np.concatenate(states), targets[np.concatenate(places)])
            x = 0
            for m in running:
                total[:m] += lp[x : x + m]
                x += m
        out = np.zeros(len(lengths))
        out[order] = total
        return out

    def learn(self, inputs: np.ndarray, targets: np.ndarray, lengths: np.ndarray, memory: dict, lanes: int = LANES) -> float:
        """One pass of Adagrad over the documents, window by window; returns the mean loss.

        The documents, one after another, are cut into lanes of equal length that run side by side. The state
        is empty where a document or a lane begins, and carried from window to window otherwise.
        """
        p = self.p
        total = len(inputs)
        if not total:
            return 0.0
        n = max(1, min(lanes, total // LANE_STEPS))
        size = -(-total // n)
        n = -(-total // size)
        begins = np.zeros(total, bool)
        begins[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
        lane = np.arange(n) * size
        begins[lane] = True
        k_ = HIDDEN
        h = np.zeros((n, k_), np.float32)
        loss = 0.0
        for a in range(0, size, WINDOW):
            # The last lane may be shorter than the others.
            running = [n if lane[-1] + a + k < total else n - 1 for k in range(min(WINDOW, size - a))]
            ends = np.cumsum(running).tolist()
            place = np.concatenate([lane[:m] + (a + k) for k, m in enumerate(running)])
            ids, goal, new = inputs[place], targets[place], begins[place]
            count = len(place)
            x = p["E"][ids]
            gx = x @ p["W"] + p["b"]
            before, z, r, u, c = (np.empty((count, k_), np.float32) for _ in range(5))
            for m, y in zip(running, ends, strict=True):
                at = slice(y - m, y)
                h = h[:m]
                if new[at].any():
                    h = np.where(new[at][:, None], np.float32(0), h)
                before[at] = h
                h, z[at], r[at], u[at], c[at] = self.step(gx[at], h)
            grads = {name: np.zeros_like(v) for name, v in p.items()}
            lp, dh_out = self.output(before, goal, grads)
            loss -= float(lp.sum())
            # Slopes of all steps at once; only what depends on the step after goes backwards.
            by_c = (1 - z) * (1 - c * c)
            by_z = (before - c) * z * (1 - z)
            by_r = u * r * (1 - r)
            dg, dgh = np.empty_like(gx), np.empty_like(gx)
            dh = np.zeros((running[-1], k_), np.float32)
            back = np.ascontiguousarray(p["U"].T)
            for m, y in zip(reversed(running), reversed(ends), strict=True):
                at = slice(y - m, y)
                if len(dh) < m:
                    dh = np.concatenate([dh, np.zeros((m - len(dh), k_), np.float32)])
                dc = dh * by_c[at]
                g = dgh[at]
                np.multiply(dh, by_z[at], out=g[:, :k_])
                np.multiply(dc, by_r[at], out=g[:, k_ : 2 * k_])
                np.multiply(dc, r[at], out=g[:, 2 * k_ :])
                dg[at, 2 * k_ :] = dc
                dh = dh * z[at] + g @ back + dh_out[at]
                if new[at].any():
                    dh = np.where(new[at][:, None], np.float32(0), dh)
            dg[:, : 2 * k_] = dgh[:, : 2 * k_]
            grads["U"] += before.T @ dgh
            grads["W"] += x.T @ dg
            grads["b"] += dg.sum(0)
            by = np.argsort(ids.astype(np.uint16 if len(p["E"]) < 1 << 16 else np.int64), kind="stable")
            mine = ids[by]
            cut = np.flatnonzero(np.append(True, mine[1:] != mine[:-1]))
            grads["E"][mine[cut]] = np.add.reduceat((dg @ p["W"].T)[by], cut)
            for name, g in grads.items():
                g /= count / 8  # a mean, so that steps do not follow the batch's size
                mem = memory.setdefault(name, np.full_like(g, 1e-2))
                mem += g * g
                g /= np.sqrt(mem)
                g *= RATE
                p[name] -= g
        return loss / total


def softmax(logits: np.ndarray, goal: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exponentials, their sums, and the goals' log-probabilities; works in the logits' place."""
    logits -= logits.max(1, keepdims=True)
    out = logits[np.arange(len(goal)), goal]
    np.exp(logits, out=logits)
    total = logits @ np.ones(logits.shape[1], logits.dtype)
    return logits, total, out - np.log(total)


def _less_one(ex: np.ndarray, total: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """The gradient of the loss by the logits: probabilities, less one at the goal. Works in ex's place."""
    ex /= total[:, None]
    ex[np.arange(len(goal)), goal] -= 1
    return ex

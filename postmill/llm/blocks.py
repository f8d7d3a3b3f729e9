"""Recurrent block labeller: a bidirectional LSTM in numpy over a document's leaves.

Each leaf is a sparse vector of its tag path (every element, the last, and the last two together, hashed), its words
(the shapes of all of them, hashed) and a few numbers. The LSTM reads the whole sequence in both directions, so a leaf
is labelled from document-wide context. What a path adds to the gates, the sum of a few rows of the weights, is worked
out once for all leaves that have it. A sequence of any length is read in windows of WINDOW leaves that hand on their state.

Training (``python -m postmill.llm.train_blocks``) is by Adam on the cross entropy of labels of generated texts of
known structure; the weights are a file beside this module.
"""

from __future__ import annotations

import os
import zlib
from itertools import groupby

import numpy as np

LABELS = ("text", "heading", "list_item", "code", "formula", "skip")
PATH_DIM, WORD_DIM, NUM_DIM = 384, 48, 8
DIM = PATH_DIM + WORD_DIM + NUM_DIM
HIDDEN = 24
WINDOW = 1024  # leaves of a sequence that are read at once
CELLS = 8192  # leaves of all sequences that are read at once
MODEL = os.path.join(os.path.dirname(os.path.abspath(__file__)), "models", "blocks.npz")


class _Kept(dict):
    """What a function gives, kept for a bounded number of keys."""

    def __init__(self, function, most: int = 200_000):
        super().__init__()
        self.function, self.most = function, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.function(key)
        return value


def _slot(s: str, n: int) -> int:
    return zlib.crc32(s.encode("utf-8", "replace")) % n


def _path_slots(path: tuple[str, ...]) -> dict[int, float]:
    """Places and values of a path in a leaf's vector."""
    v = {_slot(t, PATH_DIM): 1.0 for t in path}
    for s in (">".join(path[-2:]), "last " + (path[-1] if path else "")):
        k = _slot(s, PATH_DIM)
        v[k] = v.get(k, 0.0) + 1.0
    return v


def _shape(word: str) -> int:
    """The slot of a word's shape: its kinds of characters in order, repetitions left out."""
    kinds = ("9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in word)
    return _slot("".join(k for k, _ in groupby(kinds)), WORD_DIM)


_paths, _shapes = _Kept(_path_slots), _Kept(_shape)


def _numbers(leaf, words: int) -> tuple[float, ...]:
    text, lines = leaf.text, leaf.text.count("\n")
    n = len(text) or 1
    return (n / (n + 100.0), sum(map(text.count, "\\^_{}=")) / n, words / n, lines / (lines + 5.0), leaf.blank_before, leaf.blank_after, text[:1].isupper(), 1.0)


class Rows:
    """Vectors of leaves: for each the number of its path, of which there are few, and its words and numbers."""

    def __init__(self, leaves: list):
        numbers: dict[tuple[str, ...], int] = {}
        self.path = np.array([numbers.setdefault(leaf.path, len(numbers)) for leaf in leaves], np.int32)
        slots = [_paths[p] for p in numbers]
        self.at = np.array([k for v in slots for k in v], np.int32)
        self.values = np.array([x for v in slots for x in v.values()], np.float32)
        self.starts = np.cumsum([0, *map(len, slots)])[:-1]
        words = [leaf.text.split() for leaf in leaves]
        sizes = np.array(list(map(len, words)))
        shapes = np.fromiter((_shapes[w] for ws in words for w in ws), np.int64, int(sizes.sum()))
        counts = np.bincount(np.repeat(np.arange(len(leaves)), sizes) * WORD_DIM + shapes, minlength=len(leaves) * WORD_DIM).reshape(-1, WORD_DIM)
        self.rest = np.column_stack([2.0 * counts / np.maximum(sizes, 1)[:, None], np.array(list(map(_numbers, leaves, sizes.tolist())))]).astype(np.float32)

    def times(self, weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The vectors of the given numbers times a matrix."""
        # every path has some element, so no sum is empty
        paths = np.add.reduceat(weights[self.at] * self.values[:, None], self.starts, axis=0)
        return paths[self.path[rows]] + self.rest[rows] @ weights[PATH_DIM:]

    def spread(self, into: np.ndarray, rows: np.ndarray, by_leaf: np.ndarray) -> None:
        """Adds the product of the vectors' transpose with a matrix of a row per leaf."""
        paths = np.zeros((len(self.starts), by_leaf.shape[1]), np.float32)
        np.add.at(paths, self.path[rows], by_leaf)
        np.add.at(into, self.at, np.repeat(paths, np.diff(np.append(self.starts, len(self.at))), axis=0) * self.values[:, None])
        into[PATH_DIM:] += self.rest[rows].T @ by_leaf


class Batch:
    """Sequences side by side, as (step, sequence); place: the number of the leaf there, or -1."""

    def __init__(self, docs: list[list]):
        self.rows = Rows([leaf for d in docs for leaf in d])
        sizes = np.array(list(map(len, docs)))
        steps = np.arange(sizes.max())[:, None]
        self.mask = (steps < sizes).astype(np.float32)
        self.place = np.where(steps < sizes, np.cumsum(sizes) - sizes + steps, -1)

    def times(self, weights: np.ndarray, steps: slice = slice(None)) -> np.ndarray:
        """(step, sequence, columns of the weights) of some steps; zero where there is no leaf."""
        place = self.place[steps]
        out = np.zeros((*place.shape, weights.shape[1]), np.float32)
        there = place >= 0
        out[there] = self.rows.times(weights, place[there])
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


class Labeller:
    """weights: per direction wx (DIM, 4H), wh (H, 4H), b (4H), and the output wo (2H + DIM, labels), bo."""

    def __init__(self, weights: dict[str, np.ndarray], context: bool = True):
        self.w, self.context = weights, context

    @classmethod
    def trained(cls, path: str = MODEL) -> "Labeller":
        with np.load(path) as f:
            return cls({k: f[k] for k in f.files})

    @classmethod
    def fresh(cls, seed: int = 0, context: bool = True) -> "Labeller":
        """``context`` False: without the LSTM, each leaf by itself."""
        r = np.random.default_rng(seed)
        w = {}
        for d in "fb":
            w[f"wx{d}"] = (r.normal(size=(DIM, 4 * HIDDEN)) * 0.15).astype(np.float32)
            w[f"wh{d}"] = (r.normal(size=(HIDDEN, 4 * HIDDEN)) * 0.15).astype(np.float32)
            b = np.zeros(4 * HIDDEN, np.float32)
            b[HIDDEN : 2 * HIDDEN] = 1.0  # remember at first
            w[f"b{d}"] = b
        w["wo"] = (r.normal(size=(2 * HIDDEN + DIM, len(LABELS))) * 0.1).astype(np.float32)
        w["bo"] = np.zeros(len(LABELS), np.float32)
        return cls(w, context)

    def _run(self, x: Batch, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (T, B, H) of one direction; in ``keep`` what the backward pass needs."""
        steps, batch = x.mask.shape
        wx, wh, b = self.w[f"wx{d}"], self.w[f"wh{d}"], self.w[f"b{d}"]
        h, c = np.zeros((batch, HIDDEN), np.float32), np.zeros((batch, HIDDEN), np.float32)
        out = np.zeros((steps, batch, HIDDEN), np.float32)
        if keep is not None:
            keep += [None] * steps
        if not self.context:
            return out
        windows = range(0, steps, WINDOW)
        for lo in windows if d == "f" else reversed(windows):
            pre = x.times(wx, slice(lo, lo + WINDOW)) + b
            order = range(len(pre)) if d == "f" else range(len(pre) - 1, -1, -1)
            for t in order:
                z = pre[t] + h @ wh
                s = _sigmoid(z[:, : 3 * HIDDEN])
                i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
                g = np.tanh(z[:, 3 * HIDDEN :])
                m = x.mask[lo + t][:, None]
                c_new = f * c + i * g
                th = np.tanh(c_new)
                if keep is not None:
                    keep[lo + t] = (h, c, i, f, o, g, th, m)
                c = m * c_new + (1 - m) * c
                h = m * (o * th) + (1 - m) * h
                out[lo + t] = h
        return out

    def _scores(self, x: Batch, hf: np.ndarray, hb: np.ndarray) -> np.ndarray:
        wo = self.w["wo"]
        return hf @ wo[:HIDDEN] + hb @ wo[HIDDEN : 2 * HIDDEN] + x.times(wo[2 * HIDDEN :]) + self.w["bo"]

    def label(self, docs: list[list]) -> list[list[str]]:
        """Labels of the leaves of each document. Documents of like length are run together."""
        out: list[list[str]] = [[] for _ in docs]
        order = sorted((i for i in range(len(docs)) if docs[i]), key=lambda i: len(docs[i]))
        at = 0
        while at < len(order):
            n = 1
            while at + n < len(order) and n < 128 and (n + 1) * len(docs[order[at + n]]) <= CELLS:
                n += 1
            part = order[at : at + n]
            at += n
            x = Batch([docs[i] for i in part])
            best = self._scores(x, self._run(x, "f"), self._run(x, "b")).argmax(axis=2)
            for k, i in enumerate(part):
                out[i] = [LABELS[c] for c in best[: len(docs[i]), k]]
        return out

    def gradients(self, x: Batch, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss and the gradients of all weights; y: (T, B) label numbers."""
        w, g = self.w, {k: np.zeros_like(v) for k, v in self.w.items()}
        kf, kb = [], []
        hf, hb = self._run(x, "f", kf), self._run(x, "b", kb)
        s = self._scores(x, hf, hb)
        p = np.exp(s - s.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        n = max(x.mask.sum(), 1.0)
        picked = np.take_along_axis(p, y[:, :, None], axis=2)[:, :, 0]
        loss = float(-(np.log(picked + 1e-9) * x.mask).sum() / n)
        ds = p.copy()
        np.put_along_axis(ds, y[:, :, None], picked[:, :, None] - 1, axis=2)
        ds *= (x.mask / n)[:, :, None]
        there = x.place >= 0
        numbers = x.place[there]
        g["wo"][:HIDDEN], g["wo"][HIDDEN : 2 * HIDDEN] = np.einsum("tbi,tbj->ij", hf, ds), np.einsum("tbi,tbj->ij", hb, ds)
        x.rows.spread(g["wo"][2 * HIDDEN :], numbers, ds[there])
        g["bo"] = ds.sum(axis=(0, 1))
        if not self.context:
            return loss, g
        for d, kept, rows in (("f", kf, slice(0, HIDDEN)), ("b", kb, slice(HIDDEN, 2 * HIDDEN))):
            dh_all = ds @ w["wo"][rows].T
            steps, batch = x.mask.shape
            dz_all = np.zeros((steps, batch, 4 * HIDDEN), np.float32)
            dh, dc = np.zeros((batch, HIDDEN), np.float32), np.zeros((batch, HIDDEN), np.float32)
            gh = g[f"wh{d}"]
            for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
                h0, c0, i, f, o, gg, th, m = kept[t]
                dh = dh + dh_all[t]
                dh_in, dc_in = dh * m, dc * m
                do = dh_in * th
                dcn = dc_in + dh_in * o * (1 - th * th)
                dz = np.concatenate([dcn * gg * i * (1 - i), dcn * c0 * f * (1 - f), do * o * (1 - o), dcn * i * (1 - gg * gg)], axis=1)
                dz_all[t] = dz
                gh += h0.T @ dz
                dh = dz @ w[f"wh{d}"].T + dh * (1 - m)
                dc = dcn * f + dc * (1 - m)
            g[f"b{d}"] = dz_all.sum(axis=(0, 1))
            x.rows.spread(g[f"wx{d}"], numbers, dz_all[there])
        return loss, g

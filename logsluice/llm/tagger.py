"""A character-level bidirectional LSTM with a CRF on top, in numpy: training and decoding.

Windows of characters are labelled with O, or B and I of a kind. A window may start inside a span, so I is
allowed at its start; otherwise I follows B or I of the same kind only.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

CODES = 130  # ASCII, one code for all others, one for padding
OTHER, PAD = 128, 129
EMBEDDING, HIDDEN = 8, 16
_NEVER = -1e4


def encode(codes: np.ndarray) -> np.ndarray:
    return np.where(codes < 128, codes, OTHER).astype(np.int16)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Tagger:
    """``kinds`` in order; tags are 0 for O, ``1 + 2k`` for B and ``2 + 2k`` for I of kind ``k``."""

    def __init__(self, kinds: Sequence[str], seed: int = 1):
        self.kinds, self.tags = list(kinds), 1 + 2 * len(kinds)
        rng = np.random.default_rng(seed)

        def matrix(rows: int, cols: int) -> np.ndarray:
            return (rng.normal(size=(rows, cols)) / np.sqrt(rows)).astype(np.float32)

        self.p = {"embedding": matrix(CODES, EMBEDDING), "out": matrix(2 * HIDDEN, self.tags),
                  "out_bias": np.zeros(self.tags, np.float32),
                  "move": np.zeros((self.tags, self.tags), np.float32), "start": np.zeros(self.tags, np.float32)}
        for d in ("f", "b"):
            self.p[d + "_in"], self.p[d + "_loop"] = matrix(EMBEDDING, 4 * HIDDEN), matrix(HIDDEN, 4 * HIDDEN)
            self.p[d + "_bias"] = np.zeros(4 * HIDDEN, np.float32)
            self.p[d + "_bias"][HIDDEN:2 * HIDDEN] = 1
        self.forbidden = np.zeros((self.tags, self.tags), np.float32)
        for after in range(2, self.tags, 2):
            for before in range(self.tags):
                if before not in (after, after - 1):
                    self.forbidden[before, after] = _NEVER

    # --- the two LSTMs: time first, states zero on padding ---

    def _run(self, x: np.ndarray, real: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        steps = range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
        h = c = np.zeros((x.shape[1], HIDDEN), np.float32)
        out, kept = np.zeros((*x.shape[:2], HIDDEN), np.float32), []
        for t in steps:
            gates = x[t] + h @ self.p[d + "_loop"]
            i, f, o = np.split(_sigmoid(gates[:, :3 * HIDDEN]), 3, axis=1)
            g = np.tanh(gates[:, 3 * HIDDEN:])
            c_new = (f * c + i * g) * real[t]
            tanh_c = np.tanh(c_new)
            h_new = o * tanh_c * real[t]
            kept.append((t, h, c, i, f, o, g, tanh_c))
            h, c = h_new, c_new
            out[t] = h
        return out, kept

    def _run_back(self, d_out: np.ndarray, real: np.ndarray, d: str, kept: list) -> tuple[np.ndarray, np.ndarray]:
        loop = self.p[d + "_loop"]
        d_x, d_loop = np.zeros((*d_out.shape[:2], 4 * HIDDEN), np.float32), np.zeros_like(loop)
        d_h = d_c = np.zeros(d_out.shape[1:], np.float32)
        for t, h, c, i, f, o, g, tanh_c in reversed(kept):
            d_h = (d_h + d_out[t]) * real[t]
            d_c = (d_c + d_h * o * (1 - tanh_c ** 2)) * real[t]
            d_gates = np.concatenate([
                d_c * g * i * (1 - i), d_c * c * f * (1 - f), d_h * tanh_c * o * (1 - o), d_c * i * (1 - g ** 2)], axis=1)
            d_x[t], d_c = d_gates, d_c * f
            d_loop += h.T @ d_gates
            d_h = d_gates @ loop.T
        return d_x, d_loop

    def emissions(self, codes: np.ndarray) -> np.ndarray:
        """Scores ``(time, window, tag)`` of windows ``(window, time)``."""
        real = (codes.T != PAD)[:, :, None].astype(np.float32)
        both = []
        for d in ("f", "b"):
            table = self.p["embedding"] @ self.p[d + "_in"] + self.p[d + "_bias"]
            both.append(self._run(table[codes.T], real, d)[0])
        return np.concatenate(both, axis=2) @ self.p["out"] + self.p["out_bias"]

    # --- the CRF ---

    def _messages(self, e: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        move = self.p["move"] + self.forbidden
        ahead, behind = np.zeros_like(e), np.zeros_like(e)
        ahead[0] = e[0] + self.p["start"]
        for t in range(1, len(e)):
            step = _logsum(ahead[t - 1][:, :, None] + move, 1) + e[t]
            ahead[t] = np.where(real[t] > 0, step, ahead[t - 1])
        for t in range(len(e) - 2, -1, -1):
            step = _logsum(move + (e[t + 1] + behind[t + 1])[:, None, :], 2)
            behind[t] = np.where(real[t + 1] > 0, step, behind[t + 1])
        return ahead, behind, _logsum(ahead[-1], 1)

    def decode(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best tags of each window, and the posterior probability of each of them."""
        real = (codes.T != PAD)[:, :, None].astype(np.float32)
        e = self.emissions(codes)
        move = self.p["move"] + self.forbidden
        best, back = e[0] + self.p["start"], []
        for t in range(1, len(e)):
            through = best[:, :, None] + move
            came = through.argmax(axis=1)
            step = np.take_along_axis(through, came[:, None, :], 1)[:, 0] + e[t]
            back.append(np.where(real[t] > 0, came, np.arange(self.tags)))
            best = np.where(real[t] > 0, step, best)
        tags = np.zeros((len(e), e.shape[1]), np.int64)
        tags[-1] = best.argmax(axis=1)
        for t in range(len(e) - 2, -1, -1):
            tags[t] = np.take_along_axis(back[t], tags[t + 1][:, None], 1)[:, 0]
        ahead, behind, total = self._messages(e, real)
        sure = np.exp(np.take_along_axis(ahead + behind, tags[:, :, None], 2)[:, :, 0] - total)
        tags[real[:, :, 0] == 0] = 0
        return tags.T, sure.T

    def loss_and_gradients(self, codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of the windows' tags, and its gradients."""
        p, n = self.p, len(codes)
        code_t, tag_t = codes.T, tags.T
        real = (code_t != PAD)[:, :, None].astype(np.float32)
        vectors = p["embedding"][code_t]
        runs = {d: self._run(vectors @ p[d + "_in"] + p[d + "_bias"], real, d) for d in ("f", "b")}
        hidden = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        e = hidden @ p["out"] + p["out_bias"]
        ahead, behind, total = self._messages(e, real)
        gold = np.eye(self.tags, dtype=np.float32)[tag_t]
        scores = ((e * gold).sum(axis=2) * real[:, :, 0]).sum(axis=0) + p["start"][tag_t[0]]
        pair = real[1:, :, 0]
        scores += (p["move"][tag_t[:-1], tag_t[1:]] * pair).sum(axis=0)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        d_e = (np.exp(ahead + behind - total[:, None]) - gold) * real / n
        g["start"] = d_e[0].sum(axis=0)
        move = p["move"] + self.forbidden
        for t in range(1, len(e)):
            joint = ahead[t - 1][:, :, None] + move + (e[t] + behind[t])[:, None, :] - total[:, None, None]
            g["move"] += (np.exp(joint) * real[t][:, :, None]).sum(axis=0) / n
        np.add.at(g["move"], (tag_t[:-1], tag_t[1:]), -pair / n)
        g["out"] = np.einsum("tnh,tnk->hk", hidden, d_e)
        g["out_bias"] = d_e.sum(axis=(0, 1))
        d_hidden = d_e @ p["out"].T
        for d, part in (("f", d_hidden[:, :, :HIDDEN]), ("b", d_hidden[:, :, HIDDEN:])):
            d_x, g[d + "_loop"] = self._run_back(part, real, d, runs[d][1])
            g[d + "_in"] = np.einsum("tne,tng->eg", vectors, d_x)
            g[d + "_bias"] = d_x.sum(axis=(0, 1))
            np.add.at(g["embedding"], code_t, d_x @ p[d + "_in"].T)
        return float((total - scores).mean()), g

    def fit(self, codes: np.ndarray, tags: np.ndarray, steps: int, batch: int = 48, rate: float = 0.02) -> list[float]:
        """Adam over shuffled batches, the same on every run; the loss of each step."""
        rng, losses = np.random.default_rng(7), []
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            take = rng.choice(len(codes), min(batch, len(codes)), replace=False)
            loss, g = self.loss_and_gradients(codes[take], tags[take])
            norm = np.sqrt(sum(float((x ** 2).sum()) for x in g.values()))
            now = rate * min(1, 2 * (1 - step / (steps + 1)))
            for k, x in g.items():
                x = x * min(1, 5 / (norm + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * x
                second[k] = 0.999 * second[k] + 0.001 * x ** 2
                grown = first[k] / (1 - 0.9 ** step), second[k] / (1 - 0.999 ** step)
                self.p[k] = (self.p[k] - now * grown[0] / (np.sqrt(grown[1]) + 1e-8)).astype(np.float32)
            losses.append(loss)
        return losses

"""A bidirectional gated recurrent network over bytes in numpy, trained by backpropagation through time.

Arrays are (features, windows), so each gate is one contiguous block. A byte's input to
the gates is a column of a table; both directions run in one stacked product.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

WINDOW = 64
HIDDEN = 8


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= np.float32(0.5)
    np.tanh(x, out=x)
    x += np.float32(1)
    x *= np.float32(0.5)
    return x


def counted() -> np.ndarray:
    """Bytes of letters: their positions are pooled."""
    out = np.zeros(256, bool)
    out[0x80:] = True
    out[ord("A") : ord("Z") + 1] = out[ord("a") : ord("z") + 1] = True
    return out


COUNTED = counted()


@dataclass
class Network:
    inputs: np.ndarray  # (2, 3H, 256): update, reset and candidate gates for each direction
    inner: np.ndarray  # (2, 3H, H)
    outer: np.ndarray  # (K, 2H)
    bias: np.ndarray  # (K, 1)

    @staticmethod
    def random(classes: int, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        h = HIDDEN
        return Network(
            rng.normal(0, 0.3, (2, 3 * h, 256)).astype(np.float32),
            rng.normal(0, 0.3, (2, 3 * h, h)).astype(np.float32),
            rng.normal(0, 0.3, (classes, 2 * h)).astype(np.float32),
            np.zeros((classes, 1), np.float32),
        )

    def parameters(self) -> list[np.ndarray]:
        return [self.inputs, self.inner, self.outer, self.bias]

    def states(self, x: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """States (WINDOW, H, B) of both directions for bytes ``x`` (WINDOW, B); ``keep`` gets what training needs."""
        steps, width = x.shape
        h = HIDDEN
        out = np.empty((2, steps, h, width), np.float32)
        state = np.zeros((2, h, width), np.float32)
        gates = np.empty((2, 3 * h, width), np.float32)
        product = np.empty_like(gates)
        for t in range(steps):
            for d, at in ((0, t), (1, steps - 1 - t)):
                np.take(self.inputs[d], x[at], axis=1, out=gates[d], mode="clip")
            np.matmul(self.inner, state, out=product)
            both, candidate = gates[:, : 2 * h], gates[:, 2 * h :]
            both += product[:, : 2 * h]
            _sigmoid(both)
            if keep is not None:
                keep.append((state.copy(), product[:, 2 * h :].copy(), both.copy()))
            product[:, 2 * h :] *= gates[:, h : 2 * h]
            candidate += product[:, 2 * h :]
            np.tanh(candidate, out=candidate)
            if keep is not None:
                keep[-1] += (candidate.copy(),)
            state -= candidate
            state *= gates[:, :h]
            state += candidate
            out[0, t], out[1, steps - 1 - t] = state[0], state[1]
        return out[0], out[1]

    def position_probabilities(self, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
        """(K, B) class probabilities of one position."""
        h = HIDDEN
        logits = self.outer[:, :h] @ forward + self.outer[:, h:] @ backward + self.bias
        logits -= logits.max(axis=0)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=0)
        return logits

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums (K, B) of the probabilities over the letter positions of each window, and the number of these."""
        forward, backward = self.states(x)
        sums = np.zeros((len(self.bias), x.shape[1]), np.float64)
        letters = COUNTED[x]
        for t in range(len(x)):
            sums += self.position_probabilities(forward[t], backward[t]) * letters[t]
        return sums, letters.sum(axis=0)

    def gradients(self, x: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over the letter positions and its gradients."""
        steps, width = x.shape
        h, kept = HIDDEN, []
        hidden = self.states(x, kept)
        letters = COUNTED[x]
        total = max(1, int(letters.sum()))
        loss = 0.0
        d_outer, d_bias = np.zeros_like(self.outer), np.zeros_like(self.bias)
        d_hidden = np.empty((2, steps, h, width), np.float32)
        columns = np.arange(width)
        for t in range(steps):
            p = self.position_probabilities(hidden[0][t], hidden[1][t])
            loss -= float((np.log(p[labels, columns] + 1e-9) * letters[t]).sum())
            p[labels, columns] -= 1
            p *= letters[t] / np.float32(total)
            d_outer += p @ np.concatenate([hidden[0][t], hidden[1][t]]).T
            d_bias += p.sum(axis=1, keepdims=True)
            d_hidden[0, t], d_hidden[1, t] = self.outer[:, :h].T @ p, self.outer[:, h:].T @ p
        d_inner = np.zeros_like(self.inner)
        d_gates = np.empty((2, 3 * h, steps, width), np.float32)
        back = np.zeros((2, h, width), np.float32)
        for t in reversed(range(steps)):
            before, product, gates, candidate = kept[t]
            update, reset = gates[:, :h], gates[:, h:]
            back[0] += d_hidden[0, t]
            back[1] += d_hidden[1, steps - 1 - t]
            d_candidate = back * (1 - update) * (1 - candidate * candidate)
            d_update = back * (before - candidate) * update * (1 - update)
            d_reset = d_candidate * product * reset * (1 - reset)
            through = np.concatenate([d_update, d_reset, d_candidate * reset], axis=1)
            d_inner += through @ before.transpose(0, 2, 1)
            back = back * update + self.inner.transpose(0, 2, 1) @ through
            gate = np.concatenate([d_update, d_reset, d_candidate], axis=1)
            d_gates[0, :, t], d_gates[1, :, steps - 1 - t] = gate[0], gate[1]
        flat = x.ravel()
        d_inputs = np.stack([[np.bincount(flat, g.ravel(), 256) for g in direction] for direction in d_gates]).astype(np.float32)
        return loss / total, [d_inputs, d_inner, d_outer, d_bias]


def train(windows: np.ndarray, labels: np.ndarray, classes: int, steps: int = 400, batch: int = 256, rate: float = 0.02) -> Network:
    """Adam over balanced batches of ``windows`` (n, WINDOW) with ``labels``; the same rows give the same network."""
    net = Network.random(classes)
    rng = np.random.default_rng(11)
    first = [np.zeros_like(p) for p in net.parameters()]
    second = [np.zeros_like(p) for p in net.parameters()]
    members = [np.flatnonzero(labels == k) for k in range(classes)]
    for step in range(1, steps + 1):
        drawn = rng.integers(0, classes, batch)
        rows = np.array([members[k][rng.integers(0, len(members[k]))] for k in drawn])
        _, grads = net.gradients(np.ascontiguousarray(windows[rows].T), labels[rows])
        size = np.sqrt(sum(float((g * g).sum()) for g in grads))
        pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for p, g, m, v in zip(net.parameters(), grads, first, second, strict=True):
            g = g / np.float32(max(1.0, size))
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= (pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net

"""A bidirectional gated recurrent network over bytes, in numpy.

Every byte of a segment gets a distribution over the labels from the states of both directions. The
bends are x / (1 + |x|), which takes a fraction of the time of tanh. Arrays have the batch as their
last axis, so that all gates of one step are single runs of memory.
"""

from __future__ import annotations

import numpy as np

PAD = 256
_LEARNED = ("embed", "inner", "bias", "out", "out_bias")


def _bend(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def initial(labels: int, width: int, seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    return {
        # Per direction: gates z, r and the candidate, one under the other.
        "embed": rng.normal(0, 0.5, (2, 3 * width, PAD + 1)).astype(np.float32),
        "inner": rng.normal(0, width ** -0.5, (2, 3 * width, width)).astype(np.float32),
        "bias": np.zeros((2, width, 1), np.float32),
        "out": rng.normal(0, (2 * width) ** -0.5, (labels, 2 * width)).astype(np.float32),
        "out_bias": np.zeros((labels, 1), np.float32),
    }


def _run(model: dict, way: int, bytes_: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """States of one direction, (time, width, batch); for learning, also what each step used."""
    embed, inner, bias = model["embed"][way], model["inner"][way], model["bias"][way]
    width, (time, batch) = inner.shape[1], bytes_.shape
    states, trace = np.empty((time, width, batch), np.float32), []
    state = np.zeros((width, batch), np.float32)
    given, own, scale = (np.empty((3 * width, batch), np.float32) for _ in range(3))
    for t in range(time) if way == 0 else range(time - 1, -1, -1):
        np.take(embed, bytes_[t], axis=1, out=given, mode="clip")
        np.matmul(inner, state, out=own)
        gates, bends = given[:2 * width], scale[:2 * width]
        gates += own[:2 * width]
        raw_gates = gates.copy() if keep else None
        np.abs(gates, out=bends)
        bends += 1
        gates /= bends
        gates *= 0.5
        gates += 0.5
        z, r, new, bends = given[:width], given[width:2 * width], given[2 * width:], scale[2 * width:]
        lent = own[2 * width:]
        lent += bias
        raw_lent = lent.copy() if keep else None
        lent *= r
        new += lent
        raw_new = new.copy() if keep else None
        np.abs(new, out=bends)
        bends += 1
        new /= bends
        if keep:
            trace.append((t, state, z.copy(), r.copy(), new.copy(), raw_gates, raw_lent, raw_new))
        # state = new + z (state - new)
        step = states[t]
        np.subtract(state, new, out=step)
        step *= z
        step += new
        state = step
    return states, trace


def label_positions(model: dict, bytes_: np.ndarray) -> np.ndarray:
    """Probabilities (time, labels, batch) for bytes (time, batch); PAD is past the end."""
    states = np.concatenate([_run(model, way, bytes_, False)[0] for way in (0, 1)], axis=1)
    scores = np.matmul(model["out"], states)
    scores += model["out_bias"]
    scores -= scores.max(axis=1, keepdims=True)
    np.exp(scores, out=scores)
    scores /= scores.sum(axis=1, keepdims=True)
    return scores


def gradients(model: dict, bytes_: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss over all positions that hold a byte, and its slope, by going back through time."""
    runs = [_run(model, way, bytes_, True) for way in (0, 1)]
    states = np.concatenate([r[0] for r in runs], axis=1)
    scores = np.matmul(model["out"], states) + model["out_bias"]
    scores -= scores.max(axis=1, keepdims=True)
    chances = np.exp(scores)
    chances /= chances.sum(axis=1, keepdims=True)
    real = (bytes_ != PAD).astype(np.float32)
    n, each = max(1.0, float(real.sum())), np.arange(bytes_.shape[1])
    loss = -float((np.log(chances[:, labels, each] + 1e-9) * real).sum()) / n

    back = chances
    back[:, labels, each] -= 1
    back *= real[:, None, :] / n
    slope = {name: np.zeros_like(model[name]) for name in _LEARNED}
    slope["out"] = np.einsum("tlb,tsb->ls", back, states, optimize=True)
    slope["out_bias"] = back.sum(axis=(0, 2))[:, None]
    into = np.matmul(model["out"].T, back)
    width = model["inner"].shape[2]
    for way in (0, 1):
        inner, carry = model["inner"][way], np.zeros((width, bytes_.shape[1]), np.float32)
        steps = np.empty((bytes_.shape[0], 3 * width, bytes_.shape[1]), np.float32)
        for t, before, z, r, new, raw_gates, raw_lent, raw_new in reversed(runs[way][1]):
            d_state = into[t, way * width:(way + 1) * width] + carry
            d_new = d_state * (1 - z) / (1 + np.abs(raw_new)) ** 2
            d_gates = np.concatenate([d_state * (before - new), d_new * raw_lent]) * 0.5 / (1 + np.abs(raw_gates)) ** 2
            d_own = np.concatenate([d_gates, d_new * r])
            slope["inner"][way] += d_own @ before.T
            slope["bias"][way] += d_own[2 * width:].sum(axis=1, keepdims=True)
            carry = d_state * z + inner.T @ d_own
            steps[t, :2 * width], steps[t, 2 * width:] = d_gates, d_new
        flat = steps.transpose(1, 0, 2).reshape(3 * width, -1)
        at = bytes_.ravel()
        slope["embed"][way] = np.stack([np.bincount(at, row, PAD + 1) for row in flat])
    return loss, slope


def train(segments: np.ndarray, labels: np.ndarray, n_labels: int, width: int = 8, steps: int = 300,
          batch: int = 256, rate: float = 0.02, seed: int = 5) -> dict[str, np.ndarray]:
    """Learn from segments (rows, time) with one label each, by Adam on random batches."""
    model, rng = initial(n_labels, width, seed), np.random.default_rng(seed + 1)
    mean = {n: np.zeros_like(model[n]) for n in _LEARNED}
    square = {n: np.zeros_like(model[n]) for n in _LEARNED}
    for step in range(1, steps + 1):
        rows = rng.integers(0, len(labels), batch)
        _, slope = gradients(model, np.ascontiguousarray(segments[rows].T), labels[rows])
        size = np.sqrt(sum(float((g * g).sum()) for g in slope.values()))
        now = rate * min(1.0, 2 * (1 - (step - 1) / steps)) * min(1.0, 1.0 / max(size, 1e-9))
        for name in _LEARNED:
            g = slope[name]
            mean[name] += 0.1 * (g - mean[name])
            square[name] += 0.01 * (g * g - square[name])
            model[name] -= (now * (mean[name] / (1 - 0.9 ** step))
                            / (np.sqrt(square[name] / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)
    return model

"""A linear-chain conditional random field in numpy: training by gradient ascent, decoding by Viterbi in batches."""

from __future__ import annotations

import numpy as np

FORBIDDEN = -1e6


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


class Crf:
    """Label 0 is outside. ``features`` maps a feature's name to its row of weights; unknown names weigh nothing."""

    def __init__(self, labels: list[str], features: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.labels, self.features, self.weights, self.moves = labels, features, weights, moves

    def emissions(self, names: list[list[str]], free: np.ndarray) -> np.ndarray:
        """Scores by token and label; a token that isn't ``free`` can only be outside."""
        rows = [[self.features[n] for n in own if n in self.features] for own in names]
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.fromiter((x for r in rows for x in r), np.int64, int(sizes.sum()))
        out = np.zeros((len(rows), len(self.labels)))
        np.add.at(out, np.repeat(np.arange(len(rows)), sizes), self.weights[flat])
        out[~free, 1:] = FORBIDDEN
        return out

    def viterbi(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best labels of sequences laid end to end; each stands between outside tokens."""
        begins = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        labels = np.zeros(len(scores), np.int64)
        order = np.argsort(-lengths, kind="stable")
        begins, lengths = begins[order], lengths[order]
        if not len(lengths):
            return labels
        best = self.moves[0] + scores[begins]
        back = []
        for step in range(1, int(lengths[0])):
            live = int(np.searchsorted(-lengths, -step, "left"))
            paths = best[:live, :, None] + self.moves
            back.append(paths.argmax(1))
            best[:live] = paths.max(1) + scores[begins[:live] + step]
        now = (best + self.moves[:, 0]).argmax(1)
        labels[begins + lengths - 1] = now
        for step in range(int(lengths[0]) - 1, 0, -1):
            live = len(back[step - 1])
            now[:live] = back[step - 1][np.arange(live), now[:live]]
            labels[begins[:live] + step - 1] = now[:live]
        return labels


def train(labels: list[str], sentences: list[tuple[list[list[str]], list[bool], list[str]]], steps: int = 60, rate: float = 0.3, l2: float = 1e-3) -> Crf:
    """Fits a field to (feature names by token, free by token, labels by token). Deterministic."""
    features: dict[str, int] = {}
    for names, _, _ in sentences:
        for own in names:
            for n in own:
                features.setdefault(n, len(features))
    k, n = len(labels), len(sentences)
    longest, widest = max(len(s[0]) for s in sentences), max(len(own) for s in sentences for own in s[0])
    ids = np.full((n, longest, widest), len(features))
    gold, mask, closed = np.zeros((n, longest), int), np.zeros((n, longest), bool), np.zeros((n, longest), bool)
    place = {x: i for i, x in enumerate(labels)}
    for i, (names, free, tags) in enumerate(sentences):
        for j, own in enumerate(names):
            ids[i, j, : len(own)] = [features[x] for x in own]
            gold[i, j], mask[i, j], closed[i, j] = place[tags[j]], True, not free[j]
    closed |= ~mask  # padding is outside
    weights, moves = np.zeros((len(features) + 1, k)), np.zeros((k, k))
    for a, x in enumerate(labels):
        for b, y in enumerate(labels):
            if y.startswith("I-") and x[2:] != y[2:]:
                moves[a, b] = FORBIDDEN
    allowed = moves == 0
    one_hot = np.eye(k)[gold]
    want_moves = np.zeros((k, k))
    np.add.at(want_moves, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
    state = [np.zeros_like(x) for x in (weights, moves, weights, moves)]
    flat = ids.reshape(-1)
    for step in range(1, steps + 1):
        score = weights[ids].sum(2)
        score[closed, 1:] = FORBIDDEN
        ahead, behind = np.empty_like(score), np.zeros_like(score)
        ahead[:, 0] = score[:, 0] + moves[0]
        for j in range(1, longest):
            ahead[:, j] = _lse(ahead[:, j - 1][:, :, None] + moves, 1) + score[:, j]
        for j in range(longest - 2, -1, -1):
            behind[:, j] = _lse(moves + (score[:, j + 1] + behind[:, j + 1])[:, None, :], 2)
        total = _lse(ahead[:, -1], 1)
        share = np.exp(ahead + behind - total[:, None, None])
        paired = np.zeros((k, k))
        for j in range(1, longest):
            paired += np.exp(ahead[:, j - 1][:, :, None] + moves + (score[:, j] + behind[:, j])[:, None, :] - total[:, None, None]).sum(0)
        gap = (one_hot - share).reshape(-1, k)
        slope = np.zeros_like(weights)
        for label in range(k):
            slope[:, label] = np.bincount(flat, np.repeat(gap[:, label], widest), len(weights))
        slopes = [slope / n - l2 * weights, np.where(allowed, (want_moves - paired) / n - l2 * moves, 0)]
        slopes[0][-1] = 0
        for i, (x, g) in enumerate(zip((weights, moves), slopes, strict=True)):
            state[i] = 0.9 * state[i] + 0.1 * g
            state[i + 2] = 0.99 * state[i + 2] + 0.01 * g * g
            x += rate * (state[i] / (1 - 0.9**step)) / (np.sqrt(state[i + 2] / (1 - 0.99**step)) + 1e-8)
    return Crf(labels, features, weights, moves)

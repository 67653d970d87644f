"""A segmentation network for inference, in numpy: encoder stages with skips, a bottleneck, decoder stages, a head.

Its layers are a table, from which the parameter count, the initial weights and the forward pass all follow. Use
:func:`forward` with ``patches.predicted`` for batches of tensors; training belongs elsewhere.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

EPS = 1e-5


@dataclass(frozen=True)
class Shape:
    in_channels: int = 52
    classes: int = 8
    stages: tuple[int, ...] = (64, 128, 256, 512)

    def __post_init__(self):
        if self.in_channels < 1 or self.classes < 2 or not self.stages or min(self.stages) < 1:
            raise ValueError(f"a network can't have the shape {self}")

    @property
    def divisor(self) -> int:
        """Heights and widths must be multiples of this."""
        return 2 ** len(self.stages)


def layers(shape: Shape) -> list[tuple[str, str, int, int]]:
    """(name, kind, inputs, outputs): pair (two 3 x 3 convolutions, normed), up (2 x 2 transposed), head (1 x 1)."""
    widths = [shape.in_channels, *shape.stages, 2 * shape.stages[-1]]
    down = [(f"down{k}", "pair", a, b) for k, (a, b) in enumerate(zip(widths[:-1], widths[1:], strict=True))]
    up = []
    for k in range(len(shape.stages) - 1, -1, -1):
        wide, narrow = widths[k + 2], shape.stages[k]
        up += [(f"up{k}", "up", wide, narrow), (f"join{k}", "pair", 2 * narrow, narrow)]
    return [*down, *up, ("head", "head", shape.stages[0], shape.classes)]


def size_of(kind: str, a: int, b: int) -> int:
    """Trainable numbers of a layer."""
    return {"pair": 9 * a * b + 9 * b * b + 4 * b, "up": 4 * a * b + b, "head": a * b + b}[kind]


def parameters(shape: Shape) -> int:
    return sum(size_of(kind, a, b) for _, kind, a, b in layers(shape))


def initial(shape: Shape, seed: int = 0) -> dict[str, list[np.ndarray]]:
    """Random weights by layer; norms are (gain, bias, mean, variance)."""
    r = np.random.default_rng(seed)
    norm = lambda n: [np.ones(n), np.zeros(n), np.zeros(n), np.ones(n)]
    draw = lambda *d: (r.normal(size=d) / np.sqrt(np.prod(d[1:]))).astype(np.float32)
    out = {}
    for name, kind, a, b in layers(shape):
        if kind == "pair":
            out[name] = [draw(b, a, 3, 3), *norm(b), draw(b, b, 3, 3), *norm(b)]
        else:
            out[name] = [draw(b, a, 2, 2) if kind == "up" else draw(b, a), np.zeros(b, np.float32)]
    return out


def _conv3(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    padded = np.pad(x, ((0, 0), (0, 0), (1, 1), (1, 1)))
    return np.einsum("nchwij,ocij->nohw", sliding_window_view(padded, (3, 3), (2, 3)), w, optimize=True)


def _pair(x: np.ndarray, w: list[np.ndarray]) -> np.ndarray:
    for kernel, gain, bias, mean, variance in (w[:5], w[5:]):
        scale = gain / np.sqrt(variance + EPS)
        x = np.maximum(_conv3(x, kernel) * scale[:, None, None] + (bias - mean * scale)[:, None, None], 0)
    return x


def _up(x: np.ndarray, w: np.ndarray, bias: np.ndarray) -> np.ndarray:
    n, _, h, v = x.shape
    spread = np.einsum("nchw,ocij->nohiwj", x, w, optimize=True)
    return spread.reshape(n, len(w), 2 * h, 2 * v) + bias[:, None, None]


def forward(x: np.ndarray, weights: dict[str, list[np.ndarray]], shape: Shape) -> np.ndarray:
    """Scores [n, classes, h, w] of features [n, channels, h, w]."""
    if x.ndim != 4 or x.shape[1] != shape.in_channels or x.shape[2] % shape.divisor or x.shape[3] % shape.divisor:
        raise ValueError(f"features of shape {x.shape} don't fit {shape}, whose sides are multiples of {shape.divisor}")
    skips = []
    for k in range(len(shape.stages)):
        skips.append(_pair(x, weights[f"down{k}"]))
        n, c, h, w = skips[-1].shape
        x = skips[-1].reshape(n, c, h // 2, 2, w // 2, 2).max((3, 5))
    x = _pair(x, weights[f"down{len(shape.stages)}"])
    for k in range(len(shape.stages) - 1, -1, -1):
        x = _pair(np.concatenate((skips[k], _up(x, *weights[f"up{k}"])), 1), weights[f"join{k}"])
    kernel, bias = weights["head"]
    return np.einsum("nchw,oc->nohw", x, kernel, optimize=True) + bias[:, None, None]


def classes(x: np.ndarray, weights: dict[str, list[np.ndarray]], shape: Shape) -> np.ndarray:
    """The class of every pixel."""
    return forward(x, weights, shape).argmax(1)

"""Secrets: fixed patterns, and random strings found by character Markov models.

Two order-two character models, one of random strings and one of ordinary identifiers and words, are trained from
:func:`labelled` samples. A candidate, a run of 20 or more characters from ``[A-Za-z0-9+/_=.-]`` with a digit or with
letters of both cases, is a secret when the log-likelihood ratio per character exceeds a threshold set on held-out
samples. Of a candidate that is none as a whole, the stretches between separators (any of ``+/_=.-``) are judged as if each
stood alone, so a random string joined to ordinary text is found; of overlapping ones, the one with the highest sum over the
threshold counts. Candidates are found and scored for whole blocks of texts in numpy. Spans of the models are added where they
overlap no span of the patterns, which stay as they are.

Null texts count as empty and have no spans. Every text is searched whole, however long. Repeated rows give equal rows,
whatever rows stand beside them; an empty table gives an empty one. Other columns pass through, except one named like the
output, which it replaces.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.llm import kernel, spans

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "random")
SHORTEST = 20
_ASSIGN = re.compile(r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*+[:=]\x20*+[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}+")
_HINTS = ("password", "passwd", "secret", "token", "api")


def patterns(text: str) -> list[spans.Found]:
    """The spans of the fixed patterns, leftmost and non-overlapping per kind."""
    out: list[spans.Found] = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        out += [("assign", *m.span(), True) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span(), True) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [("hex", *m.span(), True) for m in _HEX.finditer(text)]
    return out


# --- the models

_CODE = np.zeros(256, np.int64)  # 0: outside the alphabet
for _k, _c in enumerate(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-"):
    _CODE[_c] = _k + 1
_SIZE = int(_CODE.max()) + 1


class Markov:
    """log p(c | the two characters before), interpolated with lower orders; 0 stands for the start."""

    def __init__(self, samples: list[str]):
        pairs, single = np.full((_SIZE, _SIZE), 0.05), np.full(_SIZE, 0.5)
        triples = np.zeros((_SIZE, _SIZE, _SIZE))
        for s in samples:
            c = np.concatenate(([0, 0], _CODE[np.frombuffer(s.encode(), np.uint8)]))
            np.add.at(single, c[2:], 1)
            np.add.at(pairs, (c[1:-1], c[2:]), 1)
            np.add.at(triples, (c[:-2], c[1:-1], c[2:]), 1)
        p1 = single / single.sum()
        p2 = (pairs + 8 * p1) / (pairs.sum(1, keepdims=True) + 8)
        p3 = (triples + 8 * p2[None]) / (triples.sum(2, keepdims=True) + 8)
        self.log = np.log(p3)


def labelled(n: int = 1500, seed: int = 5) -> list[tuple[str, bool]]:
    """Labelled samples: (string, whether it is random)."""
    r = random.Random(seed)
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    alphabets = [digits + "abcdef", digits + "ABCDEF", upper + digits, lower + digits, upper + lower + digits, upper + lower + digits + "+/", upper + lower + digits + "-_"]
    parts = ("get set user name value index count list item node data file path read write open close time date page text word line block cache table column row key map "
             "order total price first last next prev max min request response handler service client server http config option test main util common base abstract factory "
             "tion ing er the and ment que eau les der ung heit lich schen ci on es ar do mente keit ver ein th st re ti or an ou le en sh ble").split()  # fmt: skip

    def ordinary() -> str:
        words = [r.choice(parts) for _ in range(r.randint(3, 8))]
        style = r.random()
        if style < 0.25:
            return "".join(words)
        if style < 0.45:
            return "".join(w.capitalize() for w in words)
        if style < 0.6:
            return r.choice("_-./").join(words)
        if style < 0.7:
            return "_".join(words).upper() + r.choice(("", "_1", "2"))
        if style < 0.8:
            return "/".join(words) + r.choice((".py", ".html", ".java", ""))
        if style < 0.9:
            return words[0] + "".join(w.capitalize() for w in words[1:]) + r.choice(("", "2", "V3", "64"))
        return "-".join((str(r.randint(1990, 2030)), f"{r.randint(1, 12):02d}", f"{r.randint(1, 28):02d}")) + r.choice(("", "T")) + "-".join(words[:2])

    random_string = lambda: "".join(r.choice(a) for a in [r.choice(alphabets)] for _ in range(r.choice((20, 24, 32, 40, 43, 64))))
    return [(random_string(), True) if k % 2 else (ordinary(), False) for k in range(n)]


class Ratio:
    """The two models and the threshold on the log-likelihood ratio per character."""

    def __init__(self, samples: list[tuple[str, bool]], held: int = 5):
        learn = [s for k, s in enumerate(samples) if k % held]
        self.table = Markov([s for s, yes in learn if yes]).log - Markov([s for s, yes in learn if not yes]).log
        score = lambda s: float(self.scores(np.frombuffer(s.encode(), np.uint8), np.array([0]), np.array([len(s)]))[0])
        no = sorted(score(s) for k, (s, yes) in enumerate(samples) if not k % held and not yes)
        yes = sorted(score(s) for k, (s, yes) in enumerate(samples) if not k % held and yes)
        # between the classes, nearer to the random ones: ordinary strings should stay
        self.threshold = max(no[-1] + 0.1, 0.5 * yes[len(yes) // 50] + 0.5 * no[len(no) * 98 // 100], 0.6)

    def scores(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log-likelihood ratio per character of byte spans."""
        sizes = ends - starts
        at = np.concatenate(([0], np.cumsum(sizes)))
        where = np.repeat(starts - at[:-1], sizes) + np.arange(at[-1])
        code, place = _CODE[data[where]], np.arange(at[-1]) - np.repeat(at[:-1], sizes)
        one, two = np.zeros_like(code), np.zeros_like(code)
        one[1:], two[2:] = code[:-1], code[:-2]
        one[place < 1] = 0
        two[place < 2] = 0
        return kernel.row_sums(self.table[two, one, code], at) / np.maximum(sizes, 1)


@lru_cache(maxsize=1)
def default_ratio() -> Ratio:
    return Ratio(labelled())


_IN, _DIGIT, _LOWER, _UPPER = (np.zeros(256, bool) for _ in range(4))
_IN[_CODE > 0] = True
_DIGIT[48:58], _LOWER[97:123], _UPPER[65:91] = True, True, True


_SPLIT = np.zeros(256, bool)
_SPLIT[list(b"+/_=.-")] = True


def stretches(ratio: Ratio, run: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of disjoint stretches of one run that are secrets alone: they start and end at separators or the run's ends.

    A stretch has at least SHORTEST characters, a digit and a letter or letters of both cases, and a ratio per character
    above the threshold. The best is taken, then the best of what is left on both sides of it.
    """
    n = len(run)
    split = np.concatenate(([True], _SPLIT[run], [True]))  # at k + 1: character k
    if not split[1:-1].any():
        return []
    first, last = np.flatnonzero(split[:-1] & ~split[1:]), np.flatnonzero(~split[:-1] & split[1:])
    code = _CODE[run]
    one, two = np.concatenate(([0], code[:-1])), np.concatenate(([0, 0], code[:-2]))
    total = np.concatenate(([0.0], np.cumsum(ratio.table[two, one, code] - ratio.threshold)))
    # what a stretch from here has more than within the run: its first two characters have less before them
    follow = np.minimum(first + 1, n - 1)
    fresh = ratio.table[0, 0, code[first]] - ratio.table[two[first], one[first], code[first]]
    fresh += np.where(first + 1 < n, ratio.table[0, code[first], code[follow]] - ratio.table[two[follow], code[first], code[follow]], 0)
    before = total[first] - fresh
    at = np.arange(n)
    seen = np.sort([np.maximum.accumulate(np.where(t[run], at, -1)) for t in (_DIGIT, _LOWER, _UPPER)], axis=0)[1]
    # a stretch that ends at last[k] starts at first[latest[k]] at the latest
    latest = np.searchsorted(first, np.minimum(seen[last - 1], last - SHORTEST), "right") - 1
    out, todo = [], [(0, len(first))]
    while todo:
        a, b = todo.pop()
        allowed = latest[a:b] >= a
        if not allowed.any():
            continue
        low = np.minimum.accumulate(before[a:b])
        gain = np.where(allowed, total[last[a:b]] - low[np.maximum(latest[a:b] - a, 0)], 0)
        k = int(gain.argmax())
        if gain[k] > 0:
            j = a + int(before[a : latest[a + k] + 1].argmin())
            out.append((int(first[j]), int(last[a + k])))
            todo += [(a, j), (a + k + 1, b)]
    return sorted(out)


def modelled(ratio: Ratio, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(row, start, end) of strings more likely random than ordinary, as byte ranges within the row."""
    if not len(data):
        return
    inside = _IN[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edges], ends[edges - 1] = inside[edges], inside[edges - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    long = stops - starts >= SHORTEST
    starts, stops = starts[long], stops[long]
    if not len(starts):
        return
    more = np.append(data, np.uint8(0))  # reduceat takes no index past the end
    seen = [np.logical_or.reduceat(t[more], np.stack((starts, stops), 1).ravel())[::2] for t in (_DIGIT, _LOWER, _UPPER)]
    mixed = (seen[0] & (seen[1] | seen[2])) | (seen[1] & seen[2])
    starts, stops = starts[mixed], stops[mixed]
    if not len(starts):
        return
    secret = ratio.scores(data, starts, stops) > ratio.threshold
    rows = np.searchsorted(offsets, starts, "right") - 1
    for row, a, b, whole in zip(rows.tolist(), starts.tolist(), stops.tolist(), secret.tolist(), strict=True):
        for x, y in [(0, b - a)] if whole else stretches(ratio, data[a:b]):
            yield row, a + x - int(offsets[row]), a + y - int(offsets[row])


def finder(ratio: Ratio):
    """For :func:`spans.with_spans`: the pattern spans, and the models' that overlap none of them."""

    def find(batch: pa.RecordBatch, name: str) -> list[list[spans.Found]]:
        out: list[list[spans.Found]] = []
        for a, b, offsets, data in kernel.slices(batch, name):
            raw = data.tobytes()
            bodies = [raw[x:y] for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            rows = [patterns(body.decode("utf-8", "replace")) for body in bodies]
            fixed = [[s[1:3] for s in row] for row in rows]
            for row, start, end in modelled(ratio, data, offsets):
                start, end = (len(bodies[row][:x].decode("utf-8", "replace")) for x in (start, end))
                if all(end <= x or y <= start for x, y in fixed[row]):
                    rows[row].append(("random", start, end, False))
            out += rows
        return out

    return find


def detect(docs: DataFrame, text: str = "text", ratio: Ratio | None = None, carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all by default) with ``spans``: kind, start, end, and whether a fixed pattern found it."""
    return spans.with_spans(docs, finder(ratio or default_ratio()), KINDS, text, carry=carry)


def digest(found: DataFrame) -> DataFrame:
    """The counts of base spans, the hash of their list, and the list of all spans."""
    own = spans.base(F.col("spans"))
    return found.select("doc_id", *[spans.count(own, k).alias(f"n_{k}") for k in BASE_KINDS], F.sha2(spans.written(own), 256).alias("base_sha256"), spans.written(F.col("spans")).alias("spans"))

"""Personal data: fixed patterns, and a conditional random field that finds what they miss.

The field labels words (runs other than space and 0x09-0x0D; one of more than LONGEST bytes, as in unspaced tables, markup
or scripts without spaces, is cut at what numbers and addresses don't hold) from features of their shapes and their
neighbours'. It is
trained from :func:`labelled`, a small table made here. A word without digit and without @ is always outside, so a text
decomposes exactly into runs of other words, and Viterbi decodes the runs of many texts at once in numpy. Its spans
are added where they overlap no span of the patterns; those stay as they are.

Null texts count as empty and have no spans. Every text is searched whole; all patterns run in time near linear in its
length. Repeated rows give equal rows; an empty table gives an empty one; other columns pass through, except one named like the output, which it replaces.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.llm import kernel, spans
from pixelmill.llm.crf import Crf, train

KINDS = ("email", "ip", "card", "phone")
#: Characters of a word that has a shape; longer ones are cut up.
LONGEST = 64
LABELS = ["O", *[f"{p}-{k}" for k in KINDS for p in "BI"]]
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile("[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) << (k & 1)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Around each @: as far to the left as the last match allows, then a domain."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def patterns(text: str) -> list[spans.Found]:
    """The spans of the fixed patterns, leftmost and non-overlapping per kind."""
    out: list[spans.Found] = [("email", a, b, True) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span(), True))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span(), True))
    at = text.find("+")
    while at >= 0:
        m = _PHONE.match(text, at)
        if m and 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            out.append(("phone", *m.span(), True))
        at = text.find("+", m.end() if m else at + 1)
    return out


# --- the field


def _shape(word: str) -> str:
    return re.sub(r"[^\W\d_]", "a", re.sub(r"\d", "9", re.sub(r"[A-Z]", "A", word)))


def _runs(shape: str) -> str:
    return re.sub(r"(.)\1+", r"\1", shape)


def is_free(word: str) -> bool:
    """Whether the field may label the word."""
    return "@" in word or any("0" <= c <= "9" for c in word)


def _own(word: str) -> tuple[str, ...]:
    """Features of a word by itself; one of more than LONGEST characters counts as long and has no shape."""
    return _shaped(word) if len(word) <= LONGEST else ("long", "@" if "@" in word else "no @")


@lru_cache(maxsize=1 << 14)
def _shaped(word: str) -> tuple[str, ...]:
    core = word.strip(".,;:!?\"'|#*$%&<>")
    shape = _shape(core)
    digits = _NOT_DIGIT.sub("", core)
    return (
        "shape " + shape, "runs " + _runs(shape), f"digits {len(digits)}", f"dots {core.count('.')}", "first " + shape[:1], "last " + shape[-1:],
        f"@ {'@' in core[1:-1]} {'.' in core.partition('@')[2][1:-1]}", f"all digits {core.isdigit()}", f"hex {bool(re.fullmatch('[0-9a-f]{16,}', core)) and not core.isdigit()}",
        f"luhn {len(digits) if 13 <= len(digits) <= 19 and luhn(digits) else 0}", f"byte parts {bool(re.fullmatch('[0-9.]+', core)) and all(p and int(p[:4]) < 256 for p in core.split('.'))}", f"punctuated {word[-1:] in '.,;:!?'}",
    )


def _near(word: str) -> str:
    return _beside(word[:LONGEST])


@lru_cache(maxsize=1 << 14)
def _beside(word: str) -> str:
    return _runs(_shape(word[:24].strip(".,;:!?\"'|#*$%&<>"))) if is_free(word) else word[:12].lower() if word.isascii() and word[:12].lower() in _CUES else "w"


_CUES = frozenset("call phone tel tel: phone: mobile fax card card: visa ip ip: host from mail email email: version page room item order id id: chapter year".split())


def features(before: str | None, word: str, after: str | None) -> list[str]:
    near = ["-" if w is None else _near(w) for w in (before, after)]
    return [*_own(word), "before " + near[0], "after " + near[1]]


def labelled(sentences: int = 320, seed: int = 11) -> list[list[tuple[str, str]]]:
    """The labelled table: sentences of (word, label), personal data in many spellings among ordinary numbers."""
    r = random.Random(seed)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    w = lambda: "".join(r.choice(("an", "re", "ti", "on", "st", "or", "ea", "ou", "le")) for _ in range(r.randint(1, 4)))
    part = lambda: str(r.randint(0, 255))
    private = {
        "email": [lambda: f"{w()}@{w()}.com", lambda: f"{w()}.{w()}@{w()}.{w()}.org", lambda: f"{w()}{d(2)}@{w()}-{w()}.net", lambda: f"{w()}.{d(2)}@mail{d(1)}.{w()}.com", lambda: f"<{w()}@{w()}.de>"],
        "ip": [lambda: ".".join(part() for _ in range(4)), lambda: ".".join(part() for _ in range(4)) + f":{d(4)}", lambda: ".".join(part() for _ in range(4)) + "/24"],
        "card": [lambda: d(16), lambda: f"{d(4)} {d(4)} {d(4)} {d(4)}", lambda: f"{d(4)}-{d(4)}-{d(4)}-{d(4)}", lambda: f"{d(4)} {d(6)} {d(5)}", lambda: d(15)],
        "phone": [lambda: f"+1 ({d(3)}) {d(3)}-{d(4)}", lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"+{d(2)} {d(3)} {d(7)}", lambda: f"0{d(3)} {d(3)} {d(4)}", lambda: f"+{d(11)}", lambda: f"({d(3)}){d(3)}-{d(4)}", lambda: f"{d(3)}.{d(3)}.{d(4)}"],
    }
    ordinary = [lambda: str(r.randint(1000, 2100)), lambda: d(r.randint(1, 6)), lambda: f"{d(1)}.{d(1)}", lambda: f"{d(1)}.{d(1)}.{d(2)}", lambda: f"{r.randint(1, 12)}/{r.randint(1, 28)}/20{d(2)}", lambda: f"20{d(2)}-0{r.randint(1, 9)}-{r.randint(10, 28)}",
                lambda: f"{d(2)}:{d(2)}", lambda: f"{d(2)}%", lambda: f"${d(3)}.{d(2)}", lambda: f"{w()}{d(1)}", lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.choice((32, 40, 64)))), lambda: f"AKIA{w().upper()}{d(6)}", lambda: f"@{w()}", lambda: f"{d(1)},{d(3)},{d(3)}", lambda: d(r.randint(8, 12)), lambda: d(r.randint(21, 40)), lambda: f"{d(3)}-{d(1)}-{d(5)}-{d(3)}-{d(1)}"]
    out = []
    for _ in range(sentences):
        line: list[tuple[str, str]] = []
        for _ in range(r.randint(2, 4)):
            line += [(w(), "O") for _ in range(r.randint(0, 2))]
            if r.random() < 0.25:
                line.append((r.choice(sorted(_CUES)), "O"))
            if r.random() < 0.5:
                kind = r.choice(KINDS)
                words = r.choice(private[kind])().split(" ")
                line += [(x, f"{'I' if k else 'B'}-{kind}") for k, x in enumerate(words)]
            else:
                line.append((r.choice(ordinary)(), "O"))
            line += [(w(), "O") for _ in range(r.randint(1, 2))]
            if r.random() < 0.3:
                line[-1 if r.random() < 0.5 else -2] = (line[-1][0] + r.choice(".,;"), line[-1][1]) if r.random() < 0.5 else line[-1]
        out.append(line)
    return out


@lru_cache(maxsize=1)
def default_field() -> Crf:
    return fit(labelled())


def fit(table: list[list[tuple[str, str]]]) -> Crf:
    """The field trained on a labelled table."""
    rows = []
    for line in table:
        words = [x for x, _ in line]
        names = [features(words[k - 1] if k else None, x, words[k + 1] if k + 1 < len(words) else None) for k, x in enumerate(words)]
        free = [is_free(x) for x in words]
        rows.append((names, free, [tag if ok else "O" for (_, tag), ok in zip(line, free, strict=True)]))
    return train(LABELS, rows)


_CLUE, _JOINED = np.zeros(256, bool), np.zeros(256, bool)
_CLUE[[*range(48, 58), 64]] = True
_JOINED[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789@.+()_%:/-")] = True


def _cut_long(data: np.ndarray, clue: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words, with those of more than LONGEST bytes that hold a clue cut to runs of the characters that numbers and addresses are made of."""
    long = np.flatnonzero((ends - starts > LONGEST) & (clue[ends] > clue[starts]))
    if not len(long):
        return starts, ends, first
    new = [(starts, ends)]
    for k in long.tolist():
        inside = np.concatenate(([False], _JOINED[data[starts[k] : ends[k]]], [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + starts[k]
        new.append((edges[::2], edges[1::2]))
    a, b = (np.concatenate(x) for x in zip(*new, strict=True))
    keep = np.ones(len(a), bool)
    keep[long] = False
    order = np.argsort(a[keep], kind="stable")
    a, b = a[keep][order], b[keep][order]
    bounds = np.append(starts, len(data))[first]  # where each row's first word begins
    return a, b, np.searchsorted(a, bounds)


def modelled(field: Crf, data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[str, int, int]]]:
    """The field's spans by row, as byte ranges within the row."""
    rows: list[list[tuple[str, int, int]]] = [[] for _ in range(len(offsets) - 1)]
    clue = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_CLUE[data], out=clue[1:])
    starts, ends, first = _cut_long(data, clue, *kernel.word_spans(data, offsets))
    free = np.flatnonzero(clue[ends] > clue[starts])
    if not len(free):
        return rows
    row = np.searchsorted(first, free, "right") - 1
    word = lambda k: data[starts[k] : ends[k]].tobytes().decode("utf-8", "replace")
    names = []
    for k, own in zip(free.tolist(), row.tolist(), strict=True):
        before = word(k - 1) if k > first[own] else None
        after = word(k + 1) if k + 1 < first[own + 1] else None
        names.append(features(before, word(k), after))
    begins = np.concatenate(([True], (free[1:] != free[:-1] + 1) | (row[1:] != row[:-1])))
    lengths = np.diff(np.concatenate((np.flatnonzero(begins), [len(free)])))
    labels = field.viterbi(field.emissions(names, np.ones(len(free), bool)), lengths)
    k = 0
    while k < len(free):
        tag = field.labels[labels[k]]
        end = k + 1
        if tag[0] == "B":
            while end < len(free) and not begins[end] and field.labels[labels[end]] == "I-" + tag[2:]:
                end += 1
            a, b = int(starts[free[k]]), int(ends[free[end - 1]])
            raw = data[a:b].tobytes()
            left = len(raw) - len(raw.lstrip(b".,;:!?\"'|#*$%&<>[]{}"))
            right = len(raw.rstrip(b".,;:!?\"'|#*$%&<>[]{}"))
            if right > left:
                base = int(offsets[row[k]])
                rows[row[k]].append((tag[2:], a + left - base, a + right - base))
        k = end
    return rows


def finder(field: Crf):
    """For :func:`spans.with_spans`: the pattern spans, and the field's that overlap none of them."""

    def find(batch: pa.RecordBatch, name: str) -> list[list[spans.Found]]:
        out: list[list[spans.Found]] = []
        for _, _, offsets, data in kernel.slices(batch, name):
            extra = modelled(field, data, offsets)
            raw = data.tobytes()
            for k, more in enumerate(extra):
                body = raw[offsets[k] : offsets[k + 1]]
                found = patterns(body.decode("utf-8", "replace"))
                if more:
                    taken = [(a, b) for _, a, b, _ in found]
                    for kind, a, b in more:
                        a, b = len(body[:a].decode("utf-8", "replace")), len(body[:b].decode("utf-8", "replace"))
                        if all(b <= x or y <= a for x, y in taken):
                            found.append((kind, a, b, False))
                out.append(found)
        return out

    return find


def detect(docs: DataFrame, text: str = "text", field: Crf | None = None, carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all by default) with ``spans``: kind, start, end, and whether a fixed pattern found it."""
    return spans.with_spans(docs, finder(field or default_field()), KINDS, text, carry=carry)


def redact(docs: DataFrame, text: str = "text", field: Crf | None = None) -> DataFrame:
    """``docs`` with every span in the text replaced by <KIND>; a null text stays null. Other columns are unchanged."""
    find = finder(field or default_field())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column(batch.schema.get_field_index(text)).to_pylist()
            found = find(batch, text)
            new = [None if t is None else spans.redacted(t, [s[:3] for s in row]) if row else t for t, row in zip(old, found, strict=True)]
            yield kernel.replace_column(batch, text, pa.array(new, batch.schema.field(text).type))

    return docs.mapInArrow(kernel.tidied(run), docs.schema)


def digest(found: DataFrame) -> DataFrame:
    """The counts of base spans, the hash of their list, and the list of all spans."""
    own = spans.base(F.col("spans"))
    return found.select("doc_id", *[spans.count(own, k).alias(f"n_{k}") for k in KINDS], F.sha2(spans.written(own), 256).alias("base_sha256"), spans.written(F.col("spans")).alias("spans"))

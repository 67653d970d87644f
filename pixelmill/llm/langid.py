"""Language identification by interpolated Kneser-Ney character models.

Per language a model of order 4 over lower-cased letters; runs of other characters are one boundary. A model is sorted
arrays of n-gram hashes with discounted probabilities, and of context hashes with back-off weights, one pair per order.
Texts take the language of the lowest cross-entropy per character. Blocks of texts are scored together: their distinct
4-grams are looked up once, by binary search.

Models are fitted on a bounded sample: per language about PER_LANGUAGE ids, chosen by a hash, and of these, shortest-first
by whether they exceed LONGEST bytes and then by hash, as many as BYTES hold, one at least. The sample is all that comes to
the driver. A tenth of it is kept out of the counts to calibrate rejection: a text whose best cross-entropy lies above that
language's threshold gets ``rejected`` and half its score, but keeps its best language.

Null texts and texts without a letter are ``und`` with score 0. Rows without a language, text or id are not learned
from; rows that repeat an id are learned from once (the least text). With nothing to learn from every text is ``und``; an
empty table gives an empty one. Very long texts are scored whole; ties go to the first language in order of names;
repeated rows give equal rows, whatever rows stand beside them. Other columns pass through, except those named like the
output, which it replaces.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelmill.llm import kernel

ORDER, PER_LANGUAGE, ALPHABET = 4, 300, 4000
#: Bytes of the sample of a language, and of a text beyond which others are taken first.
BYTES, LONGEST = 4 << 20, 1 << 18
UNKNOWN = "und"
_BITS = np.uint64(12)


def _letters() -> np.ndarray:
    return np.fromiter((chr(k).isalpha() for k in range(0x110000)), bool, 0x110000)


_LETTER = _letters()


def _symbols(texts: list[str], number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the letters of all texts, and where each text begins: runs of other characters are a boundary, 0, and a
    text ends with one. What else is in the block changes nothing: none begins with one.
    """
    points = np.frombuffer("".join(t.lower() + "\0" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ids = np.where(_LETTER[points], number[points], 0)
    sizes = np.fromiter((len(t.lower()) for t in texts), np.int64, len(texts))
    begins = np.concatenate(([0], np.cumsum(sizes + 1)))
    keep = ids != 0
    keep[1:] |= ids[:-1] != 0
    total = np.concatenate(([0], np.cumsum(keep)))
    return ids[keep].astype(np.uint64), total[begins]


def _grams(ids: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """The codes of the grams of ``order`` symbols that end at each symbol; before a text stand boundaries."""
    codes = ids.copy()
    place = np.arange(len(ids)) - np.repeat(at[:-1], np.diff(at))
    for back in range(1, order):
        codes[back:] |= np.where(place[back:] >= back, ids[:-back] << (_BITS * np.uint64(back)), np.uint64(0))
    return codes


class SortedHash:
    """Floats by 64-bit hash; a missing key has ``default``."""

    def __init__(self, codes: np.ndarray, values: np.ndarray, salt: int, default: float):
        keys = kernel.mix(codes + np.uint64(salt << 56))
        order = np.argsort(keys)
        self.keys, self.values, self.salt, self.default = keys[order], values[order].astype(np.float32), salt, default

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(codes), self.default, np.float32)
        key = kernel.mix(codes + np.uint64(self.salt << 56))
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], np.float32(self.default))


class KneserNey:
    """p(symbol | up to ORDER - 1 symbols before), interpolated down to the uniform distribution."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, alphabet: int):
        self.levels: list[tuple[SortedHash, SortedHash]] = []
        self.uniform = 1.0 / (alphabet + 1)
        grams, n = codes, counts.astype(np.float64)
        tables = []
        for order in range(ORDER, 0, -1):
            tables.append((order, grams, n))
            shorter = grams & np.uint64((1 << int(_BITS) * (order - 1)) - 1)
            grams, into = np.unique(shorter, return_inverse=True)
            n = np.bincount(into, minlength=len(grams)).astype(np.float64)  # continuation counts
        for order, grams, n in reversed(tables):
            n1, n2 = (n == 1).sum(), (n == 2).sum()
            discount = min(0.9, n1 / (n1 + 2 * n2)) if n1 and n2 else 0.5
            contexts, into = np.unique(grams >> _BITS, return_inverse=True)
            total, kinds = np.bincount(into, n, len(contexts)), np.bincount(into, minlength=len(contexts))
            self.levels.append((SortedHash(grams, np.maximum(n - discount, 0) / total[into], order, 0.0), SortedHash(contexts, discount * kinds / total, order + 8, 1.0)))

    def log10(self, codes: np.ndarray) -> np.ndarray:
        p = np.full(len(codes), self.uniform)
        for order, (share, back) in enumerate(self.levels, 1):
            own = codes & np.uint64((1 << int(_BITS) * order) - 1)
            p = share(own) + back(own >> _BITS) * p
        return np.log10(p)


@dataclass
class Models:
    languages: list[str]
    alphabet: np.ndarray  # code points that have a number, ascending; 0 is the boundary
    models: list[KneserNey]
    limits: np.ndarray  # cross-entropies above which a text is rejected

    def numbers(self) -> np.ndarray:
        out = np.full(0x110000, len(self.alphabet) + 1, np.int32)
        out[self.alphabet] = np.arange(1, len(self.alphabet) + 1)
        return out


def _entropies(models: Models, number: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy per symbol by text and language; how many letters each text has."""
    ids, at = _symbols(texts, number)
    codes, distinct = pd.factorize(_grams(ids, at, ORDER).view(np.int64))
    distinct = distinct.view(np.uint64)
    size = np.maximum(np.diff(at), 1)
    out = np.empty((len(texts), len(models.models)))
    for k, model in enumerate(models.models):
        out[:, k] = -kernel.row_sums(model.log10(distinct)[codes], at) / size
    return out, kernel.row_sums(ids > 0, at)


def _score(models: Models, number: np.ndarray, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    if not models.models:
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
    entropy, letters = _entropies(models, number, texts)
    best = entropy.argmin(1)
    low = entropy[np.arange(len(texts)), best]
    weight = np.minimum(letters, 60)[:, None] * np.log(10)
    share = 1 / np.exp(-(entropy - low[:, None]) * weight).sum(1)
    rejected = low > models.limits[best]
    none = letters == 0
    names = [UNKNOWN if z else models.languages[k] for k, z in zip(best.tolist(), none.tolist(), strict=True)]
    return names, np.where(none, 0.0, np.where(rejected, 0.5, 1.0) * share), rejected & ~none


def share_limit(wanted: int, rows: int) -> int:
    """The 53-bit hash below which about ``wanted`` of so many rows lie; at least 1, and all of few rows."""
    return max(1, min(1 << 53, (wanted << 53) // max(rows, 1)))


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", id: str = "doc_id", per_language: int = PER_LANGUAGE) -> Models:
    """Models from labelled rows, of which about ``per_language`` by language are used."""
    rows = rows.select(F.col(id).cast("string").alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text")).where("id is not null and lang is not null and text is not null")
    limits = {r.lang: share_limit(per_language, r["count"]) for r in rows.groupBy("lang").count().collect()}  # a row per language
    if not limits:
        return Models([], np.zeros(0, np.int64), [], np.zeros(0))
    limit = F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(v))])
    place = F.shiftrightunsigned(F.xxhash64("id", F.lit(7)), 11)  # 53 bits
    sample = rows.withColumn("place", place).where(F.col("place") < limit[F.col("lang")]).groupBy("lang", "id", "place").agg(F.min("text").alias("text"))
    order = Window.partitionBy("lang").orderBy(F.octet_length("text") > LONGEST, "place", "id")  # about PER_LANGUAGE rows
    held = sample.withColumns({"n": F.row_number().over(order), "size": F.sum(F.octet_length("text").cast("long")).over(order)}).where((F.col("n") == 1) | (F.col("size") <= BYTES))
    texts: dict[str, list[str]] = {}
    for r in held.orderBy("id", "lang").select("lang", "text").toLocalIterator():
        texts.setdefault(r.lang, []).append(r.text)
    points, n = np.unique(np.frombuffer("".join(t.lower() for ts in texts.values() for t in ts).encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)
    points, n = points[_LETTER[points]], n[_LETTER[points]]
    alphabet = np.sort(points[np.argsort(-n, kind="stable")[:ALPHABET]])
    out = Models(sorted(texts), alphabet, [], np.zeros(len(texts)))
    number = out.numbers()
    for language in out.languages:
        learn = [t for k, t in enumerate(texts[language]) if k % 10] or texts[language]
        ids, at = _symbols(learn, number)
        out.models.append(KneserNey(*np.unique(_grams(ids, at, ORDER), return_counts=True), len(alphabet)))
    for k, language in enumerate(out.languages):
        held = texts[language][::10]
        entropy, letters = _entropies(out, number, held)
        own = entropy[letters >= 20, k]
        spread = own.std() if len(own) > 1 else 0.3
        out.limits[k] = (own.mean() + max(6 * spread, 0.3)) if len(own) else np.inf
    return out


def identify(docs: DataFrame, models: Models, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all by default) with ``lang_pred``, ``score`` and ``rejected``."""
    names = ["lang_pred", "score", "rejected"]
    keep = [c for c in (docs.columns if carry is None else carry) if c.lower() not in names]
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    shared = docs.sparkSession.sparkContext.broadcast(models)  # bounded by the sample: a few MB

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        number = own.numbers()
        for batch in batches:
            for a, b, _, _ in kernel.slices(batch, "lang_pred"):
                part = batch.slice(a, b - a)
                found = _score(own, number, [t or "" for t in part.column(len(keep)).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(found[0], pa.string()), pa.array(found[1]), pa.array(found[2])], names=[*keep, *names])

    return docs.select(*[docs[c] for c in keep], docs[text].alias("lang_pred")).mapInArrow(kernel.tidied(run), schema)


def remainder(id: Column, folds: int) -> Column:
    """crc32 of the id as text modulo ``folds``; null without an id."""
    return F.crc32(id.cast("string").cast("binary")) % folds

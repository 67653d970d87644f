"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document: the ledger keeps the measurements and one bit per failed rule. A policy
is a versioned mask over those bits, so a verdict is one ``bitwise and``, and ablations (what would each rule, or
each pair of rules, drop by itself) are bitwise aggregates over the ledger without touching a text again.

Null texts count as empty; an empty text has no word and fails the length rule. Very long texts are measured whole.
Repeated rows give equal rows. Input columns are kept unless their name is one of the ledger's, which replaces them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelmill.llm import kernel

NAMES = ("too_short", "repeated_windows", "symbols", "shouting", "echoes", "repeated_lines", "word_length")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_echo_words", "n_letters", "n_upper")
WINDOW = 8
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True


def rules() -> dict[str, Column]:
    """Rule name -> failure condition over the measurements; the bit of a rule is its position."""
    c = {m: F.col(m) for m in MEASURES}
    return {
        "too_short": c["n_words"] < 20,
        "repeated_windows": 100 * c["n_repeat_words"] > 30 * c["n_words"],
        "symbols": (c["n_words"] >= 20) & (100 * c["n_symbols"] > 25 * c["n_words"]),
        "shouting": (c["n_words"] >= 20) & (100 * c["n_upper"] > 60 * c["n_letters"]),
        "echoes": (c["n_words"] >= 20) & (100 * c["n_echo_words"] > 25 * c["n_words"]),
        "repeated_lines": (c["n_lines"] >= 5) & (100 * c["n_dup_lines"] > 60 * c["n_lines"]),
        "word_length": (c["n_words"] >= 20) & ((c["word_chars"] < 2 * c["n_words"]) | (c["word_chars"] > 16 * c["n_words"])),
    }


@dataclass(frozen=True)
class Policy:
    """The rules that drop a document under one version of the policy."""

    version: str
    names: tuple[str, ...]

    @property
    def mask(self) -> int:
        bits = {name: 1 << k for k, name in enumerate(NAMES)}
        return sum(bits[n] for n in self.names)


BASE = Policy("base", ("too_short", "repeated_windows"))
#: word_length is measured but drops nothing in v1: other scripts have other word lengths.
V1 = Policy("v1", ("too_short", "repeated_windows", "symbols", "shouting", "echoes", "repeated_lines"))
POLICIES = {p.version: p for p in (BASE, V1)}


def _measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    starts, ends, first = kernel.word_spans(data, offsets)
    words = kernel.span_hash(data, starts, ends)
    rows = len(offsets) - 1
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    out = {"n_words": np.diff(first), "word_chars": kernel.row_sums(lead[ends] - lead[starts], first)}
    for name, table in (("n_symbols", _SYMBOL), ("n_letters", _LETTER), ("n_upper", _UPPER)):
        out[name] = kernel.row_sums(table[data], offsets)
    echo = np.zeros(len(words), bool)
    echo[1:] = words[1:] == words[:-1]
    echo[first[:-1][first[:-1] < len(words)]] = False
    out["n_echo_words"] = kernel.row_sums(echo, first)
    # lines: cut at \n and at the ends of rows; blank ones have no word
    cuts = np.union1d(np.flatnonzero(data == 10) + 1, offsets)
    begin, end = cuts[:-1], cuts[1:]
    if len(begin):
        end = np.where(data[end - 1] == 10, end - 1, end)
        inside = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
        begin, end = begin[inside], end[inside]
    lines = kernel.span_hash(data, begin, end)
    line_at = np.searchsorted(begin, offsets)
    out["n_lines"] = np.diff(line_at)
    out["n_dup_lines"] = out["n_lines"] - np.diff(kernel.sorted_sets(lines, line_at)[1])
    windows, at, _ = kernel.grams(words, first, WINDOW, whole_if_short=False)
    repeat = np.zeros(rows, np.int64)
    distinct = np.diff(kernel.sorted_sets(windows, at)[1])
    for row in np.flatnonzero(distinct < np.diff(at)):
        own = windows[at[row] : at[row + 1]]
        _, which, times = np.unique(own, return_inverse=True, return_counts=True)
        edge = np.zeros(len(own) + WINDOW, np.int64)
        hit = np.flatnonzero(times[which] > 1)
        edge[hit] += 1
        edge[hit + WINDOW] -= 1
        repeat[row] = (np.cumsum(edge) > 0).sum()
    out["n_repeat_words"] = repeat
    return out


def ledger(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all by default) with its measurements (MEASURES, long) and ``failed_bits`` (long)."""
    names = [*MEASURES, "failed_bits"]
    keep = [c for c in (docs.columns if carry is None else carry) if c.lower() not in names]
    once = text in keep  # then the text goes to the workers as itself only
    source = docs.select(*[docs[c] for c in keep], *([] if once else [docs[text].alias("failed_bits")]))
    schema = T.StructType([*[source.schema[c] for c in keep], *[T.StructField(m, T.LongType()) for m in MEASURES]])

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, offsets, data in kernel.slices(batch, text if once else "failed_bits"):
                found = _measure(data, offsets)
                part = batch.slice(a, b - a)
                arrays = [part.column(k) for k in range(len(keep))] + [pa.array(found[m].astype(np.int64)) for m in MEASURES]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *MEASURES])

    bits = [F.when(rule, F.lit(1 << k)).otherwise(F.lit(0)) for k, rule in enumerate(rules().values())]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return source.mapInArrow(kernel.tidied(measure), schema).withColumn("failed_bits", total.cast("long"))


def failed(policy: Policy) -> Column:
    """Whether the ledger's row fails any rule of the policy."""
    return F.col("failed_bits").bitwiseAND(F.lit(policy.mask)) != 0


def ablation(book: DataFrame, policy: Policy = V1) -> DataFrame:
    """Per rule of the policy: documents that fail it, that only it drops, and that the policy drops without it."""
    names = list(rules())
    seen = book.groupBy(F.col("failed_bits").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count("*").alias("n"))
    table = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(1 << names.index(n)).cast("long").alias("bit")) for n in policy.names])).alias("r")
    x = seen.select("bits", "n", table)
    has = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    rest = F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit"))) != 0
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n")).otherwise(0)), F.lit(0)).cast("long")
    return x.groupBy(F.col("r.rule").alias("rule")).agg(total(has).alias("n_failed"), total(has & ~rest).alias("n_only"), total(rest).alias("n_without"))


def judged(docs: DataFrame, policy: Policy = V1, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The ledger with ``base_failed`` and the policy's verdict ``kept``."""
    return ledger(docs, text, carry).withColumns({"base_failed": failed(BASE), "kept": ~failed(BASE) & ~failed(policy)})


_LIMITS = {
    "too_short": "n_words < 20", "repeated_windows": "100 * n_repeat_words > 30 * n_words", "symbols": "n_words >= 20 and 100 * n_symbols > 25 * n_words",
    "shouting": "n_words >= 20 and 100 * n_upper > 60 * n_letters", "echoes": "n_words >= 20 and 100 * n_echo_words > 25 * n_words",
    "repeated_lines": "n_lines >= 5 and 100 * n_dup_lines > 60 * n_lines", "word_length": "n_words >= 20 and (word_chars < 2 * n_words or word_chars > 16 * n_words)",
}


def oracle_sql() -> str:
    """The ledger's measures, bits and verdicts under V1 in DuckDB SQL, for documents with distinct ids."""
    bits = " + ".join(f"case when {_LIMITS[name]} then {1 << k} else 0 end" for k, name in enumerate(NAMES))
    return rf"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
win as (select doc_id, unnest(range(1, len(w) - {WINDOW - 2})) as i, w from w where len(w) >= {WINDOW}),
keyed as (select doc_id, i, array_to_string(w[i : i + {WINDOW - 1}], ' ') as k from win),
twice as (select doc_id, i from keyed qualify count(*) over (partition by doc_id, k) > 1),
covered as (select doc_id, count(distinct i + j) as n from twice, (select unnest(range(0, {WINDOW})) as j) group by doc_id),
m as (
  select w.doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) as n_letters, length(regexp_replace(t, '[^A-Z]', '', 'g')) as n_upper,
    len(lines) as n_lines, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(covered.n, 0)::bigint as n_repeat_words,
    len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) as n_echo_words
  from w left join covered using (doc_id)),
b as (select *, ({bits})::bigint as failed_bits from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits & {BASE.mask} <> 0 as base_failed, failed_bits & {V1.mask | BASE.mask} = 0 as kept, failed_bits from b
"""

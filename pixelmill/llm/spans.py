"""Found spans in texts: their type, digest columns and removal. Offsets count code points; ends are exclusive."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelmill.llm import kernel

#: base: found by the fixed patterns; otherwise added by the model.
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
Found = tuple[str, int, int, bool]


def with_spans(docs: DataFrame, find: Callable[[pa.RecordBatch, str], list[list[Found]]], kinds: tuple[str, ...], text: str = "text", name: str = "spans", carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all by default) with the array ``name`` of what ``find`` sees in each row, ordered by start, then kind as in ``kinds``."""
    keep = [c for c in (docs.columns if carry is None else carry) if c.lower() != name]
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField(name, SPANS)])
    place = {k: n for n, k in enumerate(kinds)}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[dict(zip(("kind", "start", "end", "base"), x, strict=True)) for x in sorted(row, key=lambda x: (x[1], place[x[0]], x[2]))] for row in find(batch, name)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(rows, _ARROW)], names=[*keep, name])

    return docs.select(*[docs[c] for c in keep], docs[text].alias(name)).mapInArrow(kernel.tidied(run), schema)


def written(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def base(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["base"])


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with its spans replaced by <KIND>; spans that overlap give the mark of the first one."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join(out) + text[at:]

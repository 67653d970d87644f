"""MinHash near-duplicates with HyperMinHash registers.

A document's set holds its distinct five-word shingles. One hash per shingle picks a bucket; per bucket the least
remaining hash is stored as a HyperMinHash register, a leading-zero count and the mantissa bits after it. Empty
buckets borrow from a pseudo-random non-empty one, so short documents band like long ones.

1. Documents with equal sets form a class, which its least id represents.
2. Registers of representatives are banded. In each bucket of equal bands, members are paired with the least member.
3. A pair's registers give a Jaccard estimate, corrected for colliding registers; pairs far below the threshold go.
4. The rest is confirmed on the full shingle sets, recomputed from the texts.
5. Buckets whose other members are still of several components are compared member by member, without texts, in blocks
   of at most 2 x BLOCK members whose size doesn't grow with the bucket: by registers, and then, where both sets have no
   more shingles than there are registers, by 32 bits of every shingle, which can only overstate what sets share.
   Promising pairs of different components are confirmed likewise. So no pair that shares a band is left out, no pair of rows is made but for promising ones,
   and a bucket that is one component, however large, costs rows in proportion to its size.

With 70 bands of 6 registers a pair at similarity 0.75 shares no band with probability 1e-6; one at 0.3 shares one with
probability 0.05, so large groups of loosely related texts give few candidates.

Null texts, empty texts and texts without words have the empty set and are linked with nothing. Rows without an id are
kept with a null component. Rows that repeat an id count as one document with the links of all their texts; each is returned.
Very long texts are hashed whole, a slice at a time. An empty table gives an empty one. Columns other
than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.llm import kernel
from pixelmill.llm.components import components
from pixelmill.llm.shared import Scratch

SHINGLE, REGISTERS, ROWS, MANTISSA = 5, 420, 6, 10
NUMERATOR, DENOMINATOR = 75, 100
#: Standard errors of the estimate below the threshold at which a pair is given up without confirmation.
MARGIN = 5.0
#: Sets of so few shingles are confirmed without an estimate: a bucket that two of them share counts for much.
TINY = 16
BLOCK = 256


def _bit_length(x: np.ndarray) -> np.ndarray:
    out = np.zeros(x.shape, np.int64)
    for step in (32, 16, 8, 4, 2, 1):
        high = x >> np.uint64(step) > 0
        out += high * step
        x = np.where(high, x >> np.uint64(step), x)
    return out + (x > 0)


def compress(least: np.ndarray) -> np.ndarray:
    """Registers (uint16) of 32-bit minima: leading zeros (6 bits) and the MANTISSA bits after the leading one."""
    length = _bit_length(least)
    body = least ^ np.where(length > 0, np.uint64(1) << np.maximum(length - 1, 0).astype(np.uint64), np.uint64(0))
    shift = MANTISSA - (length - 1)
    mantissa = np.where(shift >= 0, body << np.maximum(shift, 0).astype(np.uint64), body >> np.maximum(-shift, 0).astype(np.uint64))
    return ((32 - length).astype(np.uint16) << np.uint16(MANTISSA)) | (mantissa & np.uint64((1 << MANTISSA) - 1)).astype(np.uint16)


@lru_cache(maxsize=2)
def _borrowing(k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each bucket an order of all buckets to borrow from (choice x bucket), and each one's place in it."""
    place = np.random.default_rng(97).permuted(np.tile(np.arange(k, dtype=np.int32), (k, 1)), axis=1)
    return np.ascontiguousarray(np.argsort(place, 1).T), place


def registers(sets: np.ndarray, at: np.ndarray, k: int = REGISTERS) -> np.ndarray:
    """HyperMinHash registers (rows x k, uint16) of sorted sets; a row of an empty set is all 0."""
    rows = len(at) - 1
    bucket = ((sets >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
    row = np.repeat(np.arange(rows), np.diff(at))
    cell = row * k + bucket
    first = np.ones(len(cell), bool)
    first[1:] = cell[1:] != cell[:-1]
    # within a bucket the order of the hashes is that of their high bits; the register takes other, independent ones
    low = kernel.mix(sets) >> np.uint64(32)
    least = np.zeros(rows * k, np.uint64)
    filled = np.zeros(rows * k, bool)
    where = np.flatnonzero(first)
    if len(where):
        least[cell[where]] = np.minimum.reduceat(low, where)
        filled[cell[where]] = True
    out = compress(least.reshape(rows, k))
    filled = filled.reshape(rows, k)
    order, place = _borrowing(k)
    open_rows = np.flatnonzero(filled.any(1) & ~filled.all(1))
    todo, columns = ~filled[open_rows], np.arange(k)
    for pick in order[:12]:  # the first choices of all rows at once; what is still open after them goes row by row
        take = todo & filled[open_rows][:, pick]
        r, c = np.nonzero(take)
        out[open_rows[r], columns[c]] = out[open_rows[r], pick[c]]
        todo &= ~take
        left = todo.any(1)
        open_rows, todo = open_rows[left], todo[left]
    for r, wanted in zip(open_rows.tolist(), todo, strict=True):
        have = np.flatnonzero(filled[r])
        out[r, wanted] = out[r, have[place[wanted][:, have].argmin(1)]]
    out[~filled.any(1)] = 0
    return out


def sketch(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n, d1, d2, registers): set size, digests of the set (equal sets, equal digests), HyperMinHash registers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, offsets, data in kernel.slices(batch, "text"):
                sets, at = kernel.shingle_sets(data, offsets, SHINGLE)
                regs = registers(sets, at)
                width = regs.shape[1] * 2
                column = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(np.arange(b - a + 1, dtype=np.int32) * width), pa.py_buffer(np.ascontiguousarray(regs))])
                digests = [pa.array(kernel.row_sums(kernel.mix(sets ^ np.uint64(salt)), at).view(np.int64)) for salt in (0x51ED270B, 0xA24BAED4963EE407)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(at)), *digests, column], names=["id", "n", "d1", "d2", "registers"])

    return docs.select(docs[id].cast("long").alias("id"), docs[text].alias("text")).mapInArrow(kernel.tidied(run), "id long, n long, d1 long, d2 long, registers binary")


def bands(sketches: DataFrame, rows: int = ROWS) -> DataFrame:
    """(key, id, n) for each band of each sketch; the key hashes the band's number and registers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint16).reshape(batch.num_rows, -1).astype(np.uint64)
            n = regs.shape[1] // rows
            packed = np.zeros((len(regs), n), np.uint64)
            for k in range(rows):
                packed = kernel.mix(packed * np.uint64(0x9E3779B97F4A7C15) + regs[:, k : n * rows : rows])
            key = kernel.mix(packed + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            ids = np.repeat(batch.column("id").to_numpy(zero_copy_only=False), n)
            sizes = np.repeat(batch.column("n").to_numpy(), n)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(ids), pa.array(sizes)], names=["key", "id", "n"])

    return sketches.select("id", "n", "registers").mapInArrow(kernel.tidied(run), "key long, id long, n long")


def collision_rate(n: np.ndarray, m: np.ndarray, k: int = REGISTERS) -> np.ndarray:
    """Chance that registers of unrelated buckets agree, for sets of n and m shingles.

    The minimum of s hashes is near 1/s of their range, so its leading-zero count is nearly fixed and the mantissa
    adds MANTISSA bits; the constant is that of equal leading-zero counts, doubled to stay on the safe side.
    """
    size = np.maximum(np.minimum(n, m) / k, 1.0)
    ratio = np.maximum(np.maximum(n, m) / k, 1.0) / size
    return np.minimum(1.0, 2 * 0.6 / (1 << MANTISSA) / ratio + 1 / 2**22)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimates of register rows."""
    agree = (a == b).mean(1)
    chance = collision_rate(n, m, a.shape[1])
    return np.clip((agree - chance) / (1 - chance), 0, 1)


_FLOOR = NUMERATOR / DENOMINATOR - MARGIN * float(np.sqrt(NUMERATOR * (DENOMINATOR - NUMERATOR) / DENOMINATOR**2 / REGISTERS))


def _sizes_allow(n: str, m: str) -> str:
    """Whether sets of these sizes can reach the threshold: it spares most pairs the lookup of their registers."""
    return f"least({n}, {m}) * {DENOMINATOR} >= greatest({n}, {m}) * {NUMERATOR}"


def promising(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) whose estimate is not far below the threshold."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("ra", "rb")]
            n, m = (batch.column(c).to_numpy() for c in ("na", "nb"))
            yield batch.select(["a", "b"]).filter(pa.array((estimate(*regs, n, m) >= _FLOOR) | (np.maximum(n, m) <= TINY)))

    side = lambda x: sketches.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("registers").alias(f"r{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(kernel.tidied(run), "a long, b long")


def brief_sets(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(id, brief): the low 32 bits of each distinct shingle, ascending, of sets no larger than the registers; else null."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, offsets, data in kernel.slices(batch, "text"):
                sets, at = kernel.shingle_sets(data, offsets, SHINGLE)
                low = [np.sort(sets[x:y].astype(np.uint32)).tobytes() if y - x <= REGISTERS else None for x, y in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(low, pa.binary())], names=["id", "brief"])

    return docs.select(docs[id].cast("long").alias("id"), docs[text].alias("text")).mapInArrow(kernel.tidied(run), "id long, brief binary")


def _brief_allow(a: np.ndarray | None, b: np.ndarray | None) -> bool:
    """Whether what the 32-bit sets share can reach the threshold; True where one is unknown."""
    if a is None or b is None:
        return True
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = min(int((b[at] == a).sum()), len(b))
    return both * DENOMINATOR >= NUMERATOR * (len(a) + len(b) - both)


def _block_pairs(part: np.ndarray, i: int, j: int, ids: np.ndarray, comps: np.ndarray, sizes: np.ndarray, regs: np.ndarray, brief: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Promising pairs of different components between parts i and j of a bucket, or within i if they are one."""
    for x in np.flatnonzero(part == i).tolist():
        others = np.flatnonzero((part == j) & (comps != comps[x]) & ((ids > ids[x]) if i == j else True))
        small, large = np.minimum(sizes[others], sizes[x]), np.maximum(sizes[others], sizes[x])
        others = others[small * DENOMINATOR >= large * NUMERATOR]
        if len(others):
            good = others[(estimate(regs[others], regs[x], sizes[others], sizes[x]) >= _FLOOR) | (np.maximum(sizes[others], sizes[x]) <= TINY)]
            good = good[[_brief_allow(brief[x], brief[y]) for y in good.tolist()]] if len(good) else good
            yield np.minimum(ids[good], ids[x]), np.maximum(ids[good], ids[x])


def promising_in_buckets(inside: DataFrame) -> DataFrame:
    """Promising pairs (a, b) of different components within buckets, from (key, members, id, component, n, registers, brief)."""
    parts = F.ceil(F.col("members") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id", "key"), parts).cast("int")
    placed = inside.withColumns({"parts": parts, "part": own}).select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    block = [F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")]
    dealt = placed.select("key", *block, "part", "id", "component", "n", "registers", "brief").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups() -> Iterator[pa.Table]:
            """Whole groups; one may span batches."""
            held: list[pa.RecordBatch] = []
            last = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                marks = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "i", "j")], 1)
                cuts = np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1
                for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(marks)], strict=True):
                    mark = tuple(marks[a])
                    if mark != last and held:
                        yield pa.Table.from_batches(held)
                        held = []
                    held.append(batch.slice(a, b - a))
                    last = mark
            if held:
                yield pa.Table.from_batches(held)

        for group in groups():
            if len(group) < 2:
                continue
            get = lambda c: group.column(c).to_numpy()  # noqa: B023, E731
            regs = np.frombuffer(b"".join(group.column("registers").to_pylist()), np.uint16).reshape(len(group), -1)
            for a, b in _block_pairs(get("part"), group["i"][0].as_py(), group["j"][0].as_py(), get("id"), get("component"), get("n"), regs, [None if x is None else np.frombuffer(x, np.uint32) for x in group.column("brief").to_pylist()]):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return dealt.mapInArrow(kernel.tidied(run), "a long, b long")


def confirmed(pairs: DataFrame, docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b, offsets, data in kernel.slices(batch, "ta"):
                left, at = kernel.shingle_sets(data, offsets, SHINGLE)
                for a2, b2, offsets2, data2 in kernel.slices(batch.slice(a, b - a), "tb"):
                    right, at2 = kernel.shingle_sets(data2, offsets2, SHINGLE)
                    for row in range(a2, b2):
                        x, y = left[at[row] : at[row + 1]], right[at2[row - a2] : at2[row - a2 + 1]]
                        both = len(np.intersect1d(x, y, assume_unique=True))
                        keep.append(both > 0 and DENOMINATOR * both >= NUMERATOR * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda x: docs.select(docs[id].cast("long").alias(x), docs[text].alias(f"t{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(kernel.tidied(run), "a long, b long")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs``; ``component_id`` is the least id that links reach."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    all_sketches = scratch.write(sketch(docs, id, text), "sketch")
    full = all_sketches.where("n > 0 and id is not null")
    classes = scratch.write(full.groupBy("n", "d1", "d2").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "classes")
    # an id that is repeated with several sets represents each of them, and links their classes
    sketches = scratch.write(full.join(classes.select(F.col("rep").alias("id"), "n", "d1", "d2"), ["id", "n", "d1", "d2"], "left_semi").dropDuplicates(["id", "n", "d1", "d2"]).select("id", "n", "registers"), "reps")
    banded = scratch.write(bands(sketches), "bands")
    pivots = banded.groupBy("key").agg(F.min(F.struct("id", F.col("n").alias("na"))).alias("p"), F.count("*").alias("members")).where("members > 1").select("key", "p.*", "members").withColumnRenamed("id", "a")
    members = scratch.write(banded.join(pivots, "key").where("a <> id").select("key", "members", "a", "na", "id", "n"), "members")
    scratch.drop("bands")

    def link(pairs: DataFrame, k: int) -> DataFrame:
        return scratch.write(confirmed(scratch.write(pairs, f"chosen{k}"), docs, id, text).distinct(), f"links{k}")

    repeated = full.groupBy("id").agg(F.min(F.struct("n", "d1", "d2")).alias("x"), F.max(F.struct("n", "d1", "d2")).alias("y")).where("x <> y").select("id")
    same_id = full.join(repeated, "id").select("id", "n", "d1", "d2").distinct().join(classes, ["n", "d1", "d2"]).where("id <> rep").select(F.least("id", "rep").alias("a"), F.greatest("id", "rep").alias("b"))
    links = link(promising(members.where(_sizes_allow("n", "na")).select("a", F.col("id").alias("b")).distinct(), sketches), 0)
    links = scratch.write(links.unionByName(same_id).distinct(), "links")
    found = components(links, scratch, "cc0_")
    # pairs with the pivot are done; a bucket is open while its other members differ
    others = members.where("members > 2").join(found, "id", "left").select("key", "members", "id", F.coalesce("component", "id").alias("component"))
    several = others.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key")
    inside = scratch.write(others.join(several, "key", "left_semi"), "open")
    texts = docs.join(inside.select(F.col("id").alias("_open")).distinct(), docs[id].cast("long") == F.col("_open"), "left_semi")
    brief = scratch.write(brief_sets(texts, id, text).groupBy("id").agg(F.when(F.count("*") == 1, F.first("brief")).alias("brief")), "brief")
    more = link(promising_in_buckets(inside.join(sketches, "id").join(brief, "id", "left")).distinct(), 1)
    if not more.isEmpty():
        links = links.unionByName(more)
        found = components(links, scratch, "cc1_")
    by_class = classes.join(found.withColumnRenamed("id", "rep"), "rep", "left")
    by_class = scratch.write(by_class.select("n", "d1", "d2", F.coalesce("component", "rep").alias("component")), "labels")
    scratch.keep_only("sketch", "labels")
    out = all_sketches.select("id", "n", "d1", "d2").join(by_class, ["n", "d1", "d2"], "left")
    component = F.coalesce(F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.col("component")), F.col("id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


#: The same by comparing all pairs that share a shingle, for documents with distinct ids.
ORACLE_SQL = r"""
with recursive d as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
s as (select distinct doc_id, hash(unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) end)) as s from d),
n as (select doc_id, count(*) as n from s group by doc_id),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by all),
links as (select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 75 * (x.n + y.n - shared)),
ends as (select a, b from links union all select b, a from links),
reach as (select a as id, a as other from ends union select r.id, e.b from reach r join ends e on r.other = e.a),
least_of as (select id, min(other) as c from reach group by id)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, coalesce(c, d.doc_id) as component_id, coalesce(c, d.doc_id) = d.doc_id as kept
from d left join n on n.doc_id = d.doc_id left join least_of on id = d.doc_id
"""

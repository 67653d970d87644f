"""Byte-level BPE encoding and decoding by a hierarchical-bitmap rank queue.

The queue has a bucket per merge rank, holding positions of a linked list of symbols whose pair has that rank. Three
levels of 64-bit bitmaps say which buckets hold anything, so find-first-set gives the next rank in three steps. A
position is stale, and is skipped, when its pair's rank is no longer that of its bucket.

:func:`merge_long` runs the queue over one pre-token, in time near linear in its length. :func:`merge_many` runs one
queue over many short pre-tokens laid end to end: per step it takes, in numpy, the leftmost live position of every
pre-token in the lowest bucket. Pre-tokens don't touch, so each sees its own merges in the order of its own ranks.

Null and empty texts encode as no ids; ids decode to exactly the bytes that were encoded. Very long texts are encoded
whole, in segments that no match of the pattern crosses, so beside the text and its ids a worker holds a bounded amount;
it remembers chunks and pre-tokens within a partition only. Repeated rows give equal rows, an empty table gives none.
Columns pass through, except those named like the output, which it replaces.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from pixelmill.llm import kernel

NONE = (1 << 31) - 1
LONG = 256
#: Bytes, about, that a worker remembers of chunks, and of pre-tokens, within a partition; bytes of an entry besides its content.
CACHE, ENTRY = 48 << 20, 200
#: Size of a chunk or pre-token up to which it is remembered; bytes of text that are cut up, and that are encoded, at a time.
KEPT, SEGMENT, GROUP = 64, 1 << 20, 4 << 20
#: Bytes of pre-tokens in one queue; ids that are decoded at a time.
MERGE_BYTES, BLOCK = 1 << 20, 1 << 20
_WHITE = r"\t\n\v\f\r \x85\xa0  -     　"
_POINTS = [ord(c) for c in regex.findall(rf"[{_WHITE}]", "".join(map(chr, range(0x3001))))]
_WHITE_BYTE, _WHITE_LEAD = np.zeros(256, bool), np.zeros(256, bool)
_WHITE_BYTE[[p for p in _POINTS if p < 0x80]] = True
_WHITE_LEAD[[chr(p).encode()[0] for p in _POINTS if p >= 0x80]] = True
_WHITE_THREE = np.array([int.from_bytes(chr(p).encode(), "big") for p in _POINTS if p >= 0x800])
SPACE_SAFE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class RankQueue:
    """Buckets by rank, over a bitmap of three levels."""

    def __init__(self, ranks: int):
        self.buckets: dict[int, list[int]] = {}
        self.loaded: dict[int, np.ndarray] = {}  # what buckets held from the start
        self.words = [[0] * ((ranks >> 6 * (k + 1)) + 1) for k in range(3)]

    def _mark(self, rank: int) -> None:
        for level in self.words:
            level[rank >> 6] |= 1 << (rank & 63)
            rank >>= 6

    def load(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Fills the empty queue."""
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        starts = np.flatnonzero(np.concatenate(([True], ranks[1:] != ranks[:-1]))) if len(ranks) else np.zeros(0, np.int64)
        for rank, own in zip(ranks[starts].tolist(), np.split(positions, starts[1:]) if len(starts) else [], strict=True):
            self.loaded[rank] = own
            self._mark(rank)

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [position]
            self._mark(rank)
        else:
            bucket.append(position)

    def first(self) -> int:
        """The lowest rank that has a bucket, or -1."""
        top = next((k for k, word in enumerate(self.words[2]) if word), -1)
        if top < 0:
            return -1
        for level in reversed(self.words):
            word = level[top]
            top = top << 6 | (word & -word).bit_length() - 1
        return top

    def clear(self, rank: int) -> tuple[np.ndarray | None, list[int]]:
        """Empties a bucket: what it held from the start, and what was pushed."""
        out = self.loaded.pop(rank, None), self.buckets.pop(rank, [])
        for level in self.words:
            level[rank >> 6] &= ~(1 << (rank & 63))
            if level[rank >> 6]:
                break
            rank >>= 6
        return out


class Vocabulary:
    """Ranks of byte strings, and the rank of every pair of tokens whose concatenation has one."""

    def __init__(self, blob: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in blob.splitlines() if line)}
        self.tokens: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.single = np.full(256, NONE, np.int64)
        self.pairs: dict[int, int] = {}
        for token, rank in self.ranks.items():
            if len(token) == 1:
                self.single[token[0]] = rank
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    self.pairs[a << 32 | b] = rank
        if (self.single == NONE).any():
            raise ValueError("the vocabulary lacks single bytes")
        self.keys = np.fromiter(sorted(self.pairs), np.int64, len(self.pairs))
        self.values = np.array([self.pairs[k] for k in self.keys.tolist()], np.int64)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], NONE)


def merge_long(vocabulary: Vocabulary, piece: bytes) -> list[int]:
    """Ids of one pre-token of any length."""
    pairs, n = vocabulary.pairs, len(piece)
    symbols = vocabulary.single[np.frombuffer(piece, np.uint8)].tolist()
    after, before = [*range(1, n), -1], [*range(-1, n - 1)]
    rank = [pairs.get(symbols[k] << 32 | symbols[k + 1], NONE) for k in range(n - 1)] + [NONE]
    queue = RankQueue(len(vocabulary.tokens))
    for k, r in enumerate(rank):
        if r != NONE:
            queue.push(r, k)
    while (r := queue.first()) >= 0:
        _, bucket = queue.clear(r)
        heapq.heapify(bucket)
        while bucket:
            p = heapq.heappop(bucket)
            if rank[p] != r:
                continue
            q = after[p]
            symbols[p], rank[q] = r, NONE
            after[p] = n2 = after[q]
            symbols[q] = -1
            lower = False
            if n2 >= 0:
                before[n2] = p
                rank[p] = pairs.get(r << 32 | symbols[n2], NONE)
                if rank[p] != NONE:
                    queue.push(rank[p], p)
                    lower = rank[p] < r
            else:
                rank[p] = NONE
            if (left := before[p]) >= 0:
                rank[left] = pairs.get(symbols[left] << 32 | r, NONE)
                if rank[left] != NONE:
                    queue.push(rank[left], left)
                    lower = lower or rank[left] < r
            if lower:  # a merge of an earlier rank became possible: it goes first
                for p in bucket:
                    queue.push(r, p)
                break
    return [s for s in symbols if s >= 0]


def merge_many(vocabulary: Vocabulary, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the pre-tokens laid end to end, and where each begins (one more entry than pieces)."""
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    at = np.zeros(len(pieces) + 1, np.int64)
    np.cumsum(lengths, out=at[1:])
    symbols = vocabulary.single[np.frombuffer(b"".join(pieces), np.uint8)]
    n = len(symbols)
    piece = np.repeat(np.arange(len(pieces)), lengths)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    after[at[1:][lengths > 0] - 1] = -1
    before[at[:-1][lengths > 0]] = -1
    rank = np.full(n, NONE, np.int64)
    inner = np.flatnonzero(after >= 0)
    rank[inner] = vocabulary.pair_ranks(symbols[inner], symbols[inner + 1])
    queue = RankQueue(len(vocabulary.tokens))
    live = np.flatnonzero(rank != NONE)
    queue.load(rank[live], live)
    while (r := queue.first()) >= 0:
        first, pushed = queue.clear(r)
        p = np.array(pushed, np.int64) if first is None else np.concatenate((first, pushed)) if pushed else first
        p = p[rank[p] == r]
        if not len(p):
            continue
        if len(p) > 1:
            p.sort()
            own = piece[p]
            first = np.ones(len(p), bool)
            first[1:] = (own[1:] != own[:-1])
            again = p[~first & np.concatenate(([False], p[1:] != p[:-1]))]
            p = p[first]
            for x in again.tolist():
                queue.push(r, x)
        q = after[p]
        symbols[p], rank[q], symbols[q] = r, NONE, -1
        far = after[q]
        after[p] = far
        right = far >= 0
        before[far[right]] = p[right]
        rank[p] = NONE
        a = p[right]
        rank[a] = vocabulary.pair_ranks(symbols[a], symbols[far[right]])
        left = before[p]
        left = left[left >= 0]
        rank[left] = vocabulary.pair_ranks(symbols[left], symbols[after[left]])
        fresh = np.concatenate((a, left))
        got = rank[fresh]
        fresh = fresh[got != NONE]
        for x, y in zip(rank[fresh].tolist(), fresh.tolist(), strict=True):
            queue.push(x, y)
    stays = symbols >= 0
    total = np.zeros(n + 1, np.int64)
    np.cumsum(stays, out=total[1:])
    return symbols[stays], total[at]


class _Recent(dict):
    """A dictionary of at most about ``limit`` bytes: two generations, of which the older is forgotten."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.old, self.size = limit // 2, {}, 0

    def missing(self, keys: list) -> list:
        """The keys that aren't known; known ones are of the younger generation then."""
        new = [k for k in keys if k not in self]
        again = [k for k in new if k in self.old]
        if again:
            self.put(again, [self.old.pop(k) for k in again])
            new = [k for k in new if k not in self]
        return new

    def put(self, keys: list, values: list[bytes]) -> None:
        self.update(zip(keys, values, strict=True))
        self.size += sum(map(len, keys)) + sum(map(len, values)) + ENTRY * len(keys)

    def settle(self, new: list) -> None:
        """After a use: drops long keys among ``new``, and the older generation if the younger is full."""
        for k in new:
            if len(k) > KEPT:
                self.size -= len(k) + len(self.pop(k)) + ENTRY
        if self.size > self.limit:
            self.old = dict(self)
            self.clear()
            self.size = 0


def _is_white(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes that begin, and that end, a character of white space."""
    begins = _WHITE_BYTE[data]
    ends = begins.copy()
    if len(data) > 2 and _WHITE_LEAD[data].any():
        two = np.flatnonzero((data[:-1] == 0xC2) & ((data[1:] == 0x85) | (data[1:] == 0xA0)))
        code = data[:-2].astype(np.int32) << 16 | data[1:-1].astype(np.int32) << 8 | data[2:]
        three = np.flatnonzero(np.isin(code, _WHITE_THREE))
        begins[two], ends[two + 1], begins[three], ends[three + 2] = True, True, True, True
    elif len(data) == 2 and data[0] == 0xC2 and data[1] in (0x85, 0xA0):
        begins[0] = ends[1] = True
    return begins, ends


class Encoder:
    """Encodes blocks of texts; remembers the ids of chunks and of pre-tokens, each up to CACHE bytes.

    The pattern never joins a character to the space after it. So texts are cut before single spaces, and before and
    after single line ends, and each distinct chunk of a segment is encoded once; the cuts, and which chunks are equal,
    are found in numpy.
    """

    def __init__(self, blob: bytes, pattern: str):
        self.vocabulary = Vocabulary(blob)
        self.split_spaces = pattern == SPACE_SAFE
        exact = pattern.replace(r"[^\s", f"[^{_WHITE}").replace(r"\s", f"[{_WHITE}]").replace(r"\S", f"[^{_WHITE}]")
        self.match = regex.compile(exact)
        self.forget()

    def forget(self) -> None:
        """Frees what was remembered."""
        self.chunks, self.pieces = _Recent(CACHE), _Recent(CACHE)

    def _merge(self, wanted: set[str]) -> list[str]:
        """Adds the int32 ids of pre-tokens to self.pieces; returns the new ones."""
        new = self.pieces.missing(list(wanted))
        raws = [p.encode("utf-8", "surrogateescape") for p in new]
        rank = self.vocabulary.ranks.get
        ids = [None if r is None else r.to_bytes(4, sys.byteorder) for r in map(rank, raws)]
        queue = []
        for k, (raw, known) in enumerate(zip(raws, ids, strict=True)):
            if known is None and len(raw) > LONG:
                ids[k] = np.array(merge_long(self.vocabulary, raw), np.int32).tobytes()
            elif known is None:
                queue.append(k)
        ends = np.cumsum(np.fromiter((len(raws[k]) for k in queue), np.int64, len(queue)))
        for part in np.split(np.array(queue, np.int64), np.flatnonzero(np.diff(ends // MERGE_BYTES)) + 1):
            merged, at = merge_many(self.vocabulary, [raws[k] for k in part.tolist()])
            flat, at = merged.astype(np.int32).tobytes(), (at * 4).tolist()
            for j, k in enumerate(part.tolist()):
                ids[k] = flat[at[j] : at[j + 1]]
        self.pieces.put(new, ids)
        return new

    def _ids(self, chunks: list[bytes]) -> dict[bytes, bytes]:
        """int32 ids by chunk."""
        new = self.chunks.missing(chunks)
        match = self.match.findall
        found = [match(c.decode("utf-8", "surrogateescape")) for c in new]
        pieces = self._merge(set(itertools.chain.from_iterable(found)))
        look = self.pieces.__getitem__
        self.chunks.put(new, [look(ps[0]) if len(ps) == 1 else b"".join(map(look, ps)) for ps in found])
        self.pieces.settle(pieces)
        out = dict(zip(chunks, map(self.chunks.__getitem__, chunks), strict=True))
        self.chunks.settle(new)
        return out

    def _cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where chunks begin: rows, and places that no match crosses. A neighbour in another row does no harm: white at
        the edge of a text is a match of its own, or the start of one."""
        marked = np.zeros(len(data) + 1, bool)
        marked[offsets] = True
        for a in range(0, len(data) if self.split_spaces else 0, SEGMENT):
            low, high = max(0, a - 4), min(len(data), a + SEGMENT + 4)
            part = data[low:high]
            begins, ends = _is_white(part)
            lone = np.zeros(len(part), bool)  # white with no white on either side
            lone[1:-1] = ~ends[:-2] & ~begins[2:]
            line = lone & (part == 10)
            marked[low:high] |= line | lone & (part == 32)
            marked[low + 1 : high] |= line[:-1]
        marked[-1] = False
        return np.flatnonzero(marked)

    def encode_block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (int32) of the rows' texts (UTF-8) end to end, and where each row's begin (one more entry than rows)."""
        cuts = self._cuts(data, offsets)
        bounds = np.append(cuts, len(data))
        counts, out = np.zeros(len(cuts), np.int64), []
        first = 0
        while first < len(cuts):
            begin, found = first, []
            while first < len(cuts) and bounds[first] - bounds[begin] < GROUP:
                last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + SEGMENT, "right")) - 1)
                found.append((first, last, *_distinct(data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first])))
                first = last
            ids = self._ids(list(set().union(*(distinct for _, _, distinct, _ in found))))
            for a, b, distinct, which in found:
                own = list(map(ids.__getitem__, distinct))
                counts[a:b] = (np.fromiter(map(len, own), np.int64, len(own)) // 4)[which]
                out.append(b"".join(map(own.__getitem__, which.tolist())))
        total = np.concatenate(([0], np.cumsum(counts)))
        return np.frombuffer(b"".join(out) if len(out) != 1 else out[0], np.int32), total[np.searchsorted(cuts, offsets)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """:meth:`encode_block` of a list of texts."""
        raws = [t.encode("utf-8", "surrogateescape") for t in texts]
        return self.encode_block(np.frombuffer(b"".join(raws), np.uint8), np.concatenate(([0], np.cumsum(list(map(len, raws))))).astype(np.int64))


def _distinct(data: np.ndarray, at: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct spans that ``data`` is cut into at ``at``, and which one each span is."""
    sizes = np.diff(at)
    _, first, which = np.unique(kernel.span_hash(data, at[:-1], at[1:]), return_index=True, return_inverse=True)
    raw = data.tobytes()
    same = first[which]
    if np.array_equal(sizes[same], sizes) and np.array_equal(data[np.repeat(at[same] - at[:-1], sizes) + np.arange(len(data))], data):
        return [raw[a:b] for a, b in zip(at[first].tolist(), at[first + 1].tolist(), strict=True)], which
    codes: dict[bytes, int] = {}  # two spans of one hash
    which = np.array([codes.setdefault(raw[a:b], len(codes)) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], np.int64)
    return list(codes), which


class Decoder:
    """Bytes and decimal digits of ids, by Arrow's take."""

    def __init__(self, blob: bytes):
        ranks = {int(b): base64.b64decode(a) for a, b in (line.split() for line in blob.splitlines() if line)}
        self.tokens = pa.array([ranks.get(k, b"") for k in range(max(ranks) + 1)], pa.large_binary())
        self.digits = pa.array([b"%d," % k for k in range(len(self.tokens))], pa.large_binary())

    @staticmethod
    def _taken(values: pa.Array, ids: pa.Array | np.ndarray) -> tuple[np.ndarray, pa.Buffer]:
        """Where each id's bytes begin (one more entry than ids), and the bytes."""
        raw = values.take(ids if isinstance(ids, pa.Array) else pa.array(ids))
        return np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int64), raw.buffers()[2] or pa.py_buffer(b"")

    def decode(self, lists: pa.Array) -> Iterator[tuple[int, int, pa.Array]]:
        """(first row, end row, bytes by row) of an array of lists of ids, in blocks of about BLOCK ids. A null list gives no bytes."""
        at = np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))).astype(np.int64)
        row = 0
        while row < len(lists):
            end = max(row + 1, int(np.searchsorted(at, at[row] + BLOCK, "right")) - 1)
            ends, data = self._taken(self.tokens, lists.slice(row, end - row).flatten())
            out = pa.Array.from_buffers(pa.large_binary(), end - row, [None, pa.py_buffer(np.ascontiguousarray(ends[at[row : end + 1] - at[row]])), data])
            yield row, end, out.cast(pa.binary())
            row = end

    def digests(self, ids: np.ndarray, at: np.ndarray) -> tuple[list[str], list[str]]:
        """SHA-256 of each row's ids, in decimal and comma-joined, and of its decoded bytes; by blocks of ids."""
        out: tuple[list[str], list[str]] = ([], [])
        row = 0
        while row < len(at) - 1:
            end = max(row + 1, int(np.searchsorted(at, at[row] + BLOCK, "right")) - 1)
            end = min(end, len(at) - 1)
            hashes = [(hashlib.sha256(), hashlib.sha256()) for _ in range(row, end)]
            for a in range(int(at[row]), int(at[end]), BLOCK):
                b = min(a + BLOCK, int(at[end]))  # more than one block only where a row is longer
                for which, values in enumerate((self.digits, self.tokens)):
                    ends, data = self._taken(values, ids[a:b])
                    view = memoryview(data)
                    for k in range(row, end):
                        x, y = max(int(at[k]), a), min(int(at[k + 1]), b)
                        if x < y:
                            stop = int(ends[y - a]) - (which == 0 and y == int(at[k + 1]))  # without the last comma
                            hashes[k - row][which].update(view[int(ends[x - a]) : stop])
            for which in (0, 1):
                out[which].extend(h[which].hexdigest() for h in hashes)
            row = end
        return out


_CODERS: dict[bytes, tuple[Encoder, Decoder]] = {}


def _coders(blob: bytes, pattern: str) -> tuple[Encoder, Decoder]:
    """A worker's coders: only the vocabulary outlives a partition."""
    key = hashlib.sha256(blob + b"\0" + pattern.encode()).digest()
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = Encoder(blob, pattern), Decoder(blob)
    return _CODERS[key]


def _with(docs: DataFrame, added: list[T.StructField], carry: list[str] | None) -> tuple[list[str], T.StructType]:
    names = {f.name for f in added}
    keep = [c for c in (docs.columns if carry is None else carry) if c.lower() not in names]
    return keep, T.StructType([*[docs.schema[c] for c in keep], *added])


def _vocabulary(spark: SparkSession, path: str) -> Broadcast:
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())  # a vocabulary file: under 2 MB


IDS = T.StructField("ids", T.ArrayType(T.IntegerType()))
DIGESTS = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", carry: list[str] | None = None, ids: bool = True, digests: bool = False) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all by default) with the text's tokens under the rank file at ``path`` (read by the driver).

    ``ids`` adds the array ``ids``; ``digests`` adds ``n_tokens``, ``ids_sha256`` (of the decimal ids, comma-joined) and
    ``decoded_sha256``, for which the same worker decodes the ids again.
    """
    if not (ids or digests):
        raise ValueError("neither ids nor digests are wanted")
    shared = _vocabulary(docs.sparkSession, path)
    keep, schema = _with(docs, [*([IDS] if ids else []), *(DIGESTS if digests else [])], carry)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _coders(shared.value, pattern)
        try:
            for batch in batches:
                for a, b, offsets, data in kernel.slices(batch, schema.names[-1], GROUP):
                    part = batch.slice(a, b - a)
                    found, at = encoder.encode_block(data, offsets)
                    new: list[pa.Array] = []
                    if ids:
                        new.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(found)))
                    if digests:
                        new += [pa.array(np.diff(at)), *map(pa.array, decoder.digests(found, at))]
                    yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *new], names=schema.names)
        finally:
            encoder.forget()

    return docs.select(*[docs[c] for c in keep], docs[text].alias(schema.names[-1])).mapInArrow(kernel.tidied(run), schema)


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded`` (binary), the bytes of its tokens; ids without a token give no bytes."""
    shared = _vocabulary(encoded.sparkSession, path)
    keep, schema = _with(encoded, [T.StructField("decoded", T.BinaryType())], None)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in batches:
            for a, b, found in decoder.decode(batch.column(len(keep))):
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns[: len(keep)], found], names=[*keep, "decoded"])

    return encoded.select(*[encoded[c] for c in keep], encoded[ids].alias("decoded")).mapInArrow(kernel.tidied(run), schema)

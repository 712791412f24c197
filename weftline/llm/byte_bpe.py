"""Byte-level BPE encoding and decoding.

Pre-tokens are the matches of a pattern. A minimal perfect hash resolves a pre-token that is
itself in the vocabulary; a miss is merged by rank with a heap over linked bytes, in
O(n log n) for a pre-token of n bytes. The hash table is built once on the driver and
broadcast; its size is that of the vocabulary. Workers keep a bounded cache of pre-tokens.

Defined cases: a null text is encoded as an empty one, and null ids decode to no bytes;
special tokens are ordinary text; texts of any length are encoded whole; rows repeat as they
come; other columns pass unchanged, and one that has the output's name is replaced.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import pretokens

#: The largest vocabulary that is broadcast.
MAX_VOCABULARY = 2_000_000
#: Entries of a worker's cache; longer pre-tokens than CACHED_CHARS aren't kept.
CACHE_ENTRIES = 400_000
CACHED_CHARS = 48
#: Rows of a result batch.
CHUNK = 200
_BITS = (1 << 64) - 1
_MIX = 0x9E3779B97F4A7C15


class PerfectHash:
    """Minimal perfect hash of byte strings to ids: hash, displace, compare.

    Buckets of keys get, largest first, the displacement that sends their keys to free slots;
    a bucket of one key names its slot outright.
    """

    def __init__(self, ids: dict[bytes, int]):
        if len(ids) > MAX_VOCABULARY:
            raise ValueError(f"{len(ids)} entries; a broadcast vocabulary holds {MAX_VOCABULARY}")
        self.n = len(ids)
        self.buckets = self.n // 4 + 1
        self.longest = max(map(len, ids), default=0)
        members: list[list[tuple[int, bytes]]] = [[] for _ in range(self.buckets)]
        for key in ids:
            h = xxhash.xxh3_64_intdigest(key)
            members[h % self.buckets].append((h, key))
        shifts, slots = [0] * self.buckets, [None] * self.n
        order = sorted(range(self.buckets), key=lambda b: -len(members[b]))
        free = 0
        for b in order:
            if len(members[b]) == 1:
                while slots[free] is not None:
                    free += 1
                shifts[b], slots[free] = -free - 1, members[b][0][1]
            elif members[b]:
                shift = 0
                while True:
                    at = [self._slot(h, shift) for h, _ in members[b]]
                    if len(set(at)) == len(at) and all(slots[a] is None for a in at):
                        break
                    shift += 1
                shifts[b] = shift
                for a, (_, key) in zip(at, members[b], strict=True):
                    slots[a] = key
        self.shifts = np.array(shifts, np.int32)
        self.ids = np.array([ids[k] for k in slots], np.int32)
        self.ends = np.cumsum([0, *map(len, slots)]).astype(np.int64)
        self.blob = b"".join(slots)

    def _slot(self, h: int, shift: int) -> int:
        return (((h ^ shift * _MIX) * (2 * shift + _MIX) & _BITS) >> 32) * self.n >> 32

    def opened(self) -> PerfectHash:
        """This table with plain lists beside the arrays, which single lookups read faster."""
        self._shifts, self._ends, self._ids = self.shifts.tolist(), self.ends.tolist(), self.ids.tolist()
        return self

    def get(self, key: bytes) -> int | None:
        h = xxhash.xxh3_64_intdigest(key)
        shift = self._shifts[h % self.buckets]
        at = -shift - 1 if shift < 0 else self._slot(h, shift)
        return self._ids[at] if self.blob[self._ends[at] : self._ends[at + 1]] == key else None

    def items(self) -> dict[bytes, int]:
        """The table as a dict, for the pairs inside a pre-token that isn't in the vocabulary."""
        ends = self.ends.tolist()
        return {self.blob[a:b]: i for a, b, i in zip(ends, ends[1:], self.ids.tolist(), strict=False)}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of ``piece`` by merging the pair of lowest rank, leftmost first.

    Bytes are linked by the ends of their tokens; a heap holds the pairs that may merge, and an
    entry is stale once one of its pair has been merged.
    """
    n, rank_of = len(piece), ranks.get
    bits = n.bit_length() + 1
    mask, both = (1 << bits) - 1, 2 * bits
    end, before = [*range(1, n + 2)], [*range(-1, n)]
    # An entry is one number: rank, then left byte, then end, so the lowest rank and then the leftmost pair comes first.
    heap = [r << both | i << bits | i + 2 for i in range(n - 1) if (r := rank_of(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        entry = pop(heap)
        i, stop = entry >> bits & mask, entry & mask
        j = end[i]
        if not j or j >= n or end[j] != stop:
            continue
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
            last = end[stop]
            if (r := rank_of(piece[i:last])) is not None:
                push(heap, r << both | i << bits | last)
        if i:
            first = before[i]
            if (r := rank_of(piece[first:stop])) is not None:
                push(heap, r << both | first << bits | stop)
    found, i = [], 0
    while i < n:
        if (token := rank_of(piece[i : end[i]])) is None:
            raise ValueError(f"the vocabulary lacks the byte {piece[i : end[i]]!r}")
        found.append(token)
        i = end[i]
    return found


class Pieces(dict):
    """Bounded cache from pre-token to its ids as little-endian 32-bit integers."""

    def __init__(self, ids_of: Callable[[str], list[int]]):
        super().__init__()
        self.ids_of = ids_of

    def __missing__(self, word: str) -> bytes:
        found = array("i", self.ids_of(word)).tobytes()
        if len(word) <= CACHED_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[word] = found
        return found


class Encoder:
    """One worker's state: the shared table, the pattern and the cache."""

    def __init__(self, table: PerfectHash, pattern: str):
        self.table, self.find = table.opened(), pretokens.finder(pattern)
        self.ranks = table.items()
        self.pieces = Pieces(self._piece)

    def _piece(self, word: str) -> list[int]:
        piece = word.encode()
        token = self.table.get(piece)
        return [token] if token is not None else merge(piece, self.ranks)

    def encode_bytes(self, text: str | None) -> bytes:
        """The text's ids as little-endian 32-bit integers."""
        return b"".join(map(self.pieces.__getitem__, self.find(text or "")))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<i4").tolist()


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


_OPEN: dict[str, object] = {}


def _once(kind: str, shared, make: Callable):
    """What ``make`` gives for this broadcast value, kept in the worker for later tasks."""
    key = f"{kind}:{shared.value[0]}"
    if key not in _OPEN:
        for old in [k for k in _OPEN if k.startswith(kind)]:
            del _OPEN[old]
        _OPEN[key] = make(*shared.value[1:])
    return _OPEN[key]


def _named(ranks_path: str, pattern: str = "") -> str:
    with open(ranks_path, "rb") as f:
        return xxhash.xxh3_128_hexdigest(f.read() + pattern.encode())


def _with_columns(df: DataFrame, steps: list[tuple[str, str, T.DataType, Callable[[], Callable]]]) -> DataFrame:
    """``df`` with a column for each step (source, name, type, maker), one after the other in one pass.

    Arrow batches of CHUNK rows, so that a task holds few results at a time; one pass for all
    steps, so that it takes one worker.
    """
    keep = [c for c in df.columns if c not in [name for _, name, _, _ in steps]]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(name, kind) for _, name, kind, _ in steps])
    columns = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        makers = [(source, name, worker()) for source, name, _, worker in steps]
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                have = dict(zip(columns, batch.slice(start, CHUNK).columns, strict=True))
                for source, name, make in makers:
                    have[name] = make(have[source])
                yield pa.RecordBatch.from_arrays([have[c] for c in schema.names], names=schema.names)

    return df.mapInArrow(run, schema)


def _encoding(spark: SparkSession, ranks_path: str, pattern: str, text: str, ids: str) -> tuple:
    shared = spark.sparkContext.broadcast((_named(ranks_path, pattern), PerfectHash(read_ranks(ranks_path)), pattern))

    def worker() -> Callable:
        pieces = _once("encoder", shared, Encoder).encode_bytes

        def make(texts: pa.Array) -> pa.Array:
            found = [pieces(t) for t in texts.to_pylist()]
            offsets = np.cumsum([0, *map(len, found)]) // 4
            return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(found), "<i4"), pa.int32()))

        return make

    return text, ids, T.ArrayType(T.IntegerType()), worker


def _decoding(spark: SparkSession, ranks_path: str, ids: str, decoded: str) -> tuple:
    shared = spark.sparkContext.broadcast((_named(ranks_path), {i: b for b, i in read_ranks(ranks_path).items()}))

    def worker() -> Callable:
        token = _once("decoder", shared, dict).__getitem__

        def make(rows: pa.Array) -> pa.Array:
            return pa.array([b"".join(map(token, r.values.to_numpy().tolist())) if r.is_valid else b"" for r in rows], pa.binary())

        return make

    return ids, decoded, T.BinaryType(), worker


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the ids of each whole text, array<int>."""
    return _with_columns(df, [_encoding(df.sparkSession, ranks_path, pattern, text, ids)])


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the bytes that the ids stand for."""
    return _with_columns(df, [_decoding(df.sparkSession, ranks_path, ids, decoded)])


def round_trip(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the ids of each whole text and the bytes that these stand for, in one pass."""
    spark = df.sparkSession
    return _with_columns(df, [_encoding(spark, ranks_path, pattern, text, ids), _decoding(spark, ranks_path, ids, decoded)])

"""Token ids in compressed files: one wavelet matrix per shard.

A shard is a run of whole documents in doc_id order. Its file is a Parquet file of one row that
holds the wavelet matrix of the shard's ids: a bit-plane for
each bit of an id, most significant first, with the number of ones before each block of
BLOCK bits. From that file alone ``Wavelet`` reads the id at a position, counts an id and finds
its occurrences; ids need about bits/8 bytes each. Spark's committer writes the files, so a lost
task leaves none behind, and any store that Spark reads will do.

Defined cases: a null text is empty, so its document is the end id alone; documents of one
doc_id follow each other in the order of their texts; a null doc_id comes first; an empty table
gives a store without files, and reading it gives no rows; a document longer than a shard has
a shard of its own; other columns aren't stored.
"""

from __future__ import annotations

import struct
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, pretokens

#: Bits between stored ranks, and tokens after which a shard is closed.
BLOCK, SHARD_TOKENS = 512, 1 << 21
#: Entries of a worker's cache of words; longer ones than CACHED_CHARS aren't kept.
CACHE_ENTRIES, CACHED_CHARS = 800_000, 48
#: Marks that make a pre-token of their own after a word.
END_MARKS = frozenset(".,;:!?)")
#: Bytes of texts that are encoded at a time, one text at least; documents that are read back at a time.
CHUNK_BYTES, CHUNK = 8 << 20, 200


class Wavelet:
    """Wavelet matrix over ids below 2**bits: bit-planes with rank and select."""

    def __init__(self, n: int, bits: int, planes: list[bytes], ranks: list[bytes], zeros: list[int]):
        self.n, self.bits, self.zeros = n, bits, zeros
        self.planes = [np.frombuffer(p, np.uint8) for p in planes]
        self.ranks = [np.frombuffer(r, "<u4") for r in ranks]

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> Wavelet:
        planes, ranks, zeros = [], [], []
        for k in range(bits - 1, -1, -1):
            ones = (ids >> k & 1).astype(bool)
            planes.append(packed := np.packbits(ones, bitorder="little"))
            pad = np.zeros(-len(packed) % (BLOCK // 8), np.uint8)
            per_block = np.bitwise_count(np.concatenate([packed, pad]).view("<u8")).reshape(-1, BLOCK // 64).sum(1, dtype=np.uint32)
            ranks.append(np.concatenate([[0], np.cumsum(per_block)]).astype("<u4"))
            low = ids.take(np.flatnonzero(~ones))  # positions and a take: several times as fast as a mask
            zeros.append(len(low))
            ids = np.concatenate([low, ids.take(np.flatnonzero(ones))])
        return cls(len(ids), bits, [p.tobytes() for p in planes], [r.tobytes() for r in ranks], zeros)

    def _rank1(self, k: int, i: int) -> int:
        """Ones among the first i bits of plane k."""
        block = i // BLOCK
        part = np.unpackbits(self.planes[k][block * BLOCK // 8 : (i + 7) // 8], bitorder="little")[: i - block * BLOCK]
        return int(self.ranks[k][block]) + int(part.sum())

    def _select(self, k: int, one: bool, nth: int) -> int:
        """Position of the nth (from 0) one or zero of plane k."""
        starts = np.arange(len(self.ranks[k])) * BLOCK
        before = self.ranks[k] if one else np.minimum(starts, self.n) - self.ranks[k]
        block = int(np.searchsorted(before, nth, "right")) - 1
        part = np.unpackbits(self.planes[k][block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")[: self.n - block * BLOCK]
        return block * BLOCK + int(np.flatnonzero(part == one)[nth - int(before[block])])

    def access(self, i: int) -> int:
        value = 0
        for k in range(self.bits):
            ones = self._rank1(k, i)
            bit = self._rank1(k, i + 1) - ones
            i = self.zeros[k] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, value: int, upto: int) -> tuple[int, int]:
        lo, hi = 0, upto
        for k in range(self.bits):
            a, b = self._rank1(k, lo), self._rank1(k, hi)
            lo, hi = (self.zeros[k] + a, self.zeros[k] + b) if value >> (self.bits - 1 - k) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, value: int, upto: int | None = None) -> int:
        """Occurrences of ``value`` among the first ``upto`` ids."""
        if value < 0 or value >> self.bits:
            return 0
        lo, hi = self._range(value, self.n if upto is None else upto)
        return hi - lo

    def locate(self, value: int, nth: int) -> int:
        """Position of the nth (from 0) occurrence of ``value``."""
        if not 0 <= nth < self.count(value):
            raise IndexError(nth)
        i = self._range(value, self.n)[0] + nth
        for k in range(self.bits - 1, -1, -1):
            one = bool(value >> (self.bits - 1 - k) & 1)
            i = self._select(k, one, i - self.zeros[k] if one else i)
        return i

    def all(self) -> np.ndarray:
        """Every id in order, plane by plane from the last."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        values = np.zeros(self.n, kind)
        for k in range(self.bits - 1, -1, -1):
            ones = np.unpackbits(self.planes[k], count=self.n, bitorder="little").view(bool)
            above = np.empty(self.n, kind)
            above[np.flatnonzero(~ones)] = values[: self.zeros[k]]
            above[np.flatnonzero(ones)] = values[self.zeros[k] :] | kind(1 << (self.bits - 1 - k))
            values = above
        return values


@lru_cache(1 << 16)
def _settled(char: str) -> bool:
    """Whether the character's class is the same in every Unicode version since 3.2."""
    old = unicodedata.ucd_3_2_0.category(char)
    return old != "Cn" and old[0] == unicodedata.category(char)[0]


def chunks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of CHUNK_BYTES or less, or of one text."""
    upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = done = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(upto, done + CHUNK_BYTES, "right")))
        yield at, to
        at, done = to, int(upto[to - 1])


def _strings(values: pa.Array) -> list[str]:
    """The strings of an array without nulls, made in Arrow: several times as fast as one by one."""
    return values.to_numpy(zero_copy_only=False).tolist()


class _Cache(dict):
    """Bounded cache from a word to its ids as bytes; when it is full, the older half goes.

    A word with a mark at its end isn't kept, as its two parts are.
    """

    def __init__(self, ids_of: Callable[[str], bytes]):
        super().__init__()
        self.ids_of = ids_of

    def __missing__(self, word: str) -> bytes:
        found = self.ids_of(word)
        if word[-1:] not in END_MARKS or len(word) == 1:
            self.keep(word, found)
        return found

    def keep(self, word: str, ids: bytes) -> None:
        if len(word) <= CACHED_CHARS:
            if len(self) >= CACHE_ENTRIES:
                newer = dict(islice(self.items(), CACHE_ENTRIES // 2, None))
                self.clear()
                self.update(newer)
            self[word] = ids


def byte_characters() -> str:
    """The character that byte-level BPE writes for each byte: itself if it is printable Latin-1, else one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return "".join(chr(b) if b in printable else chr(next(rest)) for b in range(256))


class LibraryEncoder:
    """The tokenizers library behind a cache of words.

    A pre-token has the same ids wherever it stands, so the library's model encodes each new
    one once. Between two characters that aren't blanks, a single space always begins a
    pre-token; where a text has no other spaces, it is cut there, and each word with what
    adheres to it is looked up at once. A text that may hold special tokens, or characters whose
    class depends on the library's Unicode version, goes to the library whole.
    """

    def __init__(self, tokenizer: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(tokenizer)
        self.library.no_truncation()
        self.library.no_padding()
        self.tokenize = self.library.model.tokenize
        self.bits = max(1, (max(self.library.get_vocab().values())).bit_length())
        self.code = "H" if self.bits <= 16 else "I"
        self.kind = "<u2" if self.bits <= 16 else "<u4"
        self.pack = [struct.Struct(f"<{i}{self.code}").pack for i in range(12)]
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.find = pretokens.finder(pretokens.PATTERN)
        pre = self.library.pre_tokenizer
        level = pre is not None and "ByteLevel" in str(pre) and "add_prefix_space=False" in str(pre)
        self.by_parts = level and self.library.normalizer is None
        self.pieces, self.after_space = _Cache(self._piece), _Cache(self._word)
        self.uneven = f"[^\\x{{0}}-\\x{{24f}}]|^ | $| [{pretokens.BLANKS}]|[{pretokens.BLANKS}] "
        self.characters = byte_characters()

    def _piece(self, word: str) -> bytes:
        return self._tokens(word.encode().decode("latin-1").translate(self.characters))

    def _tokens(self, characters: str) -> bytes:
        ids = [t.id for t in self.tokenize(characters)]
        return self.pack[len(ids)](*ids) if len(ids) < len(self.pack) else array(self.code, ids).tobytes()

    def _word(self, word: str) -> bytes:
        """The ids of ``word``, in characters below U+0250, after a space."""
        if word.isalpha():  # one pre-token; ASCII letters stand for their own bytes
            return self._tokens(self.characters[32] + word) if word.isascii() else self._piece(" " + word)
        if word[-1:] in END_MARKS and word[:-1].isalpha():
            return self.after_space[word[:-1]] + self.pieces[word[-1]]
        parts = self.find(" " + word)
        return self._piece(parts[0]) if len(parts) == 1 else self._joined(parts)

    def _joined(self, parts: list[str]) -> bytes:
        return b"".join([self.after_space[x[1:]] if x[0] == " " and len(x) > 1 else self.pieces[x] for x in parts])

    def _whole(self, text: str, latin: bool) -> bool:
        """Whether only the library may split this text."""
        if not self.by_parts or any(s in text for s in self.special):
            return True
        return not (latin or all(map(_settled, set(text))))

    def _ids(self, text: str, latin: bool) -> bytes:
        if self._whole(text, latin):
            return array(self.code, self.library.encode(text, add_special_tokens=False).ids).tobytes()
        return self._joined(self.find(text))

    def _distinct(self, words: list[str]) -> list[bytes]:
        """The ids of each of these words after a space; one of letters, with or without a mark at its end, is worked out here at once."""
        known, marks, tokenize, pack, lead, table = self.after_space, self.pieces, self.tokenize, self.pack, self.characters[32], self.characters
        get, keep, sizes = known.get, known.keep, len(self.pack)
        found = list(map(get, words))
        for i in [i for i, ids in enumerate(found) if ids is None]:
            word, mark = words[i], b""
            if not word.isalpha():
                if word[-1:] not in END_MARKS or not word[:-1].isalpha():
                    found[i] = known[word]
                    continue
                word, mark = word[:-1], marks[word[-1]]
                if (ids := get(word)) is not None:
                    found[i] = ids + mark
                    continue
            ids = [t.id for t in tokenize(lead + word if word.isascii() else (" " + word).encode().decode("latin-1").translate(table))]
            ids = pack[len(ids)](*ids) if len(ids) < sizes else array(self.code, ids).tobytes()
            keep(word, ids)
            found[i] = ids + mark
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes of ``kind``."""
        flat, lengths = self.encode_array(pa.array(texts, pa.string()))
        upto = [0, *np.cumsum(lengths).tolist()]
        return [flat[a:b].tobytes() for a, b in zip(upto, upto[1:], strict=False)]

    def encode_array(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each text's followed by ``end`` if there is one, and how many each has.

        The words of evenly spaced Latin texts are numbered by Arrow, and only distinct ones are looked up.
        """
        even = pc.invert(pc.match_substring_regex(texts, self.uneven))
        for special in self.special:
            even = pc.and_(even, pc.invert(pc.match_substring(texts, special)))
        if not self.by_parts:
            even = pa.array([False] * len(texts))
        odd = pc.invert(even)
        words = pc.split_pattern(pc.if_else(even, texts, "") if pc.any(odd).as_py() else texts, " ")
        offsets = words.offsets.to_numpy()
        values = words.values.slice(offsets[0], offsets[-1] - offsets[0]) if len(texts) else words.values
        heads = [self._joined(self.find(w)) for w in _strings(values.take(pa.array(offsets[:-1] - offsets[0])))]
        for i, text in zip(np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist(), texts.filter(odd).to_pylist(), strict=True):
            heads[i] = self._ids(text, pretokens.is_latin(text))
        coded = values.dictionary_encode()
        distinct, codes = _strings(coded.dictionary), coded.indices.to_numpy(zero_copy_only=False)
        pieces = [*self._distinct(distinct), *heads]
        kind = np.dtype("<u4" if end is not None and end >> 16 else self.kind)
        ids = np.frombuffer(b"".join(pieces), self.kind).astype(kind, copy=False)
        ids = np.append(ids, np.array([] if end is None else [end], kind))
        sizes = np.append(np.fromiter(map(len, pieces), np.int32, len(pieces)) // np.dtype(self.kind).itemsize, np.int32(end is not None))
        starts = np.cumsum(sizes, dtype=np.int32) - sizes
        n = len(heads)
        counts = np.diff(offsets)  # words of each text, its head among them
        first = offsets[:-1] - offsets[0] + np.arange(n)  # where each text's head stands among all pieces
        last = first + counts  # and its end
        order = np.empty(len(codes) + n, np.int32)
        rows = np.ones(len(order), bool)
        rows[last] = False
        order[rows] = codes
        order[first], order[last] = len(distinct) + np.arange(n), len(pieces)
        own = sizes[order]
        upto = np.cumsum(own, dtype=np.int32)
        flat = ids[np.repeat(starts[order] - (upto - own), own) + np.arange(upto[-1] if n else 0, dtype=np.int32)]
        return flat, np.diff(upto[last], prepend=0)


_OPEN: dict[int, LibraryEncoder] = {}


def _encoder(tokenizer: str) -> LibraryEncoder:
    key = hash(tokenizer)
    if key not in _OPEN:
        _OPEN.clear()
        _OPEN[key] = LibraryEncoder(tokenizer)
    return _OPEN[key]


def _shard_schema(id_type: T.DataType) -> T.StructType:
    many = lambda t: T.ArrayType(t, False)
    return T.StructType(
        [
            T.StructField("shard", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("bits", T.IntegerType()),
            T.StructField("doc_ids", T.ArrayType(id_type, True)),
            T.StructField("lengths", many(T.LongType())),
            T.StructField("planes", many(T.BinaryType())),
            T.StructField("ranks", many(T.BinaryType())),
            T.StructField("zeros", many(T.LongType())),
        ]
    )


def write(docs: DataFrame, tokenizer_path: str, end_id: int, path: str, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode every text of ``docs`` (doc_id, text), append ``end_id``, and write the shards in ascending doc_id order.

    Documents are dealt by ranges of doc_id, so a task has a run of them; it closes a shard
    after ``shard_tokens`` ids. A task holds one shard's ids at a time.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    schema = _shard_schema(docs.schema["doc_id"].dataType)
    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    dealt = slim.repartitionByRange("doc_id").sortWithinPartitions(F.col("doc_id"), F.col("text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        bits = max(encoder.bits, int(end_id).bit_length())
        kind = "<u2" if bits <= 16 else "<u4"
        number = TaskContext.get().partitionId() << 32
        ids, lengths, parts, total = [], [], [], 0
        out = pa.schema([(f.name, t) for f, t in zip(schema, _arrow_types(schema), strict=True)])

        def closed() -> pa.RecordBatch:
            nonlocal number, total
            joined = np.concatenate(parts)
            parts.clear()
            w = Wavelet.build(joined, bits)
            row = [number, total, bits, list(ids), list(lengths), [p.tobytes() for p in w.planes], [r.tobytes() for r in w.ranks], w.zeros]
            number, total = number + 1, 0
            ids.clear()
            lengths.clear()
            return pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip(row, out, strict=True)], schema=out)

        for batch in batches:
            for at, to in chunks(batch.column(1)):
                docs, (flat, counts) = batch.column(0)[at:to].to_pylist(), encoder.encode_array(batch.column(1)[at:to], end_id)
                flat, upto = flat.astype(kind, copy=False), np.cumsum(counts)
                i = done = 0
                while i < len(docs):  # up to and with the document that fills the shard
                    j = min(len(docs), int(np.searchsorted(upto, done + shard_tokens - total)) + 1)
                    ids += docs[i:j]
                    lengths += counts[i:j].tolist()
                    parts.append(flat[done : upto[j - 1]])
                    total += int(upto[j - 1]) - done
                    i, done = j, int(upto[j - 1])
                    if total >= shard_tokens:
                        yield closed()
        if ids:
            yield closed()

    dealt.mapInArrow(pack, schema).write.option("maxRecordsPerFile", 1).option("compression", "zstd").parquet(path)


def _arrow_types(schema: T.StructType) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in schema]


def shards(spark: SparkSession, path: str, id_type: T.DataType) -> DataFrame:
    """The shard files as rows."""
    return spark.read.schema(_shard_schema(id_type)).parquet(path)


def _opened(batch: pa.RecordBatch) -> Iterator[tuple[int, list, list[int], Wavelet]]:
    for at in range(batch.num_rows):
        row = {name: batch.column(name)[at].as_py() for name in batch.schema.names}
        yield row["shard"], row["doc_ids"], row["lengths"], Wavelet(row["n_tokens"], row["bits"], row["planes"], row["ranks"], row["zeros"])


def read_documents(spark: SparkSession, path: str, id_type: T.DataType) -> DataFrame:
    """shard, doc_id, place (ids before it in its shard) and ids (little-endian 32-bit integers) of every stored document."""
    schema = T.StructType(
        [T.StructField("shard", T.LongType()), T.StructField("doc_id", id_type), T.StructField("place", T.LongType()), T.StructField("ids", T.BinaryType())]
    )
    types = _arrow_types(schema)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, docs, lengths, wavelet in _opened(batch):
                ids, places = wavelet.all(), np.cumsum([0, *lengths])
                for at in range(0, len(docs), CHUNK):
                    to = min(at + CHUNK, len(docs))
                    flat = ids[places[at] : places[to]].astype("<u4")
                    offsets = ((places[at : to + 1] - places[at]) * 4).astype(np.int32)
                    binary = pa.Array.from_buffers(pa.binary(), to - at, [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
                    cols = [pa.array([shard] * (to - at), types[0]), pa.array(docs[at:to], types[1]), pa.array(places[at:to], types[2]), binary]
                    yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return shards(spark, path, id_type).mapInArrow(unpack, schema)


def shard_starts(spark: SparkSession, path: str, id_type: T.DataType) -> DataFrame:
    """shard and the number of ids in all shards before it; one row per file, read from two columns.

    Each writing task's shards are summed first, so that no task gets a row for every shard.
    """
    sizes = shards(spark, path, id_type).select("shard", "n_tokens", F.shiftright("shard", 32).alias("task"))
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    tasks = sizes.groupBy("task").agg(F.sum("n_tokens").alias("n_tokens")).select("task", before(Window.orderBy("task")).alias("task_start"))
    own = sizes.withColumn("own_start", before(Window.partitionBy("task").orderBy("shard")))
    return own.join(F.broadcast(tasks), "task").select("shard", (F.col("task_start") + F.col("own_start")).alias("shard_start"))


def occurrences(spark: SparkSession, path: str, id_type: T.DataType, token: int) -> DataFrame:
    """shard and n, the times that ``token`` stands in it, counted on the bit-planes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, _, _, wavelet in _opened(batch):
                yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "n": pa.array([wavelet.count(token)], pa.int64())})

    return shards(spark, path, id_type).mapInArrow(count, "shard long, n long")


def stored(docs: DataFrame, tokenizer_path: str, end_id: int = 2, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the written files."""
    spark, id_type = docs.sparkSession, docs.schema["doc_id"].dataType
    path = common.scratch_dir(spark)
    write(docs, tokenizer_path, end_id, path, shard_tokens)
    starts = common.written(shard_starts(spark, path, id_type))
    read = read_documents(spark, path, id_type).select(
        "shard", "doc_id", "place", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").cast("long").alias("ids_crc32")
    )
    return read.join(common.small_or_not(starts, starts.count()), "shard").select(
        "doc_id", (F.col("shard_start") + F.col("place")).alias("start"), "n_tokens", "ids_crc32"
    )

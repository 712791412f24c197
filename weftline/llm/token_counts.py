"""Token counts by a two-tier lookup on the map side; no pre-token is ever shuffled.

Tier one is a compact hash table, broadcast once, of the lengths of frequent pre-tokens: the
vocabulary's own word-initial pieces, which its makers chose by frequency. Its size is bounded
by the vocabulary. Tier two, for what the table lacks, is the library itself behind a bounded
cache in each worker.

A pre-token is a run of spaces with what follows up to the next space. No piece of such a
vocabulary holds a space after another character, so no merge crosses that border and the
counts of a text's pre-tokens add up to the library's count of the whole text; one space at a
text's end is a pre-token too. Where a model breaks one of these conditions, each whole text goes to the library.

Defined cases: null and empty texts count 0; every other text counts as the library counts
it, of any length; rows repeat as they come; other columns pass unchanged, and those named as
an output are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import spread

#: The largest broadcast table, in entries.
MAX_TABLE = 1_000_000
#: Entries of a worker's cache; longer pre-tokens than CACHED_CHARS aren't kept.
CACHE_ENTRIES = 200_000
CACHED_CHARS = 48
SPACE = "▁"
_PRE_TOKEN = re.compile(r" +[^ ]*")


class LengthTable:
    """Open addressing over flat arrays: pre-token bytes to token count, keys compared in full."""

    def __init__(self, lengths: dict[str, int]):
        if len(lengths) > MAX_TABLE:
            raise ValueError(f"{len(lengths)} entries; a broadcast table holds {MAX_TABLE}")
        keys = [k.encode() for k in lengths]
        self.blob = b"".join(keys)
        self.ends = np.cumsum([0, *map(len, keys)]).astype(np.uint32)
        self.counts = np.fromiter(lengths.values(), np.uint32, len(keys))
        self.mask = (1 << max(4, (2 * len(keys)).bit_length())) - 1
        self.slots = np.full(self.mask + 1, -1, np.int32)
        for i, key in enumerate(keys):
            at = xxhash.xxh3_64_intdigest(key) & self.mask
            while self.slots[at] >= 0:
                at = (at + 1) & self.mask
            self.slots[at] = i

    def get(self, word: str) -> int | None:
        key = word.encode()
        at = xxhash.xxh3_64_intdigest(key) & self.mask
        while (i := self.slots[at]) >= 0:
            if self.blob[self.ends[i] : self.ends[i + 1]] == key:
                return int(self.counts[i])
            at = (at + 1) & self.mask
        return None


def _library(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def splits_at_spaces(model: bytes) -> bool:
    """Whether the pre-tokens' counts add up to the text's count under this model."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model)
    norm = proto.normalizer_spec
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not (norm.add_dummy_prefix and norm.escape_whitespaces):
        return False
    if not proto.trainer_spec.byte_fallback or proto.trainer_spec.model_type != 2 or proto.trainer_spec.treat_whitespace_as_suffix:
        return False
    user_defined = 4
    return not any(p.type == user_defined or re.search(f"[^{SPACE}]{SPACE}", p.piece) for p in proto.pieces)


def frequent_lengths(model: bytes) -> dict[str, int]:
    """Token counts of the vocabulary's word-initial pieces; keys start with a space."""
    sp = _library(model)
    pieces = (sp.id_to_piece(i) for i in range(sp.vocab_size()))
    words = [p[1:] for p in pieces if p.startswith(SPACE) and p != SPACE and SPACE not in p[1:]]
    return {" " + w: len(ids) for w, ids in zip(words, sp.encode(words, num_threads=1), strict=True)}


class Counter:
    """One worker's state: the shared table, the library and the cache."""

    def __init__(self, model: bytes, table: LengthTable | None):
        self.sp, self.table = _library(model), table
        self.cache: dict[str, int] = {}
        # What one space at the end of a text adds; encoded alone, the library gives it a dummy prefix.
        self.last_space = len(self.sp.encode("a ", num_threads=1)) - len(self.sp.encode("a", num_threads=1))

    def _missing(self, word: str) -> int:
        if word == " ":  # only a text's last pre-token is a space alone
            return self.last_space
        n = self.table.get(word)
        return len(self.sp.encode(word[1:], num_threads=1)) if n is None else n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.table is None:
            return len(self.sp.encode(text, num_threads=1))
        words, cache = _PRE_TOKEN.findall(" " + text.replace(SPACE, " ")), self.cache
        try:
            return sum(map(cache.__getitem__, words))
        except KeyError:
            pass
        if len(cache) > CACHE_ENTRIES:
            cache.clear()
        once: dict[str, int] = {}
        for word in set(words).difference(cache):
            (cache if len(word) <= CACHED_CHARS else once)[word] = self._missing(word)
        return sum(cache[w] if w in cache else once[w] for w in words)


_OPEN: dict[int, Counter] = {}


def counter_udf(spark, model_path: str) -> Callable:
    """A vectorised function of a text column: its token count."""
    with open(model_path, "rb") as f:
        model = f.read()
    table = LengthTable(frequent_lengths(model)) if splits_at_spaces(model) else None
    shared = spark.sparkContext.broadcast((model, table))

    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model, table = shared.value
        key = hash(model)
        if key not in _OPEN:
            _OPEN.clear()
            _OPEN[key] = Counter(model, table)
        count = _OPEN[key].count
        for texts in batches:
            yield pd.Series([count(t) for t in texts], dtype="int64")

    counts.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(counts, "long")


def count_tokens(df: DataFrame, model_path: str, limit: int = 4096, text: str = "text") -> DataFrame:
    """``df`` with n_bytes (UTF-8), n_tokens and over_limit (more tokens than ``limit``); a table of fewer splits than cores is dealt out first."""
    counts = counter_udf(df.sparkSession, model_path)
    return (
        spread(df).withColumn("n_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("long"))
        .withColumn("n_tokens", counts(F.col(text)))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )

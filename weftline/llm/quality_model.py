"""Quality classifier from weak labels.

Heuristic labellers vote that a text is junk, that it is sound, or not at all. The votes of
every document are counted by pattern, and expectation-maximisation over the patterns estimates
how often each labeller votes what on junk and on sound texts (Dawid and Skene 1979), without
any true label. The patterns' posterior labels train a linear scorer over hashed character
shapes and levels of statistics, on a bounded number of documents of each side. The scorer
then judges every whole text; its weights are broadcast, BUCKETS numbers.

Defined cases: a null or empty text, or one of blanks, has no sound content: score 0, not kept;
a text of any length is read whole; equal texts get equal scores; if the votes name no junk, or
nothing but junk, the score is the posterior of the votes; an empty table gives an empty
result; other columns pass unchanged, and those named as an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .text_features import gram_buckets

#: Buckets of hashed features, sizes of shape n-grams, documents of a side that the scorer sees at most (about).
BUCKETS, SIZES, FIT_DOCUMENTS = 1 << 12, (1, 2, 3), 2000
#: Rounds of expectation-maximisation and of the scorer's training; its regularisation.
EM_ROUNDS, STEPS, DECAY = 60, 250, 1e-4
#: Words at which a text's own evidence weighs as much as the corpus.
FEW_WORDS = 15
#: A text is kept from this score on.
THRESHOLD = 0.5
CHUNK = 200
SYMBOLS = b"#*$%&|<>"

_SHAPE = np.arange(256, dtype=np.uint32)
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[0x80:] = ord("a")  # the bytes of other letters
_SHAPE[ord("0") : ord("9") + 1] = ord("0")
_SHAPE[[9, 11, 12, 13]] = 32


def statistics(text: str) -> dict[str, float]:
    """Shares that the labellers test, of a whole text."""
    data = text.encode("utf-8", "replace")
    words = data.split()
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    solid = max(1, int(counts.sum() - counts[[9, 10, 11, 12, 13, 32]].sum()))
    capitals, small = int(counts[65:91].sum()), int(counts[97:123].sum() + counts[0xC0:].sum())
    n = len(words)
    repeated = 0.0
    if n >= 4:
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
        three = h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:] * np.uint64(0x165667B19E3779F9)
        repeated = 1 - len(np.unique(three)) / len(three)
    lines = [x for x in data.split(b"\n") if x.strip()]
    return {
        "words": n,
        "symbols": int(sum(counts[c] for c in SYMBOLS)) / solid,
        "capitals": capitals / max(1, capitals + small),
        "letters": (capitals + small) / solid,
        "exclaim": int(counts[33]) / max(1, n),
        "repeated": repeated,
        "dup_lines": 1 - len(set(lines)) / len(lines) if lines else 0.0,
        "distinct": len(set(words)) / n if n else 0.0,
        "word_length": solid / max(1, n),
        "marked": sum(w[-1] in SYMBOLS for w in words) / max(1, n),
        "stops": int(counts[46] + counts[63]) / max(1, n),
    }


#: The labellers: name, when it votes junk, when it votes sound; else it abstains.
LABELLERS = (
    ("symbols", lambda s: s["symbols"] > 0.05, lambda s: False),
    ("marked words", lambda s: s["marked"] > 0.15, lambda s: False),
    ("capitals", lambda s: s["words"] >= 5 and s["capitals"] > 0.5, lambda s: False),
    ("exclamation", lambda s: s["exclaim"] > 0.25, lambda s: False),
    ("repeated windows", lambda s: s["words"] >= 20 and s["repeated"] > 0.4, lambda s: False),
    ("repeated lines", lambda s: s["words"] >= 20 and s["dup_lines"] > 0.5, lambda s: False),
    ("few distinct words", lambda s: s["words"] >= 50 and s["distinct"] < min(0.25, 12 / s["words"] ** 0.5), lambda s: False),
    ("letters", lambda s: s["words"] >= 5 and s["letters"] < 0.6, lambda s: False),
    ("word length", lambda s: s["words"] >= 20 and not 2 <= s["word_length"] <= 16, lambda s: False),
    (
        "plain prose",
        lambda s: False,
        lambda s: s["words"] >= 20 and s["symbols"] < 0.01 and s["capitals"] < 0.2 and s["exclaim"] < 0.05 and s["repeated"] < 0.1 and s["stops"] > 0.01,
    ),
)


def vote(text: str | None) -> int:
    """The labellers' votes as the digits of a number in base 3: 0 abstains, 1 junk, 2 sound."""
    s = statistics(text or "")
    return sum((1 if junk(s) else 2 if sound(s) else 0) * 3**k for k, (_, junk, sound) in enumerate(LABELLERS))


def digits(pattern: int) -> list[int]:
    return [pattern // 3**k % 3 for k in range(len(LABELLERS))]


def estimate(counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray, float]:
    """Vote rates on junk and on sound texts (labellers by votes), and the share of junk."""
    votes = np.array([digits(p) for p in counts])
    weight = np.array(list(counts.values()), float)
    weight /= weight.sum()
    onehot = (votes[:, :, None] == np.arange(3)).astype(float)
    # To begin with, a text that only junk votes speak of is junk.
    junk = np.where((votes == 1).any(1), np.where((votes == 2).any(1), 0.5, 0.95), 0.02)
    prior = np.array([[0.02, 0.02, 0.005], [0.02, 0.001, 0.02]])  # junk and sound: abstain, junk vote, sound vote
    for _ in range(EM_ROUNDS):
        share = float(np.clip(weight @ junk, 0.001, 0.6))
        rates = []
        for side, p in ((junk, prior[0]), (1 - junk, prior[1])):
            mass = np.einsum("p,plv->lv", weight * side, onehot) + p * max(0.01, float(weight @ side))
            rates.append(mass / mass.sum(1, keepdims=True))
        log = [np.log(r)[np.arange(len(LABELLERS)), votes].sum(1) for r in rates]
        odds = np.log(share) - np.log(1 - share) + log[0] - log[1]
        now = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(now - junk).max() < 1e-6:
            break
        junk = now
    return rates[0], rates[1], share


def posterior(pattern: int, model: tuple[np.ndarray, np.ndarray, float]) -> float:
    """Probability that a text of these votes is sound."""
    at = (np.arange(len(LABELLERS)), digits(pattern))
    odds = np.log(1 - model[2]) - np.log(model[2]) + np.log(model[1][at]).sum() - np.log(model[0][at]).sum()
    return float(1 / (1 + np.exp(-np.clip(odds, -30, 30))))


_LEVELS = ("symbols", "capitals", "exclaim", "repeated", "dup_lines", "marked", "letters")


def features(text: str) -> np.ndarray:
    """Hashed shape n-grams by frequency, and hashed levels of statistics."""
    codes = _SHAPE[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]
    found = np.zeros(BUCKETS, np.float32)
    for size in SIZES:
        counts = np.bincount(gram_buckets(codes, size, BUCKETS), minlength=BUCKETS).astype(np.float32)
        if total := counts.sum():
            found += np.sqrt(counts / total)
    s = statistics(text)
    for name in _LEVELS:
        for level in range(int(min(1.0, s[name]) * 10) + 1):
            found[xxhash.xxh32_intdigest(f"{name} {level}") % BUCKETS] += 0.3
    return found


def train(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights, the last one an offset, of a logistic scorer for soft labels; both sides weigh the same."""
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], 1)
    balance = np.where(y >= 0.5, 0.5 / max(1, (y >= 0.5).sum()), 0.5 / max(1, (y < 0.5).sum())).astype(np.float32)
    y, w = y.astype(np.float32), np.zeros(x.shape[1], np.float32)  # one precision, so that no step copies the matrix
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = (balance * (p - y)) @ x + np.float32(DECAY) * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= np.float32(0.1) * (m / np.float32(1 - 0.9**t)) / (np.sqrt(v / np.float32(1 - 0.999**t)) + np.float32(1e-8))
    return w


def _mapped(docs: DataFrame, name: str, kind: str, arrow: pa.DataType, make) -> DataFrame:
    """doc_id and ``make`` of each text."""
    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string(f"{name} {kind}").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(make, part.column(1).to_pylist()), arrow)], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


class Scorer:
    def __init__(self, votes: tuple[np.ndarray, np.ndarray, float] | None, weights: np.ndarray | None):
        self.votes, self.weights = votes, weights

    def score(self, text: str | None) -> float:
        if not text or text.isspace():
            return 0.0
        if self.weights is None:
            return posterior(vote(text), self.votes) if self.votes else 0.0
        # A short text says little: its log-odds count by its words, and the corpus's share of sound texts for the rest.
        n = len(text.split())
        own, usual = float(features(text) @ self.weights[:-1] + self.weights[-1]), float(np.log(1 - self.votes[2]) - np.log(self.votes[2]))
        return float(1 / (1 + np.exp(-np.clip((n * own + FEW_WORDS * usual) / (n + FEW_WORDS), -30, 30))))


def fit(docs: DataFrame, fit_documents: int = FIT_DOCUMENTS) -> Scorer:
    """Votes of all ``docs`` (doc_id, text), and a scorer trained on about ``fit_documents`` of each side chosen by a hash."""
    # A row goes by a hash of doc_id and text, so rows of one doc_id are drawn apart, and equal rows once.
    keyed = docs.where("text IS NOT NULL").select(F.xxhash64("doc_id", "text").alias("doc_id"), "text")
    voted = common.written(_mapped(keyed, "pattern", "int", pa.int32(), vote))
    counts = {r["pattern"]: r["n"] for r in voted.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Scorer(None, None)
    model = estimate(counts)
    sound = {p: posterior(p, model) for p in counts}
    sides = [[p for p in counts if (sound[p] >= 0.5) == good] for good in (False, True)]
    totals = [sum(counts[p] for p in side) for side in sides]
    if not all(totals):
        return Scorer(model, None)
    label = F.element_at(F.create_map(*[F.lit(x) for p in counts for x in (p, sound[p])]), F.col("pattern"))
    chosen = F.lit(False)
    for side, total in zip(sides, totals, strict=True):
        share = common.bounded_share(total, fit_documents)
        chosen = chosen | (F.col("pattern").isin(side) & common.hash_below(F.col("doc_id"), share, "fit"))
    sample = common.written(voted.where(chosen).groupBy("doc_id").agg(F.min(label).alias("sound")))
    small = common.small_or_not(sample, sample.count())
    texts = keyed.join(small, "doc_id").select("doc_id", "text").dropDuplicates(["doc_id"])
    vectors = _mapped(texts, "vector", "binary", pa.binary(), lambda t: features(t).astype(np.float16).tobytes())

    def learn(table: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(table.column("vector").to_pylist()), np.float16).reshape(-1, BUCKETS).astype(np.float32)
        return pa.table({"weights": pa.array([train(x, table.column("sound").to_numpy()).tobytes()], pa.binary())})

    rows = vectors.join(small, "doc_id").groupBy(F.lit(1).alias("one")).applyInArrow(learn, "weights binary").collect()
    return Scorer(model, np.frombuffer(rows[0]["weights"], np.float32) if rows else None)


def classify(docs: DataFrame, scorer: Scorer, threshold: float = THRESHOLD, score: str = "score", kept: str = "kept") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``kept`` (a score of ``threshold`` or more)."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    keep = [c for c in docs.columns if c not in (score, kept)]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(score, T.DoubleType()), T.StructField(kept, T.BooleanType())])
    place, at_text = [docs.columns.index(c) for c in keep], docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score_of = shared.value.score
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                scores = [score_of(t) for t in part.column(at_text).to_pylist()]
                made = [pa.array(scores, pa.float64()), pa.array([s >= threshold for s in scores], pa.bool_())]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in place), *made], names=schema.names)

    return docs.mapInArrow(run, schema)

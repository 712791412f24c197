"""Language identification in two steps: the family, then the language within it.

Linear support vector machines over hashed character n-grams decide. Between families, and
between the languages of one family, there is one machine for each pair; a text's family is
the one that wins most pairs (ties: larger margins), and so is its language. Each machine is
trained in a Spark task of its own, on a bounded number of documents of each side, with the
averaged Pegasos method (Shalev-Shwartz et al. 2011). The machines' weights are broadcast:
their number depends on the languages alone, and a model beyond MOST_MACHINES machines is
an error, never a model of fewer languages.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; texts of any
length are read whole; equal texts get equal predictions; a language without a family in the
table belongs to the family of its first letter (``other:a`` and so on); with one language learned,
every text with a letter gets it; with none, or an empty table, every text is ``und``. Other
columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .text_features import gram_buckets

#: Buckets of the hashed n-grams, their sizes, and documents of a language that a machine sees at most (about).
BUCKETS, SIZES, FIT_DOCUMENTS = 1 << 13, (1, 2, 3), 600
#: Training passes and regularisation.
PASSES, LAMBDA = 12, 1e-4
#: Machines that a model holds at most (each BUCKETS numbers of 4 bytes): about 128 MB.
MOST_MACHINES = 4000
#: Languages of one side that a family machine draws all its rows from; beyond, each gives an even share.
SIDE_DOCUMENTS = 4 * FIT_DOCUMENTS
#: The share of a language's labelled rows that ``least_scores`` leaves aside as odd.
LEAST_SHARE = 0.001
CHUNK = 64
UNKNOWN = "und"
# ISO 639-1 codes of well-known languages by family.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb yi fy".split(),
    "romance": "fr es it pt ro ca gl oc la".split(),
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs".split(),
    "semitic": "ar he mt am".split(),
    "turkic": "tr az kk uz ky tk".split(),
    "uralic": "fi et hu".split(),
    "indic": "hi bn mr gu pa ne ur".split(),
    "dravidian": "ta te kn ml".split(),
    "sinitic": "zh yue wuu".split(),
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}
#: A letter in the sense of Unicode.
LETTER = r"\p{L}"


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0].split("_")[0], f"other:{lang[:1].lower()}")


def features(text: str) -> np.ndarray:
    """Unit vector of the damped counts of the text's n-grams; letters in lower case, runs of the rest as one blank."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    plain = (codes < 0x61) | ((codes > 0x7A) & (codes < 0xAA))
    keep = ~plain
    keep[1:] |= ~plain[:-1]
    codes = np.where(plain, np.uint32(0x20), codes)[keep]
    found = np.zeros(BUCKETS, np.float32)
    for size in SIZES:
        counts = np.bincount(gram_buckets(codes, size, BUCKETS), minlength=BUCKETS).astype(np.float32)
        if total := counts.sum():
            found += np.sqrt(counts / total)
    norm = float(np.sqrt(found @ found))
    return found / norm if norm else found


def train_pair(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and offset of a linear support vector machine for labels -1 and 1; both sides weigh the same."""
    rng = np.random.default_rng(7)
    w, b = np.zeros(x.shape[1], np.float64), 0.0
    mean_w, mean_b, kept, t = np.zeros_like(w), 0.0, 0, 0
    share = np.where(y > 0, (y < 0).mean(), (y > 0).mean()) * 2
    for epoch in range(PASSES):
        for i in rng.permutation(len(y)):
            t += 1
            rate = 1 / (LAMBDA * (t + 1000))
            short = y[i] * (x[i] @ w + b) < 1
            w *= 1 - rate * LAMBDA
            if short:
                w += rate * share[i] * y[i] * x[i]
                b += 0.01 * rate * share[i] * y[i]
        if epoch >= PASSES // 2:
            mean_w, mean_b, kept = mean_w + w, mean_b + b, kept + 1
    mean_w, mean_b = mean_w / kept, mean_b / kept
    margins = y * (x @ mean_w + mean_b)
    scale = max(1e-9, float(np.median(np.abs(margins))))  # so that margins of different machines compare
    return (mean_w / scale).astype(np.float32), float(mean_b / scale)


def _vectors(docs: DataFrame) -> DataFrame:
    """lang and the feature vector (binary) of every document that has a letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                data = pa.array([features(t).astype(np.float16).tobytes() for t in part.column("text").to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("lang"), data], names=["lang", "vector"])

    return docs.select("lang", "text").where(F.col("text").rlike(LETTER)).mapInArrow(run, "lang string, vector binary")


class Model:
    """Languages, their families, and a machine for each pair of families and each pair within a family."""

    def __init__(self, langs: list[str], machines: dict[tuple[str, str, str], tuple[bytes, float]]):
        self.langs = sorted(langs)
        self.groups = {"": sorted({family(x) for x in langs})}
        for name in self.groups[""]:
            self.groups[name + ":"] = [x for x in self.langs if family(x) == name]
        self.rows = sorted(machines)
        self.weights = np.array([np.frombuffer(machines[k][0], np.float32) for k in self.rows]).reshape(len(self.rows), BUCKETS)
        self.offsets = np.array([machines[k][1] for k in self.rows], np.float32)
        self.place = {k: i for i, k in enumerate(self.rows)}

    def _best(self, level: str, margins: np.ndarray) -> tuple[str, float]:
        names = self.groups[level]
        if len(names) == 1:
            return names[0], 1.0
        wins, sums = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0)
        least = dict.fromkeys(names, np.inf)
        for a, b in combinations(names, 2):
            m = float(margins[self.place[level, a, b]])  # positive: a
            wins[a if m >= 0 else b] += 1
            for name, own in ((a, m), (b, -m)):
                sums[name] += own
                least[name] = min(least[name], own)
        top = max(names, key=lambda n: (wins[n], sums[n]))
        return top, 1 / (1 + float(np.exp(-4 * least[top])))

    def tie(self, lang: str) -> float:
        """The score of ``lang`` where each of its levels is an even tie."""
        return 0.5 ** sum(len(self.groups[level]) > 1 for level in ("", family(lang) + ":"))

    def predict(self, text: str) -> tuple[str, float]:
        margins = self.weights @ features(text) + self.offsets if len(self.rows) else self.offsets
        group, sure = self._best("", margins)
        lang, surer = self._best(group + ":", margins)
        return lang, sure * surer


def _languages(vectors: DataFrame) -> list[str]:
    """The languages of ``vectors``, sorted; an error if they need more than MOST_MACHINES machines."""
    # More languages than this need more machines, whatever their families.
    found = sorted(r["lang"] for r in vectors.select("lang").distinct().limit(MOST_MACHINES + 2).collect())
    own: dict[str, int] = {}
    for x in found:
        own[family(x)] = own.get(family(x), 0) + 1
    machines = sum(n * (n - 1) // 2 for n in (len(own), *own.values()))
    if machines > MOST_MACHINES:
        raise ValueError(f"{len(found)} languages need {machines} machines; a model holds {MOST_MACHINES}: merge labels, or raise MOST_MACHINES")
    return found


def fit(docs: DataFrame, fit_documents: int = FIT_DOCUMENTS) -> Model | None:
    """A model from ``docs`` (doc_id, text, lang): about ``fit_documents`` of each language, chosen by a hash of doc_id."""
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL")
    counts = common.written(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    # Rows are drawn by a hash of doc_id and text, so a doc_id that repeats isn't drawn or left as a whole.
    share = F.least(F.lit(1.0), fit_documents / F.col("n"))
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit("fit")), 11) < share * F.lit(float(1 << 53))
    drawn = known.select("doc_id", "text", "lang").join(common.small_or_not(counts, counts.count()), "lang").where(draw).dropDuplicates()
    vectors = common.written(_vectors(drawn))
    langs = _languages(vectors)
    if not langs:
        return None
    pairs = []  # level, one side, other side, language of a row, sign, share of the language's rows
    groups = {}
    for x in langs:
        groups.setdefault(family(x), []).append(x)
    part = {g: min(1.0, SIDE_DOCUMENTS / (fit_documents * len(own))) for g, own in groups.items()}
    for a, b in combinations(sorted(groups), 2):
        pairs += [("", a, b, x, 1 if g == a else -1, part[g]) for g in (a, b) for x in groups[g]]
    for g, own in groups.items():
        for a, b in combinations(own, 2):
            pairs += [(g + ":", a, b, a, 1, 1.0), (g + ":", a, b, b, -1, 1.0)]
    machines: dict[tuple[str, str, str], tuple[bytes, float]] = {}
    if pairs:
        spark = docs.sparkSession
        sides = spark.createDataFrame(pairs, "level string, a string, b string, lang string, sign int, share double")

        def train(key: tuple, table: pa.Table) -> pa.Table:
            x = np.frombuffer(b"".join(table.column("vector").to_pylist()), np.float16).reshape(-1, BUCKETS)
            y = table.column("sign").to_numpy().astype(np.float64)
            order = np.lexsort((*[x[:, k] for k in range(0, BUCKETS, 1024)], x[:, :256].astype(np.float64) @ np.arange(256)))
            w, b = train_pair(x[order].astype(np.float32), y[order])
            row = {"level": [key[0].as_py()], "a": [key[1].as_py()], "b": [key[2].as_py()], "weights": [w.tobytes()], "offset": [b]}
            return pa.table({k: pa.array(v, pa.binary() if k == "weights" else None) for k, v in row.items()})

        some = F.shiftrightunsigned(F.xxhash64("vector", "level"), 11) < F.col("share") * F.lit(float(1 << 53))
        trained = vectors.join(common.small_or_not(sides, len(pairs)), "lang").where(some).groupBy("level", "a", "b")
        trained = trained.applyInArrow(train, "level string, a string, b string, weights binary, offset double")
        machines = {(r["level"], r["a"], r["b"]): (bytes(r["weights"]), r["offset"]) for r in trained.collect()}
    return Model(langs, machines)


def identify(docs: DataFrame, model: Model | None, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with columns ``lang`` and ``score``, made of the text alone; columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c not in (lang, score)]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])
    place, at_text = [docs.columns.index(c) for c in keep], docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        has_letter, model = regex.compile(LETTER).search, shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                found = [
                    model.predict(t) if model is not None and t is not None and has_letter(t) else (UNKNOWN, 0.0)
                    for t in part.column(at_text).to_pylist()
                ]
                made = [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in place), *made], names=schema.names)

    return docs.mapInArrow(run, schema)


def least_scores(told: DataFrame, model: Model | None, lang: str = "lang_pred", score: str = "score") -> dict[str, float]:
    """For each learned language the score below which a text isn't taken for it.

    It lies midway between an even tie and the LEAST_SHARE quantile of the language's labelled
    rows of ``told`` (doc_id, lang and the prediction) that are told right and aren't held out.
    """
    if model is None:
        return {}
    right = told.where((F.col("lang") == F.col(lang)) & ~held_out(F.col("doc_id")))
    found = right.groupBy(F.col(lang).alias("name")).agg(F.percentile_approx(score, LEAST_SHARE, 100_000).alias("low")).collect()
    low = {r["name"]: r["low"] for r in found}
    return {x: (model.tie(x) + low.get(x, model.tie(x))) / 2 for x in model.langs}


def held_out(doc_id) -> object:
    """True for the fifth of the documents that nothing is learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0

"""Quality rules: decision lists learned from labelled statistics, run as Spark expressions.

Sequential covering, after RIPPER (Cohen 1995): a rule for low quality grows by the threshold
condition of most information gain, is pruned on rows set apart, and the rows it covers leave;
then the next rule. The rules become one ordered CASE expression over the documents'
statistics. The statistics of the labelled rows come binned and counted from Spark; only those
counts, of at most FIT_ROWS labelled rows, reach the learner.

Defined cases: a null or empty text has no words and fails the base rule; text of any length is
counted whole; repeated rows get the same verdict; without labels of both kinds there are no
rules and only the base rule rejects; other columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Bounds of the base rule.
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
#: Labelled rows that the learner sees at most (about), bins of a statistic, conditions of a rule, rules.
FIT_ROWS, BINS, MOST_CONDITIONS, MOST_RULES = 20_000, 24, 4, 12
#: A rule is kept if so many of the rows it covers, among those set apart, are of low quality.
PRECISION = 0.9
#: Characters that count as symbols, and ASCII white space.
SYMBOLS, BLANKS = "#*$%&|<>", " \t\n\x0b\x0c\r"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The statistics that rules may test.
TESTED = ("n_words", "chars_per_word", "symbol_share", "capital_share", "exclaim_share", "digit_share", "dup_line_share", "repeat_share", "distinct_share")


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def repeated_words(words: Column) -> Column:
    """Words of an array that stand in a 3-word window which the array holds twice or more.

    Windows are sorted by their hash with their place; those beside an equal one repeat. In
    place order each of them adds the words up to the next one, three at most.
    """
    hashed = lambda w: F.transform(
        F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2))
    )

    def places(h: Column) -> Column:
        def twice(s: Column) -> Column:
            beside = lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
            return F.transform(F.filter(s, beside), lambda x: x["i"])

        return F.sort_array(common.bind(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), twice))

    def covered(p: Column) -> Column:
        gap = lambda x, i: F.coalesce(F.least(F.lit(3), F.get(p, i + 1) - x), F.lit(3))
        return F.aggregate(F.transform(p, gap), F.lit(0), lambda a, x: a + x)

    def count(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(common.bind(places(h), covered))

    return common.bind(words, lambda w: F.when(F.size(w) < 4, F.lit(0)).otherwise(common.bind(hashed(w), count))).cast("long")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of each whole text."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: _without(x, BLANKS) > 0)
    repeated = lambda x: common.bind(x, lambda a: F.size(a) - F.size(F.array_distinct(a)))
    words = F.filter(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " "), lambda x: x != "")
    of_words = common.bind(
        words, lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("repeat"), F.size(F.array_distinct(w)).alias("distinct"))
    )
    counts = docs.select(
        "doc_id",
        F.array(of_words).alias("_w"),
        _without(text, BLANKS).cast("long").alias("word_chars"),
        (F.length(text) - _without(text, SYMBOLS)).cast("long").alias("n_symbols"),
        repeated(lines).cast("long").alias("n_dup_lines"),
        (F.length(text) - _without(text, CAPITALS)).alias("n_capitals"),
        (F.length(text) - _without(text, "!")).alias("n_exclaim"),
        (F.length(text) - _without(text, "0123456789")).alias("n_digits"),
        F.size(lines).alias("n_lines"),
    )
    # Generating the one element keeps the struct from being worked out once for each of its fields; the outer form adds no filter on it.
    return counts.select("*", F.inline_outer("_w")).select(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.col("repeat").alias("n_repeat_words"),
        *("n_capitals", "n_exclaim", "n_digits", "n_lines"),
        F.col("distinct").alias("n_distinct"),
    )


def tested(stats: DataFrame) -> DataFrame:
    """``stats`` with the columns of TESTED."""
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return stats.select(
        "*",
        share("word_chars", "n_words").alias("chars_per_word"),
        share("n_symbols", "word_chars").alias("symbol_share"),
        share("n_capitals", "word_chars").alias("capital_share"),
        share("n_exclaim", "word_chars").alias("exclaim_share"),
        share("n_digits", "word_chars").alias("digit_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
        share("n_distinct", "n_words").alias("distinct_share"),
    )


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool  # at or above the threshold, else below it
    threshold: float

    def column(self) -> Column:
        return F.col(self.name) >= self.threshold if self.above else F.col(self.name) < self.threshold


Rule = tuple[Condition, ...]


def binned_counts(labelled: DataFrame, names: Sequence[str] = TESTED) -> tuple[dict[str, list[float]], list]:
    """Each statistic's thresholds, and the count of labelled rows by bins, label and fold."""
    at = [i / BINS for i in range(1, BINS)] + [0.005, 0.01, 0.02, 0.98, 0.99, 0.995]
    found = labelled.agg(*[F.percentile_approx(F.col(n).cast("double"), sorted(at), 10_000).alias(n) for n in names]).first()
    cuts = {n: sorted(set(found[n] or [])) for n in names}
    # Half way to the next lower value seen, so that a threshold doesn't sit on a value.
    cuts = {n: [(a + b) / 2 for a, b in zip(v, v[1:], strict=False)] for n, v in cuts.items()}
    bins = [sum([(F.col(n) >= c).cast("int") for c in v], F.lit(0)).alias(n) for n, v in cuts.items()]
    apart = F.pmod(F.xxhash64("doc_id", F.lit("prune")), F.lit(3)).alias("fold")
    cells = labelled.select(*bins, "quality", apart).groupBy(*names, "quality", "fold").agg(F.count(F.lit(1)).alias("n"))
    return cuts, cells.collect()


def learn(cuts: dict[str, list[float]], cells: list, precision: float = PRECISION) -> list[Rule]:
    """Rules for low quality, in order, by growing on two folds and pruning on the third."""
    names = list(cuts)
    data = [([r[n] for n in names], r["quality"] == 0, r["fold"] == 0, r["n"]) for r in cells]
    grow, prune = [d for d in data if not d[2]], [d for d in data if d[2]]

    def meets(bins: list[int], rule: list) -> bool:
        return all((bins[f] >= k) == above for f, above, k in rule)

    def counts(rows: list, rule: list) -> tuple[int, int]:
        p = sum(n for b, bad, _, n in rows if bad and meets(b, rule))
        return p, sum(n for b, bad, _, n in rows if not bad and meets(b, rule))

    def best(rows: list) -> tuple[float, tuple | None]:
        """The condition of most information gain among ``rows``."""
        p0, n0 = sum(n for _, bad, _, n in rows if bad), sum(n for _, bad, _, n in rows if not bad)
        if not p0 or not n0:
            return 0.0, None
        base, top = math.log2(p0 / (p0 + n0)), (1e-9, None)
        for f, name in enumerate(names):
            width = len(cuts[name]) + 1
            ps, ns = [0] * width, [0] * width
            for b, bad, _, n in rows:
                (ps if bad else ns)[b[f]] += n
            p = q = 0
            for k in range(1, width):
                p, q = p + ps[k - 1], q + ns[k - 1]
                for above, a, b in ((False, p, q), (True, p0 - p, n0 - q)):
                    if a and (gain := a * (math.log2(a / (a + b)) - base)) > top[0]:
                        top = (gain, (f, above, k))
        return top

    rules: list[Rule] = []
    while len(rules) < MOST_RULES and any(bad for _, bad, _, _ in grow):
        rule, rows = [], grow
        while len(rule) < MOST_CONDITIONS:
            _, condition = best(rows)
            if condition is None:
                break
            rule.append(condition)
            rows = [r for r in rows if meets(r[0], [condition])]
        if not rule:
            break

        def worth(k: int, rule: list = rule) -> tuple[float, int]:
            p, n = counts(prune, rule[:k])
            return ((p - n) / (p + n) if p + n else -1.0, -k)

        rule = rule[: max(range(1, len(rule) + 1), key=worth)]
        p, n = counts(prune, rule)
        gp, gn = counts(grow, rule)
        if (p + gp) < precision * (p + gp + n + gn) or (p + n and p < precision * (p + n)):
            break
        rules.append(tuple(Condition(names[f], above, cuts[names[f]][k - 1]) for f, above, k in rule))
        grow, prune = [[r for r in rows if not meets(r[0], rule)] for rows in (grow, prune)]
    return rules


def verdict(rules: Sequence[Rule]) -> Column:
    """The ordered expression: false at the first rule that holds, else true."""
    found = None
    for rule in rules:
        holds = rule[0].column()
        for condition in rule[1:]:
            holds = holds & condition.column()
        found = F.when(holds, F.lit(False)) if found is None else found.when(holds, F.lit(False))
    return F.lit(True) if found is None else found.otherwise(F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> list[Rule]:
    """Rules from the labelled documents, or from about ``fit_rows`` of them chosen by a hash of doc_id."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    share = common.bounded_share(known.count(), fit_rows)
    chosen = known.where(common.hash_below(F.col("doc_id"), share, "fit")).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality")
    stats = statistics(sample)
    labelled = common.written(tested(stats.join(F.broadcast(chosen), "doc_id")))
    return learn(*binned_counts(labelled))


def judge(docs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every document; a table of fewer splits than cores is dealt out first."""
    repeated = 100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")
    judged = tested(statistics(common.dealt_out(docs))).withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | repeated)
    return judged.withColumn("kept", ~F.col("base_failed") & verdict(rules)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )

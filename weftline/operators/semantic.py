"""Semantic edges: similar vectors, shared entities, equal categories, candidates for relations."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.registry import Registry
from ..sources.tables import kept, table

registry = Registry()

#: The usual threshold of similar nodes; the generated vectors need a lower one.
SIMILAR, SIMILAR_HERE = 0.75, 0.30
BLOCK_ROWS = 2048
#: Copies of vectors that a task sends to blocks at once: a vector may meet every block.
SENT = 8192
#: Pivots at most, vectors drawn for each, and what is added to angles and taken from bounds, so that rounding loses no pair.
PIVOTS, DRAWN, SLACK = 512, 8, 1e-6
#: Documents of a block of an entity, and pairs of sets that a task compares at once.
GROUP_ROWS, MET = 2048, 65_536
#: Documents from which an entity is a hot one, and parts into which it is dealt.
HOT_ENTITY, SALTS = 20, 16
# Pairs that a relation is sought for at most.
CANDIDATES = 300
#: Entities of a document, their least length, how many two documents share to be linked, and the same for the registered query.
ENTITIES, ENTITY_LENGTH, LEAST_SHARED, LEAST_SHARED_HERE = 10, 5, 1, 4


def _unit(t: pa.Table | pa.RecordBatch) -> np.ndarray:
    x = np.array(pc.list_flatten(t.column("vector")).to_numpy(zero_copy_only=False)).reshape(t.num_rows, -1)  # a copy, as it is scaled in place
    x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-10
    return x


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1.0, 1.0))


def _spread(x: np.ndarray, most: int) -> np.ndarray:
    """``most`` rows of ``x``, each the farthest from those before it."""
    chosen, nearest = [0], _angles(x, x[:1])[:, 0]
    while len(chosen) < most:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, _angles(x, x[chosen[-1] :][:1])[:, 0])
    return x[chosen]


@dataclass(frozen=True)
class Cells:
    """Vectors by their nearest pivot: ``members`` (id, vector, cell, block), the pivots, and for each cell its radius and its number of blocks."""

    members: DataFrame
    pivots: np.ndarray
    radius: np.ndarray
    blocks: np.ndarray


def cells(vectors: DataFrame, block_rows: int = BLOCK_ROWS, store: Callable[[DataFrame], DataFrame] = kept) -> Cells:
    """Each vector with the pivot at the smallest angle.

    Pivots are PIVOTS vectors, or as many as the root of all, each the farthest from those before it among DRAWN times as many whose ids hash lowest.
    """
    rows = vectors.select("id", F.col("vector").cast("array<double>").alias("vector"))
    n = rows.count()
    most = min(PIVOTS, max(1, math.isqrt(n)))
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(DRAWN * most).select("vector").toArrow()
    pivots = _spread(_unit(drawn), most) if drawn.num_rows else np.zeros((1, 1))
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if t.num_rows:
                angles = _angles(_unit(t), shared.value)
                cell = angles.argmin(axis=1)
                names = ["id", "vector", "cell", "angle"]
                yield pa.RecordBatch.from_arrays([t.column("id"), t.column("vector"), pa.array(cell, pa.int32()), pa.array(angles[np.arange(len(cell)), cell])], names=names)

    assigned = store(rows.mapInArrow(assign, "id long, vector array<double>, cell int, angle double"))
    radius, blocks = np.zeros(len(pivots)), np.ones(len(pivots), np.int64)
    for r in assigned.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect():  # a row for each pivot
        radius[r["cell"]], blocks[r["cell"]] = r["radius"], -(-r["n"] // block_rows)
    of = F.element_at(F.array(*[F.lit(int(b)) for b in blocks]), F.col("cell") + 1)
    return Cells(assigned.withColumn("block", F.pmod(F.xxhash64("id"), of).cast("int")).drop("angle"), pivots, radius, blocks)


def visits(c: Cells, threshold: float, own: bool = False) -> DataFrame:
    """id, vector, cell and block of every block that a vector must meet: those of its own cell from its own block on, and of later cells that may hold a match.

    A cell whose pivot is farther from the vector than its radius and the angle of ``threshold`` together can't hold one. ``own``: only the own cell.
    """
    reach = math.pi if threshold <= 0 else math.acos(min(1.0, threshold)) + SLACK
    shared = c.members.sparkSession.sparkContext.broadcast((c.pivots, c.radius, c.blocks))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, radius, blocks = shared.value
        for t in batches:
            if not t.num_rows:
                continue
            cell, block = t.column("cell").to_numpy(), t.column("block").to_numpy()
            row, to = np.nonzero((_angles(_unit(t), pivots) <= radius + reach) & (np.arange(len(radius)) > cell[:, None]))
            if own:
                row, to = row[:0], to[:0]
            row, to = np.concatenate([row, np.arange(len(cell))]), np.concatenate([to, cell])
            first = np.where(to == cell[row], block[row], 0)
            times = blocks[to] - first
            at = np.repeat(first - (np.cumsum(times) - times), times) + np.arange(times.sum())
            row, to = np.repeat(row, times), np.repeat(to, times)
            for i in range(0, len(row), SENT):
                r, k, block_at = row[i : i + SENT], to[i : i + SENT], at[i : i + SENT]
                taken = t.take(pa.array(r))
                arrays = [taken.column("id"), taken.column("vector"), pa.array(k.astype(np.int32)), pa.array(block_at.astype(np.int32)), pa.array((k == cell[r]) & (block_at == block[r]))]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "vector", "cell", "block", "resident"])

    return c.members.mapInArrow(go, "id long, vector array<double>, cell int, block int, resident boolean")


def pair_work(c: Cells, threshold: float) -> int:
    """How many pairs ``similar_pairs`` multiplies at this threshold."""
    met = visits(c, threshold).groupBy("cell", "block").agg(F.count_if("resident").alias("r"), F.count_if(~F.col("resident")).alias("v"))
    return met.agg(F.sum(F.col("r") * (F.col("r") - 1) / 2 + F.col("r") * F.col("v"))).first()[0] or 0


def _multiplied(c: Cells, threshold: float, block_rows: int, best: int | None, own: bool) -> DataFrame:
    sent = visits(c, threshold, own)
    sizes = sent.where("NOT resident").groupBy("cell", "block").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("chunks"))
    parted = sent.join(sizes, ["cell", "block"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    # Residents go to every chunk of their visitors, and meet each other in the first.
    every = F.sequence(F.lit(0), F.col("chunks") - 1)
    chunk = F.explode(F.when(F.col("resident"), every).otherwise(F.array(F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))))

    def multiply(t: pa.Table) -> pa.Table:
        ids, home, x = t.column("id").to_numpy(), t.column("resident").to_numpy(zero_copy_only=False), _unit(t)
        out = []
        for left in (np.flatnonzero(~home), *([np.flatnonzero(home)] if t.column("chunk")[0].as_py() == 0 else [])):
            right = np.flatnonzero(home)
            score = x[left] @ x[right].T
            r, k = np.nonzero(score >= threshold)
            a, b, s = ids[left][r], ids[right][k], score[r, k]
            keep = (a < b) if len(left) and home[left[0]] else a != b
            out.append((a[keep], b[keep], s[keep]))
        a, b, s = (np.concatenate(x) for x in zip(*out, strict=True))
        if best is not None and len(s) > best:
            keep = s >= np.partition(s, len(s) - best)[len(s) - best]
            a, b, s = a[keep], b[keep], s[keep]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "score": s})

    return parted.withColumn("chunk", chunk).drop("chunks").groupBy("cell", "block", "chunk").applyInArrow(multiply, "a long, b long, score double")


def similar_pairs(vectors: DataFrame, threshold: float, block_rows: int = BLOCK_ROWS, best: int | None = None) -> DataFrame:
    """a, b (a < b) and score of every pair of unit-scaled vectors with cosine at or above ``threshold``; ``vectors`` has id and vector.

    Exact: vectors lie in cells around pivots, and by the triangle inequality of angles a vector meets only the cells that can hold a match.
    A task multiplies a block of a cell with as many visitors at most. With ``best``, each task gives out only its ``best`` pairs
    and those that tie with the last of them, enough for that many overall; the pairs within cells come first, and the last of their ``best``
    is a bound below which the other cells needn't look.
    """
    c = cells(vectors, block_rows)
    if best is not None:
        near = _multiplied(c, threshold, block_rows, best, own=True).orderBy(F.desc("score")).limit(best).agg(F.count("*").alias("n"), F.min("score").alias("s")).first()
        if near["n"] == best:
            threshold = max(threshold, near["s"] - SLACK)
    return _multiplied(c, threshold, block_rows, best, own=False)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


_COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@registry.add(f"SELECT a.vec_id AS a, b.vec_id AS b, round({_COS}, 4) AS weight FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {_COS} >= 0.30")
def sem_similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_pairs(_vectors(spark, sf_dir), SIMILAR_HERE).select("a", "b", F.round("score", 4).alias("weight"))


@registry.add(f"""SELECT a.vec_id AS a, b.vec_id AS b, round({_COS}, 4) AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {_COS} >= 0.30
ORDER BY {_COS} DESC, a, b LIMIT 300""")
def sem_candidate_pairs_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = similar_pairs(_vectors(spark, sf_dir), SIMILAR_HERE, best=CANDIDATES).orderBy(F.desc("score"), "a", "b").limit(CANDIDATES)
    return best.select("a", "b", F.round("score", 4).alias("score"))


@registry.add("""SELECT label, count(*) AS members, CAST(count(*) * (count(*) - 1) / 2 AS BIGINT) AS pairs, min(vec_id) AS first_member FROM embeddings GROUP BY 1""")
def sem_same_label_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count("*")
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(n.alias("members"), (n * (n - 1) / 2).cast("long").alias("pairs"), F.min("vec_id").alias("first_member"))


def category_edges(members: DataFrame) -> DataFrame:
    """Each node of a category linked with the category's first node: the same components as all pairs, in linear size."""
    first = members.groupBy("category").agg(F.min("id").alias("first"))
    return members.join(first, "category").where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"), "category")


@registry.add()
def sem_kmeans_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = _vectors(spark, sf_dir)
    n = v.count()
    if n < 3:
        return v.select("id", F.lit(0).alias("cluster_id"))
    points = v.select("id", array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    model = KMeans(k=max(2, min(10, int(n**0.5))), seed=42, maxIter=10).fit(points)
    return model.transform(points).select("id", F.col("prediction").alias("cluster_id"))


def entities(docs: DataFrame) -> DataFrame:
    """doc_id and entity: a document's most frequent long words, ties in alphabetical order. Texts are shuffled once, words never."""
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]{%d,}" % ENTITY_LENGTH), F.lit(0))).alias("entity")
    counts = docs.select("doc_id", "text").repartition("doc_id").select("doc_id", word).groupBy("doc_id", "entity").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "entity"))
    return counts.withColumn("r", rank).where(F.col("r") <= ENTITIES).select("doc_id", "entity")


def _overlaps(rows: pa.Table, least: int) -> Iterator[pa.RecordBatch]:
    """a, b and shared of the pairs that share ``least`` words or more, each under its first common word only.

    ``rows`` (doc_id, s, entity, x, y, own) has whole groups of an entity and two blocks x and y, in order; within a group, documents of one block meet
    those of the other, or each other if the blocks are one.
    """
    n = rows.num_rows
    words, ids = rows.column("s").combine_chunks(), rows.column("doc_id").combine_chunks()
    sizes = pc.list_value_length(words).to_numpy()
    named = pc.unique(words.flatten())
    named = named.take(pc.sort_indices(named))  # so that numbers of words are in alphabetical order
    flat = pc.index_in(words.flatten(), named).to_numpy()
    codes = np.full((n, int(sizes.max())), -1, np.int32)
    codes[np.arange(codes.shape[1]) < sizes[:, None]] = flat
    entity = pc.index_in(rows.column("entity").combine_chunks(), named).to_numpy()
    # A bit for each word; words of one bit are allowed for, so no pair is lost by them.
    bit = np.uint64(1) << ((codes.astype(np.int64) * 0x9E3779B1 >> 7) & 63).astype(np.uint64)
    bits = np.bitwise_or.reduce(np.where(codes >= 0, bit, np.uint64(0)), axis=1)
    enough = least - (sizes - np.bitwise_count(bits))
    x, y, own = (rows.column(c).to_numpy() for c in ("x", "y", "own"))
    first = np.concatenate([[True], (entity[1:] != entity[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], n)[np.cumsum(first) - 1]
    # Where the partners of a row begin: after it, or where the other block does.
    other = np.flatnonzero(np.concatenate([[True], first[1:] | (own[1:] != own[:-1])]))
    after = np.append(other[1:], n)[np.searchsorted(other, np.arange(n), "right") - 1]
    begin = np.where(x == y, np.arange(n) + 1, after)
    times = np.maximum(ends - begin, 0)
    upto = np.cumsum(times)
    for lo in range(0, int(upto[-1]), MET):
        hi = min(lo + MET, int(upto[-1]))
        r = np.arange(np.searchsorted(upto, lo, "right"), np.searchsorted(upto, hi - 1, "right") + 1)
        to, of = np.minimum(upto[r], hi) - lo, np.maximum(upto[r] - times[r], lo) - lo
        left = np.repeat(r, to - of)
        right = np.arange(lo, hi) - np.repeat(upto[r] - times[r] - begin[r], to - of)
        some = np.flatnonzero(np.bitwise_count(bits[left] & bits[right]) >= enough[left])
        left, right = left[some], right[some]
        mine = codes[left]
        there = np.zeros(mine.shape, bool)
        for k in range(codes.shape[1]):
            there |= mine == codes[right, k][:, None]
        there &= mine >= 0
        count = there.sum(axis=1)
        keep = np.flatnonzero((count >= least) & (mine[np.arange(len(mine)), there.argmax(axis=1)] == entity[left]))
        if len(keep):
            left, right, count, mine, there = left[keep], right[keep], count[keep], mine[keep], there[keep]
            held = np.sort(np.where(there, mine, len(named)), axis=1)
            shared = named.take(pa.array(held[held < len(named)]))
            a, b = ids.take(pa.array(left)), ids.take(pa.array(right))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), shared)
            yield pa.RecordBatch.from_arrays([pc.min_element_wise(a, b), pc.max_element_wise(a, b), lists], names=["a", "b", "shared"])


def _common(sets: DataFrame, least: int) -> DataFrame:
    """a, b (a < b) and shared, in alphabetical order, of documents that share ``least`` entities or more of their ``s``; ``sets`` has doc_id, s and of.

    ``of`` are the entities by which documents meet (df, entity), in an order that all documents agree on; a pair comes out where its first common one
    is, so pairs are neither shuffled nor made twice. Documents of an entity are dealt into blocks of about GROUP_ROWS, and a group is two blocks.
    """
    spark = sets.sparkSession
    each = sets.select("doc_id", "s", F.explode("of").alias("e")).where("e.df > 1")
    blocks = F.ceil(F.col("e.df") / GROUP_ROWS).cast("int")
    own = each.select("doc_id", "s", "e.entity", blocks.alias("blocks"), F.pmod(F.xxhash64("doc_id"), blocks).cast("int").alias("own"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("doc_id", "s", "entity", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)  # by pairs, not by bytes, are tasks long
    dealt = met.repartition(tasks, "entity", "x", "y").sortWithinPartitions("entity", "x", "y", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([*held, batch])
            key = rows.select(["entity", "x", "y"])
            last = key.slice(rows.num_rows - 1, 1)
            same = pc.and_(pc.and_(pc.equal(key["entity"], last["entity"][0]), pc.equal(key["x"], last["x"][0])), pc.equal(key["y"], last["y"][0]))
            whole = rows.num_rows - pc.sum(same).as_py()  # the last group may go on in the next batch
            if whole:
                yield from _overlaps(rows.slice(0, whole).combine_chunks(), least)
            held = rows.slice(whole).to_batches()
        if held:
            yield from _overlaps(pa.Table.from_batches(held).combine_chunks(), least)

    kind = sets.schema["doc_id"].dataType.simpleString()
    return dealt.mapInArrow(run, f"a {kind}, b {kind}, shared array<string>")


def shared_entities(ents: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """a, b (a < b), weight and shared, the entities in alphabetical order, of documents that share ``least`` entities or more.

    Two sets of that overlap share one of their rarer entities: of a set's n, in order of
    rarity, the first n - least + 1. Documents meet only by those, so common words meet no one.
    """
    df = ents.groupBy("entity").agg(F.count("*").alias("df"))
    ranked = ents.where("doc_id IS NOT NULL").join(df, "entity").groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("df", "entity"))).alias("e")).where(F.size("e") >= least)
    sets = ranked.select("doc_id", F.transform("e", lambda x: x["entity"]).alias("s"), F.slice("e", F.lit(1), F.size("e") - least + 1).alias("of"))
    return _common(sets, least).select("a", "b", F.size("shared").cast("long").alias("weight"), "shared")


def entity_edges(ents: DataFrame, hot: int = HOT_ENTITY) -> DataFrame:
    """Who shares an entity with whom, whole and without the square of a hot one: a, b, kind, shared (entities in alphabetical order) and links.

    Documents with a rarer entity in common are a pair (a < b; ``links`` is 1). An entity of more than ``hot`` documents is a class: a row for each
    of its members b with the representative a, its smallest document, and ``links``, with how many others the entity alone links the member.
    Entities meet their counts in SALTS parts, so no task gets a hot one whole.
    """
    df = ents.groupBy("entity").agg(F.count("*").alias("df"), F.min("doc_id").alias("first"))
    salted = df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    known = ents.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["entity", "salt"])
    members = known.where(F.col("df") > hot).select(F.col("first").alias("a"), F.col("doc_id").alias("b"), F.lit("member").alias("kind"), F.array("entity").alias("shared"), (F.col("df") - 1).alias("links"))
    light = known.where(F.col("df") <= hot)
    # At most ``hot`` documents a group: it is one row, and its pairs are made in place, each where its first common entity is.
    own = light.groupBy("doc_id").agg(F.array_sort(F.collect_list("entity")).alias("s"))
    groups = own.select("doc_id", "s", F.explode("s").alias("entity")).groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("doc_id", "s"))).alias("m")).where(F.size("m") > 1)
    firsts = groups.select("entity", "m", F.posexplode("m").alias("at", "x"))
    met = firsts.select("entity", "x", F.explode(F.slice("m", F.col("at") + 2, F.size("m"))).alias("y"))
    pairs = met.select("entity", F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"), F.array_sort(F.array_intersect("x.s", "y.s")).alias("shared")).where("shared[0] = entity AND a < b")
    return pairs.select("a", "b", F.lit("pair").alias("kind"), "shared", F.lit(1).cast("long").alias("links")).unionByName(members)


def entity_links(ents: DataFrame) -> DataFrame:
    """entity, documents and links: how many links of one shared entity each entity alone makes, without making them."""
    n = F.count("*")
    return ents.groupBy("entity").agg(n.alias("documents"), (n * (n - 1) / 2).cast("long").alias("links"))


@registry.add(r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}]{5,}')) AS entity FROM documents), c AS (SELECT doc_id, entity, count(*) AS n FROM w GROUP BY 1, 2),
e AS (SELECT doc_id, entity FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, entity) <= 10)
SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS weight, string_agg(entity, ',' ORDER BY entity) AS shared FROM e x JOIN e y USING (entity) WHERE x.doc_id < y.doc_id GROUP BY 1, 2 HAVING count(*) >= 4""")
def sem_shared_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shared_entities(kept(entities(table(spark, sf_dir, "documents"))), LEAST_SHARED_HERE)
    return found.withColumn("shared", F.array_join("shared", ","))


@registry.add(r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}]{5,}')) AS entity FROM documents), c AS (SELECT doc_id, entity, count(*) AS n FROM w GROUP BY 1, 2),
e AS (SELECT doc_id, entity FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, entity) <= 10)
SELECT entity, count(*) AS documents, CAST(count(*) * (count(*) - 1) / 2 AS BIGINT) AS links FROM e GROUP BY 1""")
def sem_entity_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_links(entities(table(spark, sf_dir, "documents")))


@registry.add("""WITH f AS (SELECT label, min(vec_id) AS first FROM embeddings GROUP BY 1) SELECT first AS a, vec_id AS b, e.label AS category FROM embeddings e JOIN f ON e.label = f.label WHERE vec_id <> first""")
def sem_category_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return category_edges(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("category")))


@registry.add(rf"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}]{{5,}}')) AS entity FROM documents), c AS (SELECT doc_id, entity, count(*) AS n FROM w GROUP BY 1, 2),
e AS (SELECT doc_id, entity FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, entity) <= 10), f AS (SELECT *, count(*) OVER v AS df, min(doc_id) OVER v AS first FROM e WINDOW v AS (PARTITION BY entity))
SELECT x.doc_id AS a, y.doc_id AS b, 'pair' AS kind, string_agg(entity, ',' ORDER BY entity) AS shared, 1 AS links FROM f x JOIN f y USING (entity) WHERE x.doc_id < y.doc_id AND x.df <= {HOT_ENTITY} GROUP BY 1, 2
UNION ALL SELECT first, doc_id, 'member', entity, df - 1 FROM f WHERE df > {HOT_ENTITY}""")
def sem_entity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that shares one entity or more with another."""
    return entity_edges(kept(entities(table(spark, sf_dir, "documents")))).withColumn("shared", F.array_join("shared", ","))

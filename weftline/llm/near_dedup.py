"""Near-duplicates by MinHash in an LSH forest, with every link confirmed on full sets.

A document's set holds its distinct word shingles. Its MinHash values fill TREES labels of
DEPTH values each. All labels of a tree are sorted; documents that share a prefix stand side by
side, and those with the longest common prefix are nearest. A run that shares LEAST_DEPTH values
is a region of candidates, of any size. A region of more than REGION_ROWS documents is linked in
pieces that take one value more, again and again, so depth adapts to the density of each part of
each order; every piece, of one document too, is then linked to the others of its run, and so
are the parts of a run that a border of partitions cuts. Documents of touching regions, over all
trees, form a clump. Full sets of the documents in clumps, and of
no others, then meet by clump, and links are confirmed exactly with an index of shingles: a
search from a document covers only those not reached before, so a group of copies costs little
more than one pass. A clump too large for a task is cut in blocks, and confirmed in rounds:
inside each block; then one document of each part linked so far; then only documents
outside the clump's largest part meet the rest, block by block. So a group of copies, however
large, takes part in each round once; only documents that aren't linked to it meet all blocks.

Documents of the same set are one node from the start. At a similarity of 0.8 a pair
misses every tree with probability (1 - 0.8**3)**16, about 1 in 100,000, in regions of any size.

Defined cases: without words or text, or with a null doc_id, a document is linked with nothing;
fewer words than a shingle make one shingle of the whole sequence; rows of one doc_id are one
node, which links all its texts' groups; an empty table gives an empty result; other columns
don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, graph

TREES, DEPTH, LEAST_DEPTH = 16, 8, 3
#: Documents linked at once before a region takes one more value; shingles in a block of a clump.
REGION_ROWS, BLOCK_SHINGLES = 4096, 300_000
#: Documents turned into sets at a time, and entries of a worker's cache of word hashes.
CHUNK, CACHE_ENTRIES = 500, 100_000

_rng = np.random.default_rng(20240229)
_SCALE = _rng.integers(1, 1 << 32, TREES * DEPTH, dtype=np.uint32) | np.uint32(1)
_SHIFT = _rng.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32)
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_FIRST, _SECOND = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _Words(dict):
    """Bounded cache from word to its 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[word] = h
        return h


_words = _Words()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _FIRST
    x = (x ^ (x >> np.uint64(27))) * _SECOND
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``width`` words; A-Z count as a-z."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    used = min(width, len(words))
    n = len(words) - used + 1
    total = np.full(n, used, np.uint64)
    for k in range(used):
        total += _mixed(hashes[k : k + n] * _PLACE[k])
    return np.unique(_mixed(total))


def signature(found: np.ndarray) -> np.ndarray:
    """TREES * DEPTH MinHash values of a set that isn't empty."""
    low = (found >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(_SCALE), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 2048):
        part = np.multiply.outer(_SCALE, low[at : at + 2048])
        part += _SHIFT[:, None]
        np.minimum(best, part.min(axis=1), out=best)
    return best


def _signed(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, set_hash and labels (null for an empty set) of every document."""
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType(
        [T.StructField("doc_id", id_type), T.StructField("n_shingles", T.LongType()), T.StructField("set_hash", T.BinaryType()), T.StructField("labels", T.BinaryType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                sets = [shingles(t, width) for t in part.column(1).to_pylist()]
                cols = [
                    part.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([signature(s).astype(">u4").tobytes() if len(s) else None for s in sets], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _runs(keys: np.ndarray, lo: int, hi: int, depth: int, most: int) -> Iterator[tuple[int, int]]:
    """Pieces that cover rows lo to hi, which share ``depth`` values: deeper where they are many."""
    if hi - lo <= most or depth == DEPTH:
        yield lo, hi
        return
    cuts = np.flatnonzero(keys[lo + 1 : hi, depth] != keys[lo : hi - 1, depth]) + lo + 1
    edges = [lo, *cuts.tolist(), hi]
    for a, b in zip(edges, edges[1:], strict=False):
        yield from _runs(keys, a, b, depth + 1, most)


def _candidate_edges(forest: DataFrame, most: int) -> DataFrame:
    """u, v: edges that connect all documents of one tree that share LEAST_DEPTH values. ``forest`` has tree, label and doc_id."""
    dealt = forest.repartitionByRange("tree", "label", "doc_id").sortWithinPartitions("tree", "label", "doc_id")
    id_type = forest.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("u", id_type), T.StructField("v", id_type), T.StructField("run", T.BinaryType())])

    def edges(trees: np.ndarray, keys: np.ndarray, ids: pa.Array, first: bool, last: bool) -> Iterator[pa.RecordBatch]:
        """Each piece's documents with its smallest one, and those with the run's; the partition's first and last run also by name."""
        same = (trees[1:] == trees[:-1]) & (keys[1:, :LEAST_DEPTH] == keys[:-1, :LEAST_DEPTH]).all(axis=1)
        cuts = [0, *(np.flatnonzero(~same) + 1).tolist(), len(keys)]
        order, us, vs = ids.to_numpy(zero_copy_only=False), [], []
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a > 1:
                middles = []
                for lo, hi in _runs(keys, a, b, LEAST_DEPTH, most):
                    middles.append(lo + int(order[lo:hi].argmin()))  # the smallest, so that trees agree on it
                    us.append(np.arange(lo, hi))
                    vs.append(np.full(hi - lo, middles[-1]))
                if len(middles) > 1:
                    us.append(np.array(middles))
                    vs.append(np.full(len(middles), min(middles, key=order.__getitem__)))
        if us:
            u, v = ids.take(pa.array(np.concatenate(us))), ids.take(pa.array(np.concatenate(vs)))
            yield pa.RecordBatch.from_arrays([u, v, pa.nulls(len(u), pa.binary())], names=schema.names)
        ends = {*([(cuts[0], cuts[1])] if first else []), *([(cuts[-2], cuts[-1])] if last else [])}
        for a, b in ends:  # a border may cut these runs
            u = ids.slice(a + int(order[a:b].argmin()), 1)
            name = b"%d:" % trees[a] + keys[a, :LEAST_DEPTH].tobytes()
            yield pa.RecordBatch.from_arrays([u, pa.nulls(1, u.type), pa.array([name], pa.binary())], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        first = True
        for batch in batches:
            table = pa.Table.from_batches([*held, batch]).combine_chunks()
            trees, keys = _columns(table)
            changed = (trees[1:] != trees[:-1]) | (keys[1:, :LEAST_DEPTH] != keys[:-1, :LEAST_DEPTH]).any(axis=1)
            last = int(np.flatnonzero(changed)[-1]) + 1 if changed.any() else 0  # the last run may go on in the next batch
            if last:
                yield from edges(trees[:last], keys[:last], table.column("doc_id").combine_chunks().slice(0, last), first, False)
                first = False
            held = table.slice(last).to_batches()
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from edges(*_columns(table), table.column("doc_id").combine_chunks(), first, True)

    def _columns(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        keys = np.frombuffer(b"".join(table.column("label").to_pylist()), ">u4").reshape(-1, DEPTH)
        return table.column("tree").to_numpy(), keys

    found = common.written(dealt.mapInArrow(run, schema))
    # At most two rows a partition.
    borders = found.where("run IS NOT NULL").select("u", F.min("u").over(Window.partitionBy("run")).alias("v")).where("u <> v")
    return found.where("run IS NULL").select("u", "v").union(borders)


def linked(ids: list, sets: list[np.ndarray], percent: int) -> Iterator[tuple]:
    """(id, id it was reached from) for every set that a search over links reaches: a spanning forest of the exact links."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    if m == 2:
        shared = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        if 100 * shared >= percent * (int(sizes.sum()) - shared):
            yield ids[1], ids[0]
        return
    starts = np.concatenate([[0], np.cumsum(sizes)])
    _, terms = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(terms, kind="stable")
    owners, of_term = np.repeat(np.arange(m), sizes)[order], terms[order]
    n_terms = int(of_term[-1]) + 1 if len(of_term) else 0
    bounds = np.searchsorted(of_term, np.arange(n_terms + 1))
    waiting = np.ones(m, bool)
    left = indexed = m
    for seed in range(m):
        if not waiting[seed]:
            continue
        waiting[seed] = False
        left -= 1
        queue = [seed]
        while queue and left:
            if left < indexed // 2:  # the index keeps only documents not reached yet
                keep = waiting[owners]
                owners, of_term, indexed = owners[keep], of_term[keep], left
                bounds = np.searchsorted(of_term, np.arange(n_terms + 1))
            q = queue.pop()
            mine = terms[starts[q] : starts[q + 1]]
            a, n = bounds[mine], bounds[mine + 1] - bounds[mine]
            at = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
            shared = np.bincount(owners[at], minlength=m)
            reached = np.flatnonzero(waiting & (100 * shared >= percent * (sizes[q] + sizes - shared)))
            waiting[reached] = False
            left -= len(reached)
            for r in reached.tolist():
                yield ids[r], ids[q]
            queue += reached.tolist()


def _sets(docs: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """doc_id and shingles of every text of ``members`` (doc_id) that has any; texts are shuffled once for all rounds."""
    id_type = docs.schema["doc_id"].dataType
    texts = common.joined(docs.select("doc_id", "text"), members.select("doc_id"), "doc_id", "left_semi", rows=members.count())
    set_schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("shingles", T.BinaryType())])

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                sets = pa.array([shingles(t, width).tobytes() for t in part.column(1).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), sets], names=set_schema.names)

    return common.written(texts.mapInArrow(to_sets, set_schema).where(F.length("shingles") > 0))


def _links(sets: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """u, v of confirmed links that connect what all links connect. ``members`` has doc_id, clump, and a and b, the two blocks that meet."""
    met = common.joined(sets, members.select("doc_id", "clump", "a", "b"), "doc_id", rows=members.count())
    met = met.repartition("clump", "a", "b").sortWithinPartitions("clump", "a", "b", "doc_id")
    id_type = sets.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("u", id_type), T.StructField("v", id_type)])

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sets, found = None, [], [], []
        for batch in batches:
            names = batch.schema.names
            clump, a, b, doc, data = (batch.column(names.index(c)) for c in ("clump", "a", "b", "doc_id", "shingles"))
            for i, now in enumerate(zip(clump.to_pylist(), a.to_pylist(), b.to_pylist(), strict=True)):
                if now != key:
                    if len(ids) > 1:
                        found += linked(ids, sets, percent)
                    key, ids, sets = now, [], []
                ids.append(doc[i].as_py())
                sets.append(np.frombuffer(data[i].as_py(), np.uint64))
            if found:
                yield _pairs(found, schema)
                found = []
        if len(ids) > 1:
            found += linked(ids, sets, percent)
        if found:
            yield _pairs(found, schema)

    return met.mapInArrow(confirm, schema)


def _pairs(found: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(schema["u"].dataType)
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], kind), pa.array([x for _, x in found], kind)], names=["u", "v"])


def _confirmed(docs: DataFrame, sized: DataFrame, width: int, percent: int, block_shingles: int) -> DataFrame:
    """node and component of every document that a confirmed link joins. ``sized`` has doc_id, n and clump."""
    cut = lambda total: F.greatest(F.lit(1), F.ceil(total / block_shingles)).cast("int")
    block = lambda blocks: F.pmod(F.xxhash64("doc_id"), F.col(blocks)).cast("int")
    n = sized.count()  # at least the rows of what is joined below
    totals = sized.groupBy("clump").agg(cut(F.sum("n")).alias("blocks"))
    members = common.written(common.joined(sized, totals, "clump", rows=n).withColumn("a", block("blocks")).withColumn("b", F.col("a")))
    sets = _sets(docs, members, width)
    links = common.written(_links(sets, members, percent))
    cut_up = members.where("blocks > 1").select("doc_id", "n", "clump")
    if not cut_up.limit(1).count():
        return graph.components(links)
    # One document of each part of two or more in a cut clump meets the other parts'.
    parts = _parts(cut_up, links)
    many = parts.groupBy("clump", "part").agg(F.count("*").alias("docs")).where("docs > 1")
    first = common.written(common.joined(parts.where("doc_id = part"), many, ["clump", "part"], "left_semi", rows=n))
    links = common.written(links.union(_links(sets, _paired(first, first, cut, block), percent)))
    parts = _parts(cut_up, links)
    largest = parts.groupBy("clump", "part").agg(F.sum("n").alias("n")).groupBy("clump").agg(F.max_by("part", F.struct("n", "part")).alias("most"), F.count("*").alias("parts"))
    apart = common.written(common.joined(parts, largest.where("parts > 1"), "clump", rows=n))
    others = apart.where("part <> most")
    return graph.components(links.union(_links(sets, _paired(others, apart, cut, block), percent)))


def _parts(members: DataFrame, links: DataFrame) -> DataFrame:
    """``members`` with part, the smallest document that links join each to."""
    reached = graph.components(links).select(F.col("node").alias("doc_id"), "component")
    return common.written(common.joined(members, reached, "doc_id", "left", rows=reached.count()).select("doc_id", "n", "clump", F.coalesce("component", "doc_id").alias("part")))


def _paired(some: DataFrame, every: DataFrame, cut, block) -> DataFrame:
    """doc_id, clump, a and b so that each document of ``some`` meets each of ``every`` (which holds them) in its clump.

    Blocks of ``some`` are numbered from 0, those of the others from -1 down; a pair of blocks has one from ``some``.
    """
    n = every.count()
    mine = some.groupBy("clump").agg(cut(2 * F.sum("n")).alias("blocks"))
    rest = common.joined(common.joined(every, some.select("doc_id", "clump"), ["doc_id", "clump"], "left_anti", rows=n), mine.withColumnRenamed("blocks", "some_blocks"), "clump", rows=n)
    sizes = rest.groupBy("clump").agg(cut(2 * F.sum("n")).alias("rest_blocks"))
    first = common.joined(common.joined(some, mine, "clump", rows=n), sizes, "clump", "left", rows=n).withColumn("own", block("blocks"))
    other = F.explode(F.sequence(-F.coalesce("rest_blocks", F.lit(0)), F.col("blocks") - 1))
    first = first.withColumn("other", other).where((F.col("other") != F.col("own")) | (F.col("blocks") - 1 + F.coalesce("rest_blocks", F.lit(0)) == 0))
    second = common.joined(rest, sizes, "clump", rows=n).withColumn("own", -1 - block("rest_blocks")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("some_blocks") - 1)))
    both = first.select("doc_id", "clump", "own", "other").union(second.select("doc_id", "clump", "own", "other"))
    return common.written(both.select("doc_id", "clump", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")))


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, region_rows: int = REGION_ROWS, block_shingles: int = BLOCK_SHINGLES
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document of ``docs`` (doc_id, text).

    Documents are linked if 100 * shared shingles >= ``percent`` * all their shingles;
    component_id is the smallest doc_id that links reach, and kept marks the document of that id.
    """
    signed = common.written(_signed(docs, width))
    whole = signed.where("doc_id IS NOT NULL AND set_hash IS NOT NULL")
    # One node for each set: the smallest doc_id; copies follow it.
    nodes = common.written(
        whole.groupBy("set_hash").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("labels").alias("labels"))
    )
    trees = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))
    forest = nodes.select(F.col("node").alias("doc_id"), "labels", trees.alias("tree"))
    forest = forest.select("doc_id", "tree", F.substring("labels", F.col("tree") * (4 * DEPTH) + 1, F.lit(4 * DEPTH)).alias("label"))
    clumps = graph.components(_candidate_edges(forest, region_rows))
    n = nodes.count()
    sized = common.joined(nodes.groupBy("node").agg(F.sum("n").alias("n")), clumps, "node", rows=n)
    linked_to = _confirmed(docs, common.written(sized.select(F.col("node").alias("doc_id"), "n", F.col("component").alias("clump"))), width, percent, block_shingles)
    # A doc_id of several sets, an empty one too, is one node: it joins the nodes of them all.
    empty_set = F.concat(F.lit("no words: "), F.col("doc_id").cast("string")).cast("binary")
    key = F.coalesce("set_hash", empty_set)
    named = signed.where("doc_id IS NOT NULL").select("doc_id", "set_hash", key.alias("key"))
    several = named.groupBy("doc_id").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high").select("doc_id")
    several = common.written(common.joined(named, several, "doc_id", rows=signed.count()).distinct())
    if more := several.count():
        own = common.joined(several, nodes, "set_hash", rows=n + more).select(F.col("doc_id").alias("u"), F.col("node").alias("v")).distinct()
        linked_to = graph.components(linked_to.select(F.col("node").alias("u"), F.col("component").alias("v")).union(own))
    firsts = nodes.select(F.col("set_hash").alias("key"), "node")
    firsts = firsts.union(several.where("set_hash IS NULL").select("key", F.col("doc_id").alias("node")))
    firsts = common.joined(firsts, linked_to, "node", "left", rows=linked_to.count()).select("key", F.coalesce("component", "node").alias("component"))
    out = common.joined(signed.select("doc_id", "n_shingles", key.alias("key")), firsts, "key", "left", rows=n + more)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

"""SimHash near-dedup of whole texts: covering masks for candidates, then an exact check of shingle sets.

Texts whose sets of five-word shingles have a similarity of 0.8 differ in about 10 bits of a 64-bit
SimHash of those shingles, which no affordable set of masks covers. Their sets of words are far closer.
So the candidates are pairs within RADIUS bits in one of PRINTS independent SimHash fingerprints of the
distinct words; each fingerprint has the covering masks of that radius (simhash.covering_masks), under
one of which every such pair collides. A pair links only if its sets of shingles are that similar.

Pairs are never emitted by a group. In each of a few rounds every bucket names a hub, the members that
are not linked to it yet are checked against it, and components are made of what links. Buckets that
then still hold members of different components are open. In those of up to CROWD members each two that
are near are checked: most hold a few that met by chance, and would connect ever more of a larger corpus.
The nodes that larger open buckets connect make clusters, which are dealt into blocks of bounded size,
and each two blocks of a cluster meet in a task that checks all candidates between different components
there by an inverted file of the shingles, and returns what links. So every link between candidates
counts, whatever the size of a bucket.

The masks take turns, so that the rows posted at a time, and the disk they take, are bounded whatever the
corpus. A side of a join that was exploded is sized by its rows before, so such joins are told to merge.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plankit.llm.arrow import lean, map_arrow, ship
from plankit.llm.components import components
from plankit.llm.scratch import written
from plankit.llm.simhash import covering_masks, fingerprint, shingle_hashes, signed
from plankit.llm.tokens import slices

#: Independent fingerprints of a text, 4 at most, and the bits in which those of a candidate may differ.
PRINTS, RADIUS = 3, 5
#: Rounds of hubs, members of an open bucket that are compared in pairs, at most, and nodes of a cluster's block, about.
ROUNDS, CROWD, BLOCK = 2, 8, 512
#: Rows posted in a turn, about.
TURN = 30_000_000
#: Rows that a task posts to the tables, about, and tasks that post, at most.
POSTED, POSTING = 1_000_000, 8192

_ADD = [np.uint64(0x9E3779B97F4A7C15 * i % (1 << 64)) for i in range(PRINTS)]
_MIX = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def prints(text: bytes) -> list[int]:
    """The fingerprints of a text's distinct words: each of other hashes, made of the words' XXH64."""
    words = np.unique(shingle_hashes(text, 1))
    found = []
    for add in _ADD:
        mixed = words + add
        for shift, times in zip((30, 27), _MIX):
            mixed = (mixed ^ (mixed >> np.uint64(shift))) * times
        found.append(fingerprint(mixed ^ (mixed >> np.uint64(31))))
    return found


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two arrays of distinct values; 1 if both are empty."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (some for b in batches for some in slices(b, 1)):
        found = [prints(t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["key", "prints"])


def _shingled(size: int):
    """Nodes with their texts in, nodes with their sorted distinct shingles out."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (some for b in batches for some in slices(b, 1)):
            sets = [np.unique(shingle_hashes(t or b"", size)).tobytes() for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "shingles"])

    return each


def _checked(least: float):
    """Pairs with their shingles in, those that are similar out."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (some for b in batches for some in slices(b, 2)):
            a, b = ([np.frombuffer(x, np.uint64) for x in batch.column(i).to_pylist()] for i in (2, 3))
            hit = [min(len(x), len(y)) >= least * max(len(x), len(y)) and similarity(x, y) >= least for x, y in zip(a, b)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["u", "v"]).filter(pa.array(hit, pa.bool_()))

    return each


def _common(sets: list[np.ndarray], asked: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For each asked set, how many values it has in common with each of the sets, by an inverted file."""
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, of = values[order], np.repeat(np.arange(len(sets)), list(map(len, sets)))[order]
    for some in asked:
        starts, ends = np.searchsorted(values, some), np.searchsorted(values, some, "right")
        sizes = ends - starts
        at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        yield np.bincount(of[at], minlength=len(sets))


def cell_links(nodes: np.ndarray, roots: np.ndarray, marks: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Links (u, v) between candidates of the left and the right places, enough of them for the same components."""
    parent = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    found = []
    sizes = np.asarray(list(map(len, sets)))
    near = np.zeros((len(left), len(right)), bool)
    for p in range(marks.shape[1]):
        near |= np.bitwise_count(marks[left, p][:, None] ^ marks[right, p][None, :]) <= RADIUS
    near &= roots[left][:, None] != roots[right][None, :]
    asked = np.flatnonzero(near.any(axis=1))
    for i, common in zip(asked, _common([sets[j] for j in right], [sets[i] for i in left[asked]])):
        u = left[i]
        whole = sizes[u] + sizes[right] - common
        for j in right[near[i] & ((common >= least * whole) | (whole == 0))]:
            a, b = root(roots[u]), root(roots[j])
            if a != b:
                parent[a] = b
                found.append((nodes[u], nodes[j]))
    return found


def _cell(least: float):
    def each(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side = table["side"].to_numpy()
        marks = np.asarray(table["prints"].to_pylist(), np.int64).view(np.uint64)
        sets = [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]
        left = np.flatnonzero(side != 1)  # -1: a block with itself
        right = np.flatnonzero(side != 0)
        found = cell_links(table["node"].to_numpy(), table["root"].to_numpy(), marks, sets, left, right, least)
        u, v = zip(*found) if found else ((), ())
        return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return each


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def _key(text_col: str) -> Column:
    return F.md5(_text(text_col).cast("binary"))


def dealt(nodes: DataFrame, tables: int) -> DataFrame:
    """nodes, dealt out to so many tasks that each posts about POSTED rows: of a few files of nodes a task would make hundreds of times their rows."""
    return nodes.repartition(min(POSTING, 1 + nodes.count() * tables // POSTED), "node")


def _members(nodes: DataFrame) -> DataFrame:
    """(at, node, n, fp): the buckets of two nodes or more, each with its members, their number and their fingerprints."""
    masks = [F.struct(F.lit(i).alias("nth"), F.lit(i // len(near)).alias("of"), F.lit(signed(m)).alias("mask")) for near in [covering_masks(RADIUS)] for i, m in enumerate(near * PRINTS)]
    turns = min(len(masks), 1 + nodes.count() * len(masks) // TURN)
    made = []
    for turn in range(turns):
        some = masks[turn::turns]
        spread = dealt(nodes.select("node", "prints"), len(some)).select("node", "prints", F.explode(F.array(*some)).alias("t"))
        # a bucket's number ends in that of its fingerprint, so that the rows that are dealt out are narrow
        bucket = F.xxhash64("t.nth", F.get("prints", F.col("t.of")).bitwiseAND(F.col("t.mask")))
        posted = spread.select(F.shiftleft(bucket, 2).bitwiseOR(F.col("t.of").cast("long")).alias("at"), "node")
        shared = posted.withColumn("n", F.count("*").over(Window.partitionBy("at"))).where("n > 1")
        marked = shared.join(nodes.select("node", "prints").hint("merge"), "node")
        made.append(written(marked.select("at", "node", "n", F.get("prints", F.col("at").bitwiseAND(F.lit(3)).cast("int")).alias("fp")), "members")[0])
    return reduce(DataFrame.unionByName, made)


def links(docs: DataFrame, text_col: str = "text", size: int = 5, least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(key, node): each different text of docs, by its MD5, with a number; and stars (node, root) of those that are linked.

    A root has no row among the stars. Null texts are empty ones; texts without words are alike.
    """
    texts = docs.select(_key(text_col).alias("key"), _text(text_col).alias("text"))
    marks, _ = written(map_arrow(texts, lean(_printed), "key string, prints array<long>"), "prints")
    nodes, _ = written(marks.dropDuplicates(["key"]).withColumn("node", F.monotonically_increasing_id()), "nodes")
    members = _members(nodes)
    used = members.select("node").distinct().join(nodes.select("key", "node"), "node")
    held = texts.join(used, "key").dropDuplicates(["key"]).select("node", "text")
    held, _ = written(map_arrow(held, lean(_shingled(size)), "node long, shingles binary"), "shingles")

    def checked(pairs: DataFrame) -> DataFrame:
        for c, name in (("u", "a"), ("v", "b")):
            pairs = pairs.join(held.select(F.col("node").alias(c), F.col("shingles").alias(name)), c)
        return map_arrow(pairs.select("u", "v", "a", "b"), lean(_checked(least)), "u long, v long")

    stars = docs.sparkSession.createDataFrame([], "node long, root long")

    def joined(found: DataFrame) -> DataFrame:
        """The stars of all links so far: what is found, and the stars before, which stand for the links before."""
        linked = written(found, "links")[0].unionByName(stars.select(F.col("node").alias("u"), F.col("root").alias("v")))
        return components(linked).select(F.col("u").alias("node"), F.col("v").alias("root"))

    def opened() -> tuple[DataFrame, DataFrame]:
        """Members with the roots of their components, and the buckets that hold different ones."""
        rooted = members.join(stars, "node", "left").withColumn("root", F.coalesce("root", "node"))
        return rooted, rooted.groupBy("at").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("at")

    for turn in range(ROUNDS):
        rooted, open_ = opened()
        hub = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("order"), "node", "fp", "root"))
        hubs = rooted.groupBy("at").agg(hub.alias("hub")).select("at", "hub.node", "hub.fp", "hub.root")
        a, b = rooted.join(open_, "at").alias("a"), hubs.alias("b")
        apart = (F.col("a.root") != F.col("b.root")) & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= RADIUS)
        pairs = a.join(b, (F.col("a.at") == F.col("b.at")) & apart).select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v"))
        stars = joined(checked(pairs.distinct()))
    rooted, open_ = opened()
    some, _ = written(rooted.join(open_, "at").select("at", "node", "n", "fp", "root"), "open")
    few = some.where(F.col("n") <= CROWD)
    a, b = few.alias("a"), few.alias("b").hint("merge")
    apart = (F.col("a.node") < F.col("b.node")) & (F.col("a.root") != F.col("b.root")) & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= RADIUS)
    pairs = a.join(b, (F.col("a.at") == F.col("b.at")) & apart).select(F.col("a.node").alias("u"), F.col("b.node").alias("v"))
    some = some.where(F.col("n") > CROWD)
    firsts = some.groupBy("at").agg(F.min("node").alias("v"))
    clusters = components(some.join(firsts, "at").select(F.col("node").alias("u"), "v"))
    placed = some.select("node", "root").distinct().join(clusters.select(F.col("u").alias("node"), F.col("v").alias("cluster")), "node", "left")
    placed = placed.withColumn("cluster", F.coalesce("cluster", "node"))
    blocks = placed.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = placed.join(blocks, "cluster").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("mine") == F.col("other"), -1).otherwise((F.col("mine") > F.col("other")).cast("int"))
    cells = spread.select("cluster", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), side.alias("side"), "node", "root")
    cells = cells.join(nodes.select("node", "prints").hint("merge"), "node").join(held.hint("merge"), "node")
    ship(docs.sparkSession)
    rest = cells.groupBy("cluster", "i", "j").applyInArrow(_cell(least), "u long, v long")
    return nodes.select("key", "node"), joined(checked(pairs.distinct()).unionByName(rest))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, least: float = 0.8) -> DataFrame:
    """docs with one row of each group of near-duplicates: that of the smallest doc_id, of none if all lack it.

    Rows are told apart by doc_id and text, so rows that share a doc_id, or lack it, are grouped by
    their texts like others. Null texts and those without words are equal. Of rows that repeat both
    doc_id and text one stays. An empty table gives none. All columns of docs are returned.
    """
    nodes, stars = links(docs, text_col, size, least)
    marked = docs.select(F.col(id_col).cast("long").alias("_id"), _key(text_col).alias("key"))
    # of each text the smallest id first, so that what is joined has a row for each text
    ids = marked.groupBy("key").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("key").alias("at"))).alias("first"))
    rooted = ids.join(nodes, "key").join(stars, "node", "left").select(F.coalesce("root", "node").alias("root"), "first")
    kept = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.none").alias("_none"), F.coalesce("first.id", F.lit(0).cast("long")).alias("_id"), F.col("first.at").alias("_key"))
    # null ids as a mark and 0, so that the join and what drops repeated rows share one shuffle
    row = ["_none", "_id", "_key"]
    named = docs.withColumns({"_none": F.col(id_col).isNull(), "_id": F.coalesce(F.col(id_col).cast("long"), F.lit(0).cast("long")), "_key": _key(text_col)})
    return named.join(kept.hint("merge"), row, "left_semi").dropDuplicates(row).select(*docs.columns)

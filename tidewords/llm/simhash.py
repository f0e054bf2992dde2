"""Near-duplicates by SimHash: vantage-point trees over fingerprints, then connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tidewords.llm.common import batches, give_back, read, segments, settle, texts

SHINGLE = 4
RADIUS = 4
#: Fingerprints that share a segment of 21 bits can't be told apart in it; beyond so many, segments are longer and balls wider.
CROWD = 1 << 25
#: Fingerprints a shard is meant to hold, and those that shape the trees.
SHARD_SIZE, SAMPLE = 256, 4096
_BRUTE = 1 << 22
#: Parts over which a node's links are dealt where they meet its least neighbour.
SPREAD = 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of a text's word shingles, repeats included; fewer words make one shingle, none give 0.

    A long text is taken in parts with the counts of bits carried on.
    """
    bits, n, words = np.zeros(64, np.int64), 0, []
    for part in segments(text, 1 << 20):
        words += part.lower().split()  # bytes: only A-Z changes, only the six ASCII white-space characters part
        if len(words) >= shingle:
            joined, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            starts = np.concatenate(([0], ends[:-shingle])).tolist()
            hashes = [xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
            bits += _ones(hashes)
            n, words = n + len(hashes), words[len(words) - shingle + 1 :]
    if not n and words:
        bits, n = _ones([xxhash.xxh64_intdigest(b" ".join(words), 42)]), 1
    return int.from_bytes(np.packbits(2 * bits > n, bitorder="little").tobytes(), "little")


def _ones(hashes: list[int]) -> np.ndarray:
    """How many of the hashes have each bit."""
    return np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


@F.arrow_udf(LongType())
def simhash(text: pa.Array) -> pa.Array:
    parts = batches(iter([pa.RecordBatch.from_arrays([text], ["text"])]), 2 << 20)
    prints = [fingerprint(t) for part in parts for t in texts(part)]
    give_back()
    return pa.array(np.array(prints, np.uint64).view(np.int64))


def segment_masks(parts: int) -> tuple[list[np.uint64], int]:
    """The 64 bits in so many segments, and the most bits that differ in one of them where ``RADIUS`` differ in all."""
    cuts = [64 * k // parts for k in range(parts + 1)]
    return [np.uint64(((1 << b - a) - 1) << a) for a, b in zip(cuts, cuts[1:], strict=False)], RADIUS // parts


def _distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class VantageTree:
    """A complete vantage-point tree over one segment's Hamming space.

    A level has one vantage point; a node splits at the median distance of the sample that reaches it. The
    tree is shaped by a bounded sample, but any fingerprint finds its home leaf, and a ball overlaps exactly
    the leaves that the triangle bounds leave open.
    """

    def __init__(self, sample: np.ndarray, mask: np.uint64, levels: int, seed: int):
        random = np.random.default_rng(seed)
        self.mask, self.levels = mask, levels
        pool = np.unique(sample & mask) if len(sample) else np.zeros(1, np.uint64)
        self.points = pool[random.integers(0, len(pool), levels)] if levels else np.zeros(0, np.uint64)
        self.radius: list[np.ndarray] = []
        node = np.zeros(len(sample), np.int64)
        usual = np.array([int(mask).bit_count() // 2])
        for level in range(levels):
            d = _distance(sample & mask, self.points[level]).astype(np.int64)
            radius = usual.copy()
            order = np.lexsort((d, node))
            first, count = np.searchsorted(node[order], np.arange(1 << level)), np.bincount(node, minlength=1 << level)
            full = np.flatnonzero(count >= 8)
            if not len(full):  # from here on nodes keep the radius of their ancestor, which needs no room
                break
            radius[full] = d[order][first[full] + (count[full] - 1) // 2]
            self.radius.append(radius)
            node = node * 2 + (d > radius[node])
            usual = np.repeat(radius, 2)
        self.usual = usual

    def route(self, prints: np.ndarray, ball: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, leaves and whether the leaf is the row's home, for each leaf that a row's ball overlaps."""
        row, node, home = np.arange(len(prints)), np.zeros(len(prints), np.int64), np.ones(len(prints), bool)
        for level in range(self.levels):
            d = _distance(prints & self.mask, self.points[level]).astype(np.int64)[row]
            r = self.radius[level][node] if level < len(self.radius) else self.usual[node >> level - len(self.radius)]
            inner, outer = np.flatnonzero(d - ball <= r), np.flatnonzero(d + ball > r)
            inside = d <= r
            row, home = np.concatenate((row[inner], row[outer])), np.concatenate(((home & inside)[inner], (home & ~inside)[outer]))
            node = np.concatenate((node[inner] * 2, node[outer] * 2 + 1))
        return row, node, home


class Groups:
    """Union-find over positions; a root is the smallest position of its group."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, at: np.ndarray) -> np.ndarray:
        up = self.parent[at]
        while len(at) and (higher := self.parent[up] != up).any():
            up = np.where(higher, self.parent[up], up)
        self.parent[at] = up
        return up

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.roots(a), self.roots(b)
        while (apart := a != b).any():
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))
            a, b = self.roots(a), self.roots(b)


def link(prints: np.ndarray, home: np.ndarray, query: np.ndarray, groups: Groups, radius: int = RADIUS) -> None:
    """Unite every query with every home print within ``radius``: a vantage-point search, halves at a time."""
    if not len(home) or not len(query):
        return
    if len(home) * len(query) > _BRUTE:
        point = prints[home[len(home) // 2]]
        d, dq = _distance(prints[home], point).astype(np.int64), _distance(prints[query], point).astype(np.int64)
        near = home[2 * d <= radius]  # any two of these are within the radius of each other
        groups.unite(near, np.full(len(near), near[0]))
        r = int(np.sort(d)[(len(d) - 1) // 2])
        if (d > r).any():
            link(prints, home[d <= r], query[dq <= r + radius], groups, radius)
            link(prints, home[d > r], query[dq > r - radius], groups, radius)
            return
    step = max(1, _BRUTE // len(home))
    for k in range(0, len(query), step):
        some = query[k : k + step]
        a, b = np.nonzero(_distance(prints[some][:, None], prints[home][None, :]) <= radius)
        groups.unite(some[a], home[b])


def _shards(trees: list[VantageTree], ball: int):
    def route(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(0, len(prints), 4096):
                for segment, tree in enumerate(trees):
                    row, node, home = tree.route(prints[k : k + 4096], ball)
                    yield pa.RecordBatch.from_arrays([pa.array(segment + len(trees) * node), pa.array(prints[k : k + 4096][row].view(np.int64)), pa.array(home)], ["cell", "print", "home"])

    return route


def _forest(prints: np.ndarray, home: np.ndarray) -> pa.RecordBatch:
    groups, every = Groups(len(prints)), np.arange(len(prints))
    link(prints, every[home], every, groups)
    root = groups.roots(every)
    kept = np.flatnonzero(root != every)
    return pa.RecordBatch.from_arrays([pa.array(prints[kept].view(np.int64)), pa.array(prints[root[kept]].view(np.int64))], ["a", "b"])


def _link_shards(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One shard after the other of rows that come sorted by cell; links leave as a spanning forest."""
    cell, held = None, []
    for batch in source:
        cells = batch.column(0).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1]))).tolist() if len(cells) else []
        for a, b in zip(starts, [*starts[1:], len(cells)], strict=True):
            if cells[a] != cell and held:
                yield _forest(*map(np.concatenate, zip(*held, strict=True)))
                held = []
            cell = cells[a]
            part = batch.slice(a, b - a)
            held.append((part.column(1).to_numpy(zero_copy_only=False).view(np.uint64), part.column(2).to_numpy(zero_copy_only=False)))
    if held:
        yield _forest(*map(np.concatenate, zip(*held, strict=True)))
    give_back()


def near_links(prints: DataFrame, parts: int | None = None) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column print) that connect all pairs within ``RADIUS`` bits.

    Two that differ by 4 bits differ by at most 1 in one of three segments, or by 2 in one of two; each segment has
    a tree, and ``parts`` is chosen by the number of fingerprints unless given. The links are the same either way.
    Pairs inside a shard are never listed: each shard sends a spanning forest of what it found.
    """
    n = prints.count()
    masks, ball = segment_masks(parts or (3 if n < CROWD else 2))
    levels = max(0, int(np.ceil(np.log2(max(1, n / SHARD_SIZE)))))
    sample = np.array([r[0] for r in prints.orderBy(F.xxhash64("print")).limit(SAMPLE).collect()], np.int64).view(np.uint64)
    trees = [VantageTree(sample, mask, levels, seed) for seed, mask in enumerate(masks)]
    routed = prints.select("print").mapInArrow(_shards(trees, ball), "cell long, print long, home boolean")
    return routed.repartition("cell").sortWithinPartitions("cell").mapInArrow(_link_shards, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of the links (a, b).

    Large-star and small-star steps by turns; every step points nodes at the least neighbour of a node, so a
    chain shrinks by half and more. Each round is checkpointed, and the loop ends when no link changes.
    """
    def meet(sided: DataFrame, least: DataFrame) -> DataFrame:
        """Each link with its node's least neighbour; a hub's links are dealt over several tasks."""
        parts = least.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
        return sided.withColumn("__part", F.pmod(F.xxhash64("b"), F.lit(SPREAD)).cast("int")).join(parts.hint("merge"), ["a", "__part"]).drop("__part")

    edges = settle(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = meet(both.where("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        edges = settle(meet(large, least).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def group_prints(hashed: DataFrame) -> DataFrame:
    """(print, component): a fingerprint's component, named by its least fingerprint; from a column ``print``."""
    prints = settle(hashed.groupBy("print").agg(F.count("*").alias("rows")))
    roots = components(near_links(prints))
    return prints.join(roots, prints.print == roots.node, "left").select("print", F.coalesce("root", "print").alias("component"))


def simhash_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs``; component_id is the least id reachable.

    Null and empty texts and texts of white space alone have fingerprint 0 and link like any other. Equal
    texts have equal fingerprints and share a component. Null ids are passed over as component ids (null only
    where all ids of a component are null); repeated rows are returned as often; an empty table gives no rows.
    """
    hashed = settle(docs.select("doc_id", simhash("text").alias("print")))
    groups = group_prints(hashed)
    named = hashed.groupBy("print").agg(F.min("doc_id").alias("least")).join(groups, "print")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = _by_component(named, least).select("print", "component_id")
    return hashed.join(named, "print").select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def _by_component(named: DataFrame, least: DataFrame) -> DataFrame:
    """Both joined by component; a component's fingerprints are dealt over several tasks."""
    parts = least.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return named.withColumn("__part", F.pmod(F.xxhash64("print"), F.lit(SPREAD)).cast("int")).join(parts, ["component", "__part"]).drop("__part")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of all documents; see ``simhash_groups`` for nulls, empty texts and repeated rows."""
    return simhash_groups(read(spark, sf_dir, "documents"))


def near_dedup(docs: DataFrame) -> DataFrame:
    """One row of each component of ``docs``, with all its columns: the least doc_id (null last), then the least fingerprint.

    Of rows alike in id and text any one stays. Null and empty texts have fingerprint 0 and are near-duplicates of each
    other; ids may be of any type; no column name clashes; an empty table gives no rows. Texts are fingerprinted once;
    rows are found again by two hashes of id and text.
    """
    marks = (F.xxhash64("doc_id", "text").alias("mark"), F.hash("text", "doc_id").alias("mark2"))
    slim = settle(docs.select("doc_id", *marks, simhash("text").alias("print")))
    pick = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "print", "mark", "mark2")
    named = slim.groupBy("print").agg(F.min(pick).alias("pick")).join(group_prints(slim), "print")
    chosen = named.groupBy("component").agg(F.min("pick").alias("pick")).select("pick.mark", "pick.mark2")
    rows = docs.select(*marks, F.struct(*docs.columns).alias("row")).join(chosen, ["mark", "mark2"], "left_semi")
    first = F.row_number().over(Window.partitionBy("mark", "mark2").orderBy("mark"))
    return rows.withColumn("place", first).where("place = 1").select("row.*")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates; see ``near_dedup`` for the edges."""
    return near_dedup(docs)

"""SimHash near-duplicates linked through BK-trees."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from tenantlens.llm.common import groups, stage, table
from tenantlens.llm.components import components

BITS = 64
RADIUS = 3
WORDS = 3
BLOCKS = 6
TREE_NODES = 4096
_SLAB = 1 << 18


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """64-bit SimHash of the word shingles of a text; 0 without words.

    A-Z are lower-cased; words are runs without ASCII white space; a text of
    fewer words is one shingle. Bits set in more than half of the shingle
    hashes are set.
    """
    w = text.encode().lower().split() if text else []
    if not w:
        return 0
    joined = b" ".join(w)
    if len(w) <= words:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    n, ones = len(w) - words + 1, np.zeros(BITS, np.int64)
    spans = list(zip(starts[:n].tolist(), ends[words - 1:].tolist()))
    for a in range(0, n, _SLAB):
        h = np.array([digest(joined[s:e], 42) for s, e in spans[a:a + _SLAB]], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp) per row; fp is the fingerprint as a signed long."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t, words) for t in b["text"]], "<u8").view("<i8")
            yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy(), "fp": fp})

    narrow = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    ids = docs.schema["doc_id"].dataType
    return narrow.mapInPandas(run, "doc_id string, fp long").select(F.col("doc_id").cast(ids).alias("doc_id"), "fp")


class Tree:
    """BK-tree: a child hangs below its parent under their Hamming distance."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.children: list[dict[int, int]] = [{} for _ in points]
        values = points.tolist()
        for i in range(1, len(values)):
            at = 0
            while True:
                d = (values[i] ^ values[at]).bit_count()
                nxt = self.children[at].get(d)
                if nxt is None:
                    self.children[at][d] = i
                    break
                at = nxt

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(node, indexes of the queries within the radius), all queries walking the tree together."""
        todo = [(0, np.arange(len(queries)))] if len(self.points) and len(queries) else []
        while todo:
            node, idx = todo.pop()
            d = np.bitwise_count(queries[idx] ^ self.points[node]).astype(np.int64)
            near = idx[d <= radius]
            if len(near):
                yield node, near
            for edge, child in self.children[node].items():
                follow = idx[np.abs(d - edge) <= radius]
                if len(follow):
                    todo.append((child, follow))


def _masks(radius: int, blocks: int) -> list[int]:
    """Bit masks of every choice of blocks - radius blocks out of ``blocks``."""
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    part = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    unsigned = [sum(c) for c in combinations(part, blocks - radius)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in unsigned]


def _local_links(radius: int):
    """Per tree shard and query shard: a spanning set of the links found."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in groups(batches, ["block", "key", "tree", "query"]):
            fp, shard = g["fp"].to_numpy().view("<u8"), g["shard"].to_numpy()
            tree, query = int(g["tree"].iloc[0]), int(g["query"].iloc[0])
            mine = np.flatnonzero(shard == tree)
            other = mine if tree == query else np.flatnonzero(shard == query)
            label = np.arange(len(fp))
            for node, near in Tree(fp[mine]).within(fp[other], radius):
                met = np.unique(label[np.append(other[near], mine[node])])
                if len(met) > 1:
                    label[np.isin(label, met)] = met[0]
            linked = np.flatnonzero(label != np.arange(len(fp)))
            if len(linked):
                yield pd.DataFrame({"a": fp[linked].view("<i8"), "b": fp[label[linked]].view("<i8")})
    return run


def links(points: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, tree_nodes: int = TREE_NODES) -> DataFrame:
    """Spanning links (a, b) between distinct fingerprints (column fp) at most ``radius`` bits apart.

    Of ``blocks`` bit blocks two such fingerprints share all but ``radius``, so
    every choice of shared blocks is one shard key. A shard key with many
    fingerprints is cut in trees of about ``tree_nodes`` nodes, and each tree is
    sent to each shard of queries with the same key; sending all trees
    to all executors would grow with the corpus.
    """
    keyed = points.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("block"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
                                                    for i, m in enumerate(_masks(radius, blocks))])).alias("k")).select("fp", "k.*")
    shared = stage(keyed.groupBy("block", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    cut = F.ceil(F.col("n") / F.lit(tree_nodes)).cast("int")
    member = keyed.join(shared, ["block", "key"]).withColumn("shards", cut).withColumn(
        "shard", F.pmod(F.xxhash64("fp"), F.col("shards")).cast("int"))
    paired = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).select(
        "block", "key", F.least("shard", "other").alias("tree"), F.greatest("shard", "other").alias("query"), "shard", "fp")
    by = ["block", "key", "tree", "query"]
    width = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return paired.repartition(width, *by).sortWithinPartitions(*by, "fp").mapInPandas(_local_links(radius), "a long, b long")


def near_duplicates(docs: DataFrame, *, words: int = WORDS, radius: int = RADIUS, blocks: int = BLOCKS,
                    tree_nodes: int = TREE_NODES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, fingerprint, component_id.

    component_id is the smallest doc_id reachable over links of at most
    ``radius`` bits, the document itself included. Null and wordless texts have
    fingerprint zero and are linked like any other. Rows that repeat a doc_id
    each get their row; a null doc_id is a row that never names a component
    (null where a component has no other). Other columns are ignored, an empty
    table gives an empty result.
    """
    prints = stage(fingerprints(docs, words))
    points = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = stage(components(links(points.select("fp"), radius, blocks, tree_nodes)))
    member = points.join(roots, points.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = stage(member.groupBy("root").agg(F.min("first").alias("component_id")))
    named = stage(member.join(smallest, "root").select("fp", "component_id"))
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` whose document names its component: one of each near-duplicate group.

    A text of a row with a null id has no id to be named by; such rows stay.
    Rows that repeat doc_id and text together both stay or both go.
    """
    found = stage(near_duplicates(docs, **options).where("doc_id = component_id").select(F.col("doc_id").alias("_keep")).distinct())
    kept = docs.join(found, docs["doc_id"] == found["_keep"], "left_semi")
    return kept.unionByName(docs.where(F.col("doc_id").isNull()))


def op9_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op9_simhash_bktree": op9_simhash_bktree}

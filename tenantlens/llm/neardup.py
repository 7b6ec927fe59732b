"""Near-duplicate documents: SimHash through BK-trees and MinHash bands over word shingles, exact Jaccard, distributed union-find."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tenantlens.llm import simhash
from tenantlens.llm.common import stage, text_key
from tenantlens.llm.components import components

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5  # meets 99.993 % of pairs at 0.8 and more above
SHARD = 1024  # members of a bucket paired by one task
PAIRS = 4  # a bucket table's pairs may be so many times its rows before pivots are tried first
_SLAB = 1 << 12
_MIX = np.random.default_rng(5).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def words_of(text: str | None) -> list[bytes]:
    """Runs without ASCII white space, A-Z in lower case."""
    return text.encode().lower().split() if text else []


def shingle_hashes(w: list[bytes], words: int = WORDS) -> np.ndarray:
    """Different 64-bit hashes of the word shingles, sorted; fewer words are one shingle, none give none."""
    if not w:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    one = np.fromiter((digest(x, 42) for x in w), np.uint64, len(w))
    size = min(words, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for k in range(size):
        h = (h ^ one[k:len(w) - size + 1 + k]) * _ODD[0]
        h ^= h >> np.uint64(29)
    h *= _ODD[1]
    h ^= h >> np.uint64(32)
    return np.unique(h * _ODD[2])


def band_keys(h: np.ndarray) -> np.ndarray:
    """A 64-bit bucket per band of MinHash rows."""
    low = np.full(len(_MIX), np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(h), _SLAB):
        x = h[None, a:a + _SLAB] * _MIX[:, None]
        np.minimum(low, x.min(axis=1), out=low)
    s = low.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _ODD[0]
    for r in range(ROWS):
        key = (key ^ s[:, r]) * _ODD[1]
        key ^= key >> np.uint64(30)
    return key.view(np.int64)


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("string").alias("id"), text_key(F.col("text")).alias("text_id"), "text")


def signed(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, text_id, node, n, buckets, fp) per row: node is a digest of the words, n the number of different shingles, fp the SimHash."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t in b["text"]:
                w = words_of(t)
                h = shingle_hashes(w, words)
                rows.append((hashlib.md5(b" ".join(w), usedforsecurity=False).digest(), len(h), band_keys(h) if len(h) else []))
            made = pd.DataFrame(rows, columns=["node", "n", "buckets"])
            made["fp"] = np.array([simhash.fingerprint(t, words) for t in b["text"]], "<u8").view("<i8")
            yield pd.concat([b[["id", "text_id"]].reset_index(drop=True), made], axis=1)

    kind = docs.schema["doc_id"].dataType
    made = _narrow(docs).mapInPandas(run, "id string, text_id binary, node binary, n int, buckets array<long>, fp long")
    return made.select(F.col("id").cast(kind).alias("doc_id"), "text_id", "node", "n", "buckets", "fp")


def spot() -> Column:
    """Order of rows: by doc_id, a null last, then by text."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("text_id").alias("text_id"))


def rows_at(docs: DataFrame, spots: DataFrame) -> DataFrame:
    """Rows of ``docs`` (their columns in ``_row``) at the given (doc_id, text_id), with the other columns of ``spots``."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_id"), text_key(F.col("text")).alias("_key"))
    return rows.join(spots, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("text_id"))).drop("_id", "_key")


def _shingled(texts: DataFrame, words: int) -> DataFrame:
    """(node, hashes) of (node, text)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"node": b["node"], "hashes": [shingle_hashes(words_of(t), words).view(np.int64) for t in b["text"]]})

    return texts.select("node", "text").mapInPandas(run, "node binary, hashes array<long>")


def _verified(pairs: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) whose exact Jaccard is ``similarity`` or more."""
    one = held.select(F.col("node").alias("a"), F.col("hashes").alias("x"))
    two = held.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", F.size("x").alias("n"), F.size("y").alias("m"), F.size(F.array_intersect("x", "y")).alias("both"))
    return both.where(F.col("both") >= F.lit(similarity) * (F.col("n") + F.col("m") - F.col("both"))).select("a", "b")


def _comparable(n: str, m: str, similarity: float) -> Column:
    return F.least(n, m) >= F.lit(similarity) * F.greatest(n, m)


def _cross(met: DataFrame, similarity: float, shard: int) -> DataFrame:
    """Different pairs (a, b) of members of one bucket and different components."""
    shards = stage(met.groupBy("members").agg(F.ceil(F.count(F.lit(1)) / F.lit(shard)).cast("int").alias("shards")))
    cut = met.join(shards, "members")
    left = cut.select("members", F.pmod(F.xxhash64("node"), F.col("shards")).cast("int").alias("shard"),
                      F.col("node").alias("a"), F.col("n").alias("an"), F.col("root").alias("ar"))
    right = cut.select("members", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"),
                       F.col("node").alias("b"), F.col("n").alias("bn"), F.col("root").alias("br"))
    met_twice = left.join(right, ["members", "shard"]).where((F.col("a") < F.col("b")) & (F.col("ar") != F.col("br")))
    return met_twice.where(_comparable("an", "bn", similarity)).select("a", "b").distinct()


def with_simhash(nodes: DataFrame) -> DataFrame:
    """``nodes`` with one more bucket each: what links of three bits connect in the BK-trees. Nodes without shingles get none."""
    points = stage(nodes.where("n > 0").select("fp").distinct())
    roots = stage(components(simhash.links(points)))
    met = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    own = F.when(F.col("n") > 0, F.array(F.xxhash64(F.lit("simhash"), F.coalesce("root", "fp")))).otherwise(F.array().cast("array<long>"))
    return met.withColumn("buckets", F.concat("buckets", own)).drop("root")


def links(nodes: DataFrame, held, *, similarity: float = SIMILARITY, shard: int = SHARD) -> DataFrame:
    """Links (a, b) that connect what exact Jaccard connects among nodes (node, n, buckets) that share a bucket.

    ``held`` gives (node, hashes) for the nodes asked for. Members of a bucket
    are compared with its smallest first; the pairs left are those of
    different components, and buckets with many of them get further pivots
    while that halves the pairs.
    """
    one = nodes.select("node", "n", F.explode("buckets").alias("bucket"))
    mixed = F.sum(F.xxhash64("node").cast("decimal(38,0)"))
    shared = stage(one.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), mixed.alias("members")).where("size > 1").select("bucket", "members"))
    met = stage(one.join(shared, "bucket").select("members", "node", "n").distinct())
    held = stage(held(met.select("node").distinct()))
    found, pairs_before = None, None
    while True:
        low = stage(met.groupBy("members").agg(F.min(F.struct("node", "n")).alias("low")).select("members", F.col("low.node").alias("b"), F.col("low.n").alias("m")))
        pairs = met.select("members", F.col("node").alias("a"), "n").join(low, "members").where((F.col("a") != F.col("b")) & _comparable("n", "m", similarity))
        new = stage(_verified(pairs.select("a", "b").distinct(), held, similarity))
        found = new if found is None else found.unionByName(new)
        roots = stage(components(found))
        rest = met.select("members", "node", "n").join(low.select("members", "b"), "members").where(F.col("node") != F.col("b")).drop("b")
        rest = rest.join(roots, "node", "left").select("members", "node", "n", F.coalesce("root", "node").alias("root"))
        mixed_ones = stage(rest.groupBy("members").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y").select("members"))
        met = stage(rest.join(mixed_ones, "members"))
        sizes = met.groupBy("members", "root").agg(F.count(F.lit(1)).cast("double").alias("c")).groupBy("members").agg(
            F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("own"))
        rows, all_pairs = sizes.agg(F.sum("n"), F.sum((F.col("n") * F.col("n") - F.col("own")) / 2)).first()
        if not rows:
            return found
        if all_pairs <= PAIRS * rows or (pairs_before is not None and 2 * all_pairs > pairs_before):
            return found.unionByName(_verified(_cross(met, similarity, shard), held, similarity))
        pairs_before = all_pairs


def keep_one(docs: DataFrame, *, words: int = WORDS, similarity: float = SIMILARITY, **options) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the first by doc_id (null last) and text.

    Groups are what links of at least ``similarity`` connect, measured as the
    exact Jaccard of the word shingle sets. Compared are texts that share a
    MinHash band or a component of SimHash fingerprints (operator 9's
    BK-trees, three bits), whose links alone decide nothing. Texts with the same words are one
    node; null and wordless texts are one group. Of rows that repeat doc_id and
    text one stays.
    """
    rows = stage(signed(docs, words))
    nodes = stage(rows.groupBy("node").agg(F.min(spot()).alias("spot"), F.first("n").alias("n"), F.first("buckets").alias("buckets"), F.first("fp").alias("fp")))
    nodes = stage(with_simhash(nodes))

    def held(wanted: DataFrame) -> DataFrame:
        spots = nodes.join(wanted, "node", "left_semi").select("node", "spot.doc_id", "spot.text_id")
        texts = rows_at(docs, stage(spots)).select("node", F.col("_row.text").alias("text"))
        return _shingled(texts.dropDuplicates(["node"]), words)

    roots = stage(components(links(nodes.select("node", "n", "buckets"), held, similarity=similarity, **options)))
    joined = nodes.select("node", "spot").join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "spot")
    first = stage(joined.groupBy("root").agg(F.min("spot").alias("spot")).select("spot.doc_id", "spot.text_id"))
    again = stage(rows.groupBy("doc_id", "text_id").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("doc_id", "text_id"))
    same = F.col("f.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("f.text_id") == F.col("g.text_id"))
    once, many = (stage(first.alias("f").join(again.alias("g"), same, kind)) for kind in ("left_anti", "left_semi"))
    kept = rows_at(docs, once).select("_row").unionByName(rows_at(docs, many).dropDuplicates(["doc_id", "text_id"]).select("_row"))
    return kept.select("_row.*")

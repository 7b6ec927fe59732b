"""Ranked lexical search by NRA: impact-sorted lists read in step, score intervals per document."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tenantlens.llm.common import stage, table

TOP = 50
BLOCK_CHARS = 1 << 20  # of item texts whose terms are looked up in one pass over the documents
SHARD_POSTINGS = 1_000_000  # of the documents that share one set of lists
SHARD_DOCUMENTS = 50_000
FIRST_READ = 64  # postings a list gives in the first step; each step doubles the depth
# UTF-8 bytes of a term: digits, letters, everything from 0x80 up; A-Z become a-z, all else a blank
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


def counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, term, tf) of each document with a term: how many it has, the known ones (arrays of number and occurrences)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"], b["text"]):
                words = terms_of(text)
                if words:
                    times = Counter(words)
                    met = [(vocabulary[w], times[w]) for w in times.keys() & vocabulary.keys()]
                    rows.append((doc_id, len(words), [t for t, _ in met], [k for _, k in met]))
            yield pd.DataFrame(rows, columns=["doc_id", "n", "term", "tf"])

    kind = docs.schema["doc_id"].dataType
    made = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, "doc_id string, n long, term array<int>, tf array<int>")
    return made.withColumn("doc_id", F.col("doc_id").cast(kind))


def weight(df: Column, documents: Column) -> Column:
    return F.floor(F.lit(1000.0) * F.log((2.0 * documents + 2.0) / (2.0 * df + 1.0))).cast("long")


def best(lists: list[tuple[np.ndarray, np.ndarray]], documents: int, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) that hold the ``k`` highest sums of the lists and all ties of the last, each sum complete.

    Each list has documents and impacts, falling. All are read in step, so the
    impact read last bounds what a list can still give. A document's sum lies
    between what was read for it (lower) and that plus the bounds of the lists
    where it was not met (upper). Reading ends when no document whose upper
    bound reaches the k-th lower bound, or ``least``, has an open interval.
    """
    lower, met = np.zeros(documents), np.zeros((documents, len(lists)), bool)
    at, depth = 0, FIRST_READ
    while True:
        bound = np.zeros(len(lists))
        for j, (who, impact) in enumerate(lists):
            lower[who[at:depth]] += impact[at:depth]
            met[who[at:depth], j] = True
            if depth < len(who):
                bound[j] = impact[depth - 1]
        floor = max(least, 1)
        if documents > k:
            floor = max(floor, np.partition(lower, documents - k)[documents - k])
        open_to = bound.sum()
        if open_to < floor or not open_to:
            near = np.nonzero(lower + open_to >= floor)[0]
            missing = (~met[near]) @ bound
            reach = lower[near] + missing >= floor
            if not missing[reach].any():
                near = near[reach]
                return near, lower[near].astype(np.int64)
        at, depth = depth, 2 * depth


class Shard:
    """Impact-sorted lists of a bounded number of documents."""

    def __init__(self, n: np.ndarray, term: np.ndarray, tf: np.ndarray, owner: np.ndarray, w: np.ndarray, documents: int, terms: int):
        m = 50 + 50 * n * documents // max(terms, 1)
        impact = w[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[owner]))
        order = np.lexsort((owner, -impact, term))
        self.owner, self.impact = owner[order], impact[order].astype(float)
        self.start = np.searchsorted(term[order], np.arange(len(w) + 1))

    def list_of(self, term: int):
        a, b = self.start[term], self.start[term + 1]
        return self.owner[a:b], self.impact[a:b]


def _search_shards(items: list[tuple[int, list[int]]], w: np.ndarray, documents: int, terms: int, k: int, postings: int, number: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tops: dict[int, list[tuple]] = {}  # (-score, id is null, id) of this task's best

        def place(doc_id):
            return (doc_id is None, int(doc_id or 0) if number else doc_id or "")

        def search(parts: list[pd.DataFrame]) -> None:
            b = pd.concat(parts, ignore_index=True)
            places = [place(x) for x in b["doc_id"]]
            order = sorted(range(len(b)), key=places.__getitem__)  # documents are numbered by id
            b = b.iloc[order]
            owner = np.repeat(np.arange(len(b)), b["term"].map(len))
            shard = Shard(b["n"].to_numpy(), np.concatenate(b["term"].tolist()).astype(np.int64), np.concatenate(b["tf"].tolist()).astype(np.int64), owner, w, documents, terms)
            for item, wanted in items:
                lists = [x for x in map(shard.list_of, wanted) if len(x[0])]
                if lists:
                    held = tops.get(item, [])
                    near, scores = best(lists, len(b), k, -held[-1][0] if len(held) == k else 0)
                    first = np.lexsort((near, -scores))[:k]
                    tops[item] = sorted(held + [(-int(scores[x]), *places[order[near[x]]]) for x in first if scores[x] > 0])[:k]

        parts, size, rows = [], 0, 0
        for b in batches:
            for a in range(0, len(b), 5_000):
                part = b.iloc[a:a + 5_000]
                parts.append(part)
                size, rows = size + int(part["term"].map(len).sum()), rows + len(part)
                if size >= postings or rows >= SHARD_DOCUMENTS:
                    search(parts)
                    parts, size, rows = [], 0, 0
        if rows:
            search(parts)
        for item, held in tops.items():
            yield pd.DataFrame({"item": item, "doc_id": [None if none else str(x) for _, none, x in held], "score": [-s for s, *_ in held]})
    return run


def search(docs: DataFrame, queries: DataFrame, *, k: int = TOP, block_chars: int = BLOCK_CHARS, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item, scores above 0, equal scores by doc_id (integer or string), null ids last.

    docs: doc_id, text; queries: item_id, text. Rows of one item_id (null is
    one) are one item with all their terms; a null or termless text has none,
    and an item without a hit has no row. Every document row is ranked for
    itself, repeated rows and ids too. Items are looked up in blocks of
    bounded text, each with a pass over the documents. Documents stay where
    they are read: each task sorts lists for as many as a shard holds, finds
    the best of them by NRA, and only these meet in the last ranking.
    """
    spark = docs.sparkSession
    total = queries.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    part = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    kind, found = docs.schema["doc_id"].dataType, None
    for block in range(blocks):
        mine: dict = {}
        for q in queries.where(part == block).select("item_id", "text").toLocalIterator():
            mine.setdefault(q.item_id, set()).update(terms_of(q.text))
        vocabulary = {w: i for i, w in enumerate(sorted(set().union(*mine.values())))}
        numbers = list(mine)
        items = [(i, sorted(vocabulary[w] for w in mine[item])) for i, item in enumerate(numbers)]
        rows = stage(counted(docs.select("doc_id", "text"), vocabulary))
        documents, terms = rows.agg(F.count(F.lit(1)), F.sum("n")).first()
        df = rows.select(F.explode("term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        w = np.zeros(len(vocabulary) + 1, np.int64)
        for r in df.select("term", weight(F.col("df"), F.lit(documents)).alias("w")).collect():  # a number per term of the block
            w[r.term] = r.w
        run = _search_shards(items, w, documents, terms or 0, k, shard_postings, isinstance(kind, T.IntegralType))
        hits = rows.where("size(term) > 0").withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(run, "item int, doc_id string, score long")
        names = spark.createDataFrame([(i, item) for i, item in enumerate(numbers)], f"item int, item_id {queries.schema['item_id'].dataType.simpleString()}")
        hits = hits.withColumn("doc_id", F.col("doc_id").cast(kind)).join(names, "item").select("item_id", "doc_id", "score")
        found = hits if found is None else found.unionByName(hits)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    # first the best of each part of an item's hits, then of those
    salted = stage(found).withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    few = salted.withColumn("_r", F.row_number().over(Window.partitionBy("item_id", "_part").orderBy(*order))).where(F.col("_r") <= k)
    ranks = F.row_number().over(Window.partitionBy("item_id").orderBy(*order))
    return few.withColumn("rank", ranks).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op13_nra_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op13_nra_search": op13_nra_search}

_SQL_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""
ORACLES = {"op13_nra_search": f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {_SQL_TERMS} AS w FROM documents),
size AS (SELECT count(*) AS n_all, sum(len(w)) AS l_all FROM d WHERE len(w) > 0),
q AS MATERIALIZED (SELECT DISTINCT item_id, unnest({_SQL_TERMS}) AS term FROM benchmark),
tf AS MATERIALIZED (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY rid, term),
wt AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n_all) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS wt FROM tf, size GROUP BY term),
imp AS (SELECT rid, doc_id, term, wt * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * CAST(len(w) AS BIGINT) * n_all) // CAST(l_all AS BIGINT)))) AS s FROM tf JOIN wt USING (term) JOIN d USING (rid), size),
sc AS (SELECT item_id, rid, doc_id, CAST(sum(s) AS BIGINT) AS score FROM imp JOIN q USING (term) GROUP BY item_id, rid, doc_id HAVING sum(s) > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM sc) WHERE rank <= 50"""}

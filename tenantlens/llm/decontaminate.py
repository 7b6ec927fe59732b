"""Benchmark passages in documents, by a prefix-filtered join of word windows. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tenantlens.llm.common import stage, table, text_key

WINDOW = 13
BLOCK_BYTES = 16 << 20  # of window texts broadcast at a time
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words after A-Z are lower-cased: runs of letters, digits and non-ASCII characters."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _GAP), "")


def item_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, win): every ``size`` consecutive words of an item; a shorter item is one window."""
    w = benchmark.select("item_id", words_of(F.col("text")).alias("w")).where("size(w) > 0")
    start = w.select("item_id", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))).alias("at"))
    return start.select("item_id", F.slice("w", F.col("at"), F.lit(size)).alias("win")).distinct()


def prefixes(windows: DataFrame, docs: DataFrame) -> DataFrame:
    """(word, at, win, len): each window with its rarest word, the one token of its prefix.

    Containment asks for all words, so the prefix that two sets must share has
    one token: the window's first in the order of rising document frequency
    over all of ``docs``.
    """
    # staged, so that Spark joins it by its real size: in the map tasks where it is small
    vocabulary = stage(windows.select(F.explode("win").alias("word")).distinct())
    volume = vocabulary.agg(F.sum(F.octet_length("word") + 16)).first()[0] or 0
    each, count = docs.select(F.explode(F.array_distinct("w")).alias("word")), F.count(F.lit(1)).alias("df")
    if volume <= BLOCK_BYTES:
        counts = stage(each.join(F.broadcast(vocabulary), "word").groupBy("word").agg(count))
    else:  # summed before they are exchanged
        counts = stage(each.groupBy("word").agg(count).join(vocabulary, "word"))
    spread = windows.select("win", F.posexplode("win").alias("at", "word"))
    rarest = spread.join(counts, "word").groupBy("win").agg(F.min(F.struct("df", "word", "at")).alias("r"), F.count(F.lit(1)).alias("met"))
    # a word that no document has rules its window out
    return rarest.where(F.col("met") == F.size("win")).select(F.col("r.word").alias("word"), F.col("r.at").alias("at"), "win")


def hits(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(key, items, n_hit) of every text in which a benchmark window occurs.

    ``docs`` has key and w, the words. The windows are joined in blocks of at
    most about BLOCK_BYTES, whatever the size of the benchmark.
    """
    owned = stage(item_windows(benchmark, size))
    tokens = stage(prefixes(owned.select("win").distinct(), docs))
    volume = tokens.agg(F.sum(F.length(F.array_join("win", " ")) + 64)).first()[0] or 0
    blocks = -(-volume // BLOCK_BYTES)
    at = docs.select("key", "w", F.posexplode("w").alias("pos", "word"))
    found = None
    for b in range(blocks):
        block = tokens.where(F.pmod(F.xxhash64("win"), F.lit(blocks)) == b)
        start, length = F.col("pos") - F.col("at"), F.size("win")
        near = (at.join(F.broadcast(block), "word")
                .where((start >= 0) & (start + length <= F.size("w")))  # positional and length bound
                .where(F.slice("w", F.greatest(start, F.lit(0)) + 1, length) == F.col("win")))
        part = near.select("key", start.alias("start"), "win").distinct()
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "key binary, start int, win array<string>")
    found = stage(found)
    spans = F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.size("win")).alias("stop"))))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("reach"))
    covered = F.aggregate(spans, zero, lambda a, x: F.struct(
        (a.n + F.greatest(F.lit(0), x.stop - F.greatest(x.start, a.reach))).alias("n"), F.greatest(a.reach, x.stop).alias("reach")))
    n_hit = found.groupBy("key").agg(covered["n"].alias("n_hit"))
    items = (found.select("key", "win").distinct().join(owned, "win").select("key", F.col("item_id").cast("string").alias("item_id")).distinct()
             .groupBy("key").agg(F.sort_array(F.collect_list("item_id")).alias("items")))
    return n_hit.join(items, "key")


def scan(docs: DataFrame, benchmark: DataFrame, *, size: int = WINDOW) -> DataFrame:
    """Every row of ``docs`` with key, n_words, n_hit, items and contaminated added under those names.

    n_hit words of n_words lie in an occurrence of a window of some item;
    contaminated if that is a twentieth of the text or more. A null or
    wordless text has none; items without words have no window; a null
    item_id counts as no item; equal texts share their result; an empty
    benchmark contaminates nothing. Columns of docs with these names are
    replaced.
    """
    words = docs.select(text_key(F.col("text")).alias("key"), words_of(F.col("text")).alias("w"))
    found = stage(hits(words, benchmark, size))
    base = docs.drop("key", "n_words", "n_hit", "items", "contaminated").withColumns(
        {"key": text_key(F.col("text")), "n_words": F.size(words_of(F.col("text"))).cast("long")})
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return (base.join(found, "key", "left")
            .withColumns({"n_hit": n_hit, "items": F.coalesce("items", F.array().cast("array<string>")),
                          "contaminated": (n_hit > 0) & (n_hit * 20 >= F.col("n_words"))}))


def op10_prefix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scan(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


QUERIES = {"op10_prefix_decontamination": op10_prefix_decontamination}

_SQL_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
ORACLES = {"op10_prefix_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS win
       FROM b, unnest(range(1, greatest(len(w) - 11, 2))) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(i)),
hit AS (SELECT rid, dw.n, i, item_id FROM dw JOIN bw USING (n, win)),
spot AS (SELECT rid, count(DISTINCT i + k) AS n_hit FROM hit, unnest(range(0, n)) AS t(k) GROUP BY rid),
item AS (SELECT rid, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS ids FROM hit GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN spot USING (rid) LEFT JOIN item USING (rid)"""}

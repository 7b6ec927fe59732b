"""Merkle manifest of a dataset: a 16-ary tree per source, and one over the sources.

A level of a block of 256 consecutive nodes is one string of hex digests. Parents
hash fixed-width substrings of it, the substrings beside a node are its siblings,
and the roots of all blocks are the nodes of the next round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tenantlens.llm.common import stage, table

FANOUT = 16
BLOCK = FANOUT * FANOUT  # two levels
HEX = 64
RUN = FANOUT * HEX  # characters of one run in a level
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
TAMPER_EVERY = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "array<struct<left:string,right:string>>"


def leaf(fields: list[Column]) -> Column:
    """Digest of a row: each field as byte count, colon and value; a null field is a dash."""
    def part(c: Column) -> Column:
        s = c.cast("string")
        return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))
    return F.sha2(F.concat(*map(part, fields)), 256)


def proof_hash(path: Column) -> Column:
    """Digest of all sibling segments of a path, from the leaf upwards."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x.left, x.right)), ""), 256)


def fold(digest: Column, path: Column) -> Column:
    """The root that ``digest`` leads to along ``path``."""
    return F.aggregate(path, digest, lambda a, x: F.sha2(F.concat(x.left, a, x.right), 256))


def ranked(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` with at, the place from 0 in their group ``grp`` by ``order``, and n, the group's size.

    Rows are sorted by ranges of (grp, order), so a group may span many tasks;
    places are counted from the sizes of the ranges before. Equal rows are
    told apart by their place in the input.
    """
    keys = ["grp", *order, "_salt"]
    laid = stage(nodes.withColumn("_salt", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
                 .drop("_salt").withColumn("_row", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_row", 33)))
    runs = laid.groupBy("grp", "_range").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    of_group = Window.partitionBy("grp")
    before = F.coalesce(F.sum("_n").over(of_group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = stage(runs.select("grp", "_range", "_first", before.alias("_before"), F.sum("_n").over(of_group).alias("n")))
    return laid.join(runs, ["grp", "_range"]).withColumn("at", F.col("_row") - F.col("_first") + F.col("_before")).drop("_row", "_range", "_first", "_before")


def _parents(level: Column) -> Column:
    starts = F.sequence(F.lit(0), F.floor((F.octet_length(level) - 1) / RUN).cast("int"))
    return F.array_join(F.transform(starts, lambda i: F.sha2(F.substring(level, i * RUN + 1, F.lit(RUN)), 256)), "")


def _blocks(nodes: DataFrame) -> DataFrame:
    """(grp, block, n, items, l0, l1, top): each block with its levels as strings; at most BLOCK nodes a row."""
    of = nodes.groupBy("grp", "n", F.floor(F.col("at") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list(F.struct("at", "digest", "item"))).alias("x"))
    of = of.select("grp", "n", "block", F.transform("x", lambda x: x["item"]).alias("items"), F.array_join(F.transform("x", lambda x: x["digest"]), "").alias("l0"))
    of = of.withColumn("l1", _parents(F.col("l0")))
    return of.withColumn("top", F.when(F.col("n") == 1, F.col("l0")).when(F.col("n") <= FANOUT, F.col("l1")).otherwise(F.sha2("l1", 256)))


def build(nodes: DataFrame) -> list[DataFrame]:
    """Rounds of blocks, lowest first, over nodes (grp, at, n, digest, item): each has a 256th of the nodes before."""
    rounds = [stage(_blocks(nodes))]
    while (rounds[-1].agg(F.max("n")).first()[0] or 0) > BLOCK:
        more = rounds[-1].where(F.col("n") > BLOCK)
        rounds.append(stage(_blocks(more.select("grp", F.col("block").alias("at"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("top").alias("digest"), F.lit(None).cast("int").alias("item")))))
    return rounds


def tops(rounds: list[DataFrame]) -> DataFrame:
    """(grp, top) of every group."""
    out = None
    for blocks in rounds:
        done = blocks.where(F.col("n") <= BLOCK).select("grp", "top")
        out = done if out is None else out.unionByName(done)
    return out


def _steps() -> Column:
    """Sibling segments of node k inside its block."""
    k = F.col("k") % FANOUT
    up = F.floor(F.col("k") / FANOUT).cast("int")
    low = F.struct(F.substring("l0", up * RUN + 1, k * HEX).alias("left"), F.substring("l0", up * RUN + (k + 1) * HEX + 1, (FANOUT - 1 - k) * HEX).alias("right"))
    high = F.struct(F.substring("l1", F.lit(1), up * HEX).alias("left"), F.substring("l1", (up + 1) * HEX + 1, (FANOUT - 1 - up) * HEX).alias("right"))
    return F.when(F.col("n") == 1, F.array().cast(_PATH)).when(F.col("n") <= FANOUT, F.array(low)).otherwise(F.array(low, high))


def paths(rounds: list[DataFrame], heads: DataFrame | None = None) -> DataFrame:
    """(grp, at, item, tree_top, root, path) of every lowest node, from the last round down.

    ``heads`` (grp, root, above) continues the paths above the top of each
    group; without it the top is the root.
    """
    out = None
    for blocks in reversed(rounds):
        done = blocks.where(F.col("n") <= BLOCK).withColumn("tree_top", F.col("top"))
        done = done.join(heads, "grp") if heads is not None else done.withColumns({"root": F.col("top"), "above": F.array().cast(_PATH)})
        if out is not None:
            under = out.select("grp", F.col("at").alias("block"), "tree_top", "root", F.col("path").alias("above"))
            done = done.unionByName(blocks.where(F.col("n") > BLOCK).join(under, ["grp", "block"]).select(*done.columns))
        each = done.select("grp", "block", "n", "l0", "l1", "tree_top", "root", "above", F.posexplode("items").alias("k", "item"))
        out = each.select("grp", (F.col("block") * BLOCK + F.col("k")).alias("at"), "item", "tree_top", "root", F.concat(_steps(), F.col("above")).alias("path"))
    return out


def manifest(rows: DataFrame, *, source: str = "source", order: str = "doc_id", digest: str = "leaf") -> DataFrame:
    """All columns of ``rows`` in ``row``, with subroot, root and path (array of left and right sibling segments).

    Leaves of one source (null is a source) ascend by ``order``, nulls first,
    then by digest; equal rows are leaves of their own. Sources ascend
    bytewise, null first. A single leaf is its source's subroot, a single
    source's subroot the root. An empty table gives an empty result. No task
    holds more than a block of 256 leaves, whatever a source's size.
    """
    grp = F.when(F.col(source).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(source).cast("string")))
    nodes = rows.select(grp.alias("grp"), F.col(order).alias("order"), F.col(digest).alias("digest"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("item"))
    rounds = build(ranked(nodes, ["order", "digest"]).drop("order"))
    roots = tops(rounds).select(F.lit("").alias("grp"), F.col("grp").alias("item"), F.col("top").alias("digest"))
    over = paths(build(ranked(roots, ["item"])))
    heads = stage(over.select(F.col("item").alias("grp"), "root", F.col("path").alias("above")))
    return paths(rounds, heads).select(F.col("item").alias("row"), F.col("tree_top").alias("subroot"), "root", "path")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    changed = F.translate("text", _UPPER, _LOWER)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER_EVERY == 0
    own, other = leaf([F.col(c) for c in FIELDS]), leaf([changed if c == "text" else F.col(c) for c in FIELDS])
    leaves = stage(docs.select("doc_id", "source", own.alias("leaf"), F.when(hit, other).alias("tampered")))
    out = manifest(leaves).withColumn("folded_root", fold(F.coalesce("row.tampered", "row.leaf"), F.col("path")))
    return out.select("row.doc_id", "row.leaf", "subroot", "root", proof_hash(F.col("path")).alias("proof_sha256"),
                      "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES = {"op11_merkle_manifest": op11_merkle_manifest}


def _sql_leaf(text: str) -> str:
    fields = [f"CASE WHEN {v} IS NULL THEN '-' ELSE strlen(CAST({v} AS VARCHAR)) || ':' || CAST({v} AS VARCHAR) END" for v in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(fields)})"


# crc32 of a short ASCII string, a bit at a time
_BIT = "lambda c, i: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
_SQL_CRC = f"""xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT)),
  lambda a, b: list_reduce(range(8), {_BIT}, xor(a, b)), CAST(4294967295 AS BIGINT)), 4294967295)"""
_SQL_LOW = f"translate(text, '{_UPPER}', '{_LOWER}')"
ORACLES = {"op11_merkle_manifest": f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, source, {_sql_leaf('text')} AS leaf, {_sql_leaf(_SQL_LOW)} AS low, {_SQL_CRC} AS crc FROM documents),
g AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS grp, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM d),
t AS (SELECT 0 AS level, grp, pos, n, leaf AS h FROM g
      UNION ALL SELECT level + 1, grp, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY level, grp, pos // 16, n),
s AS MATERIALIZED (SELECT * FROM t),
u AS (SELECT 0 AS level, grp AS pos, count(*) OVER () AS n, h FROM s WHERE n = 1
      UNION ALL SELECT level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY level, pos // 16, n),
nodes AS MATERIALIZED (SELECT 0 AS tree, grp, level, pos, n, h FROM s UNION ALL SELECT 1, 0, level, pos, n, h FROM u),
sides AS MATERIALIZED (SELECT a.tree, a.grp, a.level, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS lo, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS hi
  FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.grp = b.grp AND a.level = b.level AND a.pos // 16 = b.pos // 16 WHERE a.n > 1 GROUP BY ALL),
steps AS MATERIALIZED (SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY tree, level) AS k, lo, hi FROM g
  JOIN sides ON (tree = 0 AND sides.grp = g.grp AND sides.pos = g.pos // CAST(16 ** level AS BIGINT)) OR (tree = 1 AND sides.pos = g.grp // CAST(16 ** level AS BIGINT))),
f AS (SELECT rid, 0 AS k, CASE WHEN crc % 5 = 0 THEN low ELSE leaf END AS h FROM g
      UNION ALL SELECT f.rid, f.k + 1, sha256(lo || h || hi) FROM f JOIN steps ON steps.rid = f.rid AND steps.k = f.k + 1),
ends AS (SELECT rid, arg_max(h, k) AS folded FROM f GROUP BY rid),
proof AS (SELECT rid, sha256(string_agg(lo || hi, '' ORDER BY k)) AS p FROM steps GROUP BY rid),
top AS (SELECT h AS root FROM nodes WHERE tree = 1 AND n = 1),
sub AS (SELECT grp, h AS subroot FROM nodes WHERE tree = 0 AND n = 1)
SELECT doc_id, leaf, subroot, root, coalesce(p, sha256('')) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM g JOIN ends USING (rid) JOIN sub USING (grp) LEFT JOIN proof USING (rid), top"""}

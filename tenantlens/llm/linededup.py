"""Fuzzy line deduplication: MinHash bands, exact Jaccard, distributed union-find."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tenantlens.llm.common import stage, table, whole_groups
from tenantlens.llm.components import components

SHINGLE = 8  # characters
SIMILARITY = 0.8
BANDS, ROWS = 10, 4  # finds 99.5 % of pairs at 0.8, 99.9 % at 0.85
SHARD = 1024  # lines of a bucket that one task compares
NO_ID = (1 << 63) - 1  # stands for a null doc_id: such a document is the last to own a line
LAST_ID = "\U0010ffff"  # the same among text ids
_SLAB = 100_000
_COLUMNS = 2048
_PAIRED = 1 << 20
_WAITING = 1 << 17


def normalise(line: str) -> str:
    """Lower case, runs of white space as one space, trimmed."""
    return " ".join(line.lower().split())


def shingles(line: str, size: int = SHINGLE) -> set[str]:
    """Character shingles; a shorter line is its own only shingle."""
    return {line[i:i + size] for i in range(max(1, len(line) - size + 1))}


def jaccard_at_least(a: set, b: set, similarity: float) -> bool:
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = len(a & b)
    return both >= similarity * (len(a) + len(b) - both)


def shingle_hashes(lines: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the character shingles of all lines, and where each line's begin."""
    text = "".join(x.ljust(size, "\0") for x in lines)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    h, width, power = code, 1, 0x9E3779B97F4A7C15
    while 2 * width <= size:  # two neighbouring windows make one of twice the width
        h = h[:-width] * np.uint64(power) + h[width:]
        width, power = 2 * width, power * power & 0xFFFFFFFFFFFFFFFF
    for k in range(width, size):
        h = h[:len(code) - k] * np.uint64(0x9E3779B97F4A7C15) + code[k:]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    length = np.array([max(size, len(x)) for x in lines])
    inside = np.ones(len(code), bool)
    inside[(np.cumsum(length)[:, None] - np.arange(1, size)).ravel()] = False
    return h[inside[:len(h)]], np.concatenate(([0], np.cumsum(length - size + 1)[:-1]))


def signatures(lines: list[str], hashes: int, size: int = SHINGLE) -> np.ndarray:
    """MinHash of the character shingles: one row of ``hashes`` 32-bit minima per line."""
    out, a = np.empty((len(lines), hashes), np.uint32), 0
    while a < len(lines):
        b, chars = a, 0
        while b < len(lines) and (b == a or chars + len(lines[b]) <= _SLAB):
            chars += max(size, len(lines[b]))
            b += 1
        h, first = shingle_hashes(lines[a:b], size)
        low, high = h.astype(np.uint32), (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        for i in range(hashes):
            out[a:b, i] = np.minimum.reduceat(low, first)
            low += high
        a = b
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit bucket per band."""
    s = signature.reshape(len(signature), bands, rows).astype(np.uint64)
    h = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.zeros((len(s), 1), np.uint64)
    for r in range(rows):
        h = (h ^ s[:, :, r]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(30)
    return h.view(np.int64)


def _worded(texts: pd.Series) -> Iterator[list[tuple[int, str]]]:
    for t in texts:
        yield [(n, x) for n, x in enumerate(map(normalise, t.split("\n"))) if x] if t else []


def _digest(line: str) -> bytes:
    return hashlib.md5(line.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()


def _handle(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def listed(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, text_id, line_no, key, handle, buckets) of every line with a word; text_id tells rows with one doc_id apart.

    ``key`` is the digest of the normalised line, ``handle`` 64 bits of it. The
    buckets stand where a batch has the line first.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            digests: dict[str, bytes] = {}
            out, new = [], []
            for i, t, row in zip(b["id"], b["text_id"], _worded(b["text"])):
                for n, x in row:
                    key = digests.get(x)
                    if key is None:
                        key = digests[x] = _digest(x)
                        new.append(len(out))
                    out.append((i, t, n, key))
            made = pd.DataFrame(out, columns=["id", "text_id", "line_no", "key"])
            made["handle"] = np.frombuffer(b"".join([key[:8] for *_, key in out]), "<i8") if out else np.empty(0, np.int64)
            buckets = np.empty(len(out), object)
            for at, keys in zip(new, band_keys(signatures(list(digests), bands * rows), bands, rows)):
                buckets[at] = keys
            yield made.assign(buckets=buckets)

    identity = _identity(docs)
    kind = docs.select(identity[0]).schema["id"].dataType.simpleString()
    return docs.select(*identity, "text").mapInPandas(run, f"id {kind}, text_id long, line_no int, key binary, handle long, buckets array<long>")


def _shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(members, handle) of the buckets with two different lines or more; ``members`` is one hash for equal sets of lines.

    Rows come sorted by bucket. The last bucket of a batch may go on in the
    next: its different lines wait.
    """
    parts: list[np.ndarray] = []
    limit = _WAITING
    for b in batches:
        rows = b[["bucket", "handle"]].to_numpy(np.int64)
        if not len(rows):
            continue
        if parts and parts[-1][-1, 0] != rows[0, 0]:
            yield from _members(np.concatenate(parts))
            parts, limit = [], _WAITING
        last = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
        if last:
            yield from _members(np.concatenate([*parts, rows[:last]]))
            parts, limit = [], _WAITING
        parts.append(_different(rows[last:]))
        if sum(map(len, parts)) > limit:
            parts = [_different(np.concatenate(parts))]
            limit = max(limit, 2 * len(parts[0]))
    if parts:
        yield from _members(np.concatenate(parts))


def _different(rows: np.ndarray) -> np.ndarray:
    """Each row once, sorted."""
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    return rows[np.concatenate(([True], (rows[1:] != rows[:-1]).any(axis=1)))]


def _members(rows: np.ndarray) -> Iterator[pd.DataFrame]:
    rows = _different(rows)
    start = np.flatnonzero(np.concatenate(([True], rows[1:, 0] != rows[:-1, 0])))
    count = np.diff(np.append(start, len(rows)))
    mixed = rows[:, 1].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    sign = np.add.reduceat(mixed, start)
    many = np.repeat(count > 1, count)
    if many.any():
        yield pd.DataFrame({"members": np.repeat(sign, count)[many].view(np.int64), "handle": rows[many, 1]})


def _coded(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, size): which line has which shingle of two lines or more, by 64-bit hash and sorted by column; shingles of each line."""
    n, length = len(lines), np.array([len(x) for x in lines])
    h, first = shingle_hashes(lines)
    h[first] ^= np.where(length < SHINGLE, length + 1, 0).astype(np.uint64)  # a short line is no line that goes on with what pads it
    row = np.repeat(np.arange(n), np.diff(np.append(first, len(h))))
    order = np.argsort(h, kind="stable")
    h, row = h[order], row[order]
    new = np.concatenate(([True], h[1:] != h[:-1]))
    fresh = new | np.concatenate(([True], row[1:] != row[:-1]))
    row, column = row[fresh], (np.cumsum(new) - 1)[fresh]
    size, uses = np.bincount(row, minlength=n), np.bincount(column)
    shared = uses[column] > 1
    return row[shared], (np.cumsum(uses > 1) - 1)[column[shared]], size


def _alike(coded: tuple[np.ndarray, np.ndarray, np.ndarray], similarity: float, rows: np.ndarray) -> np.ndarray:
    """Matrix of the pairs with an exact Jaccard of ``similarity`` or more, for some rows.

    Shared shingles are counted as products of 0/1 columns, for a single row
    by its own. Where a line meets itself the entry means nothing.
    """
    row, column, size = coded
    if len(rows) == 1:
        own = np.zeros(int(column[-1]) + 1 if len(column) else 0, bool)
        own[column[row == rows[0]]] = True
        both = np.bincount(row[own[column]], minlength=len(size))[None, :]
    else:
        both = np.zeros((len(rows), len(size)), np.float32)
        for a in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
            lo, hi = np.searchsorted(column, (a, a + _COLUMNS))
            part = np.zeros((len(size), min(_COLUMNS, int(column[-1]) + 1 - a)), np.float32)
            part[row[lo:hi], column[lo:hi] - a] = 1
            both += part[rows] @ part.T
    return both >= similarity * (size[rows, None] + size[None, :] - both.astype(float))


def _links(lines: list[str], one: np.ndarray, two: np.ndarray, similarity: float) -> Iterator[tuple[int, int]]:
    """Pairs that connect what exact Jaccard connects between the places ``one`` and ``two`` (the same, or apart).

    All of ``two`` meet the first of ``one``; then what that leaves apart meets the other side.
    """
    coded, label, first = _coded(lines), np.arange(len(lines)), one[0]
    for j in two[_alike(coded, similarity, one[:1])[0, two]]:
        if j != first:
            label[j] = first
            yield first, j
    for side, other in ((two[label[two] != first], one), (one[1:], two[label[two] == first])):
        if len(side) and len(other) and len(lines) > 2 and (label[other] != label[side[0]]).any():
            alike = _alike(coded, similarity, side)
            for at, i in enumerate(side):
                for j in other[alike[at, other] & (label[other] != label[i])]:
                    if label[i] != label[j]:
                        yield i, j
                        label[label == label[j]] = label[i]
        if one[0] in two:
            return


def _close(x: list[str], y: list[str], similarity: float) -> np.ndarray:
    """Whether line pairs reach ``similarity``: counts by 43-bit hashes of the shingles, sets of strings where these are near the bound."""
    near, a = np.zeros(len(x), bool), 0
    while a < len(x):
        b, chars = a, 0
        while b < len(x) and (b == a or chars + len(x[b]) + len(y[b]) <= _PAIRED):
            chars += len(x[b]) + len(y[b])
            b += 1
        h, first = shingle_hashes([line for pair in zip(x[a:b], y[a:b]) for line in pair])
        owner = np.repeat(np.arange(2 * (b - a), dtype=np.uint64), np.diff(np.append(first, len(h))))
        keys = np.sort(owner >> np.uint64(1) << np.uint64(44) | h >> np.uint64(21) << np.uint64(1) | owner & np.uint64(1))
        keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))]
        sizes = np.bincount((keys >> np.uint64(44)).astype(np.int64), minlength=b - a)
        same = keys[1:][keys[1:] >> np.uint64(1) == keys[:-1] >> np.uint64(1)]
        both = np.bincount((same >> np.uint64(44)).astype(np.int64), minlength=b - a)
        over = both - similarity * (sizes - both)
        near[a:b] = over > 0
        for k in np.flatnonzero(np.abs(over) <= 4):
            near[a + k] = jaccard_at_least(shingles(x[a + k]), shingles(y[a + k]), similarity)
        a = b
    return near


def _verify(similarity: float):
    """Per pair of shards of a bucket: links (a, b) that connect what exact Jaccard connects."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g, starts in whole_groups(batches, ["members", "one", "two"]):
            key, line, found, twos = g["key"].tolist(), g["line"].tolist(), [], []
            one, two, shard = (g[c].to_numpy() for c in ("one", "two", "shard"))
            for a, b in zip(starts, starts[1:]):
                if b - a == 2:  # most buckets
                    if one[a] == two[a] or shard[a] != shard[a + 1]:
                        twos.append(a)
                    continue
                left, right = a + np.flatnonzero(shard[a:b] == one[a]), a + np.flatnonzero(shard[a:b] == two[a])
                if len(left) and len(right):
                    places = _links(line[a:b], left - a, right - a, similarity)
                    found += [(key[a + i], key[a + j]) for i, j in places]
            near = _close([line[a] for a in twos], [line[a + 1] for a in twos], similarity)
            found += [(key[a], key[a + 1]) for a, yes in zip(twos, near) if yes]
            if found:
                yield pd.DataFrame(found, columns=["a", "b"])
    return run


def similar_lines(docs: DataFrame, seen: DataFrame, *, similarity: float = SIMILARITY, shard: int = SHARD) -> DataFrame:
    """(node, root): keys of the lines in ``seen`` (``listed`` of ``docs``) connected by links of at least ``similarity``."""
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = seen.where("buckets is not null").select(F.explode("buckets").alias("bucket"), "handle")
    met = stage(buckets.repartition(width, "bucket").sortWithinPartitions("bucket")
                .mapInPandas(_shared, "members long, handle long").distinct())
    wanted = stage(met.select("handle").distinct())

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text, numbers in zip(b["text"], b["numbers"]):
                row = text.split("\n")
                out += [normalise(row[n]) for n in numbers]
            digests = [_digest(x) for x in out]
            yield pd.DataFrame({"handle": [_handle(d) for d in digests], "key": digests, "line": out})

    first = seen.join(wanted, "handle", "left_semi").groupBy("handle", "key").agg(F.min(F.struct("id", "text_id", "line_no")).alias("at"))
    spots = stage(first.groupBy("at.id", "at.text_id").agg(F.collect_list("at.line_no").alias("numbers")))
    held = stage(docs.select(*_identity(docs), "text").join(spots.hint("shuffle_hash"), ["id", "text_id"]).select("text", "numbers")
                 .mapInPandas(lines, "handle long, key binary, line string").dropDuplicates(["handle", "key"]))
    sizes = stage(met.groupBy("members").agg(F.ceil(F.count(F.lit(1)) / F.lit(shard)).cast("int").alias("shards")))
    cut = (met.join(sizes, "members").withColumn("shard", F.pmod(F.xxhash64("handle"), F.col("shards")).cast("int"))
           .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
           .select("members", F.least("shard", "other").alias("one"), F.greatest("shard", "other").alias("two"), "shard", "handle"))
    by = ["members", "one", "two"]
    pairs = (cut.join(held, "handle").repartition(width, *by).sortWithinPartitions(*by)
             .mapInPandas(_verify(similarity), "a binary, b binary"))
    return components(pairs)


def _identity(docs: DataFrame):
    """Order of documents: by doc_id, a null last."""
    whole = isinstance(docs.schema["doc_id"].dataType, T.IntegralType)
    id = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)) if whole else F.coalesce(F.col("doc_id").cast("string"), F.lit(LAST_ID))
    return id.alias("id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_id")


def judged_lines(docs: DataFrame, *, bands: int = BANDS, rows: int = ROWS, **options) -> DataFrame:
    """(id, text_id, line_no, kept): of each component of similar lines the first by (doc_id, line_no) is kept.

    Lines are compared normalised, so lines equal in that form are one node.
    Lines without a word belong to no component and are not listed; null and
    empty texts have none. Rows equal in doc_id and text are judged alike;
    lines of documents without an id come last.
    """
    seen = stage(listed(docs, bands, rows))
    roots = stage(similar_lines(docs, seen, **options))
    seen = seen.join(roots, F.col("key") == F.col("node"), "left")
    seen = stage(seen.select("id", "text_id", "line_no", F.coalesce("root", "key").alias("root")))
    spot = F.struct("id", "line_no", "text_id")
    owner = stage(seen.groupBy("root").agg(F.min(spot).alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1").select("root", "owner"))
    return (seen.join(owner, "root", "left")
            .select("id", "text_id", "line_no", (F.col("owner").isNull() | (F.col("owner") == spot)).alias("kept")))


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the repeated lines of text taken out; a document that loses every worded line goes.

    Lines without a word stay where they are. Columns are those of ``docs``;
    a null text stays null; n_chars, where present, follows the text.
    """
    @F.pandas_udf("string")
    def without(texts: pd.Series, lost: pd.Series) -> pd.Series:
        out = []
        for t, gone in zip(texts, lost):
            if t is not None:
                gone = set(gone)
                t = "\n".join([x for n, x in enumerate(t.split("\n")) if n not in gone])
            out.append(t)
        return pd.Series(out, dtype=object)

    lost = (judged_lines(docs, **options).groupBy("id", "text_id")
            .agg(F.collect_list(F.when(~F.col("kept"), F.col("line_no"))).alias("_lost"), F.count_if("kept").alias("_left"))
            .where("size(_lost) > 0"))
    rows = docs.select(*_identity(docs), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).join(stage(lost), ["id", "text_id"], "left")
    rows = rows.where("_left is null or _left > 0")
    whole = F.col("_lost").isNull()
    rows = rows.withColumn("_new", without(F.when(~whole, F.col("row.text")), "_lost"))
    new = {"text": F.when(whole, F.col("row.text")).otherwise(F.col("_new"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(whole, F.col("row.n_chars")).otherwise(F.length("_new")).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op8_fuzzy_line_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, worded lines, lines removed, numbers of the lines kept (from 0)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = judged_lines(docs).groupBy("id", "text_id").agg(
        F.sort_array(F.collect_set(F.when(F.col("kept"), F.col("line_no")))).alias("kept_lines"),
        F.count_distinct("line_no").alias("n_lines"))
    found = stage(found)
    rows = docs.select("doc_id", *_identity(docs))
    return rows.join(found, ["id", "text_id"], "left").select(
        "doc_id", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), (F.coalesce("n_lines", F.lit(0)) - F.coalesce(F.size("kept_lines"), F.lit(0))).cast("long").alias("n_removed"),
        F.coalesce("kept_lines", F.array().cast("array<int>")).alias("kept_lines"))


QUERIES = {"op8_fuzzy_line_minhash": op8_fuzzy_line_minhash}

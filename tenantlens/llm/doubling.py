"""Repeated word windows found by level-wise doubling."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from tenantlens.llm.common import stage, table
from tenantlens.llm.contexts import Hashes
from tenantlens.llm.repeats import covered, places_to_cut, read_contexts, rewrite, survey

WINDOW = 35
_CACHE = 500_000


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASH = _WordHash()


def words(text: str | None) -> list[bytes]:
    """Runs without ASCII white space, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def units(text: str | None) -> np.ndarray:
    w = words(text)
    return np.fromiter(map(_HASH.__getitem__, w), np.uint64, len(w))


def levels(size: int) -> list[int]:
    """Window lengths from about a quarter of ``size``, each twice the one before, the last cut to ``size``."""
    first = -(-size // 4)
    out = [first]
    while out[-1] < size:
        out.append(min(size, 2 * out[-1]))
    return out


def _describe(size: int, steps: list[int]):
    """Per level between the first and the last: the hash of that length to the right and to the left of the anchor.

    A window with its anchor at offset d holds the run of ``length`` that begins
    at the anchor if d <= size - length, else the one that ends with the anchor.
    """
    def describe(text: str, h: Hashes, start: int, windows: int):
        common = np.arange(start + windows - 1, start + size - steps[0] + 1)  # where all its windows may have their anchor
        anchor = int(common[np.argmin(h.runs(common, steps[0]))])
        near, far = anchor - (start + windows - 1), anchor - start  # smallest and largest anchor offset of its windows
        sides = []
        for length in steps[1:-1]:
            right = h.runs(np.array([anchor]), length).view(np.int64)[0] if near <= size - length else None
            left = h.runs(np.array([anchor + steps[0] - length]), length).view(np.int64)[0] if far > size - length else None
            sides.append((right, left))
        whole = h.runs(np.arange(start, start + windows), size).view(np.int64)
        return far, [None if r is None else int(r) for r, _ in sides], [None if x is None else int(x) for _, x in sides], whole.tolist()
    return describe


def repeated_offsets(contexts: DataFrame, size: int, steps: list[int]) -> DataFrame:
    """(anchor, content, offsets): windows of mixed contexts that occur again, by lengths that double.

    Each level keeps the windows whose run of that length stands at two places;
    those alone are looked at with twice the length.
    """
    each = contexts.select("anchor", "content", "n", "rights", "lefts", F.posexplode("whole").alias("offset", "whole"), "far")
    left_over = each.withColumn("d", F.col("far") - F.col("offset"))
    for k, length in enumerate(steps[1:-1]):
        on_right = F.col("d") <= size - length
        left_over = left_over.withColumns({"right_side": on_right, "run": F.when(on_right, F.get("rights", F.lit(k))).otherwise(F.get("lefts", F.lit(k)))})
        runs = left_over.select("anchor", "right_side", "run", "content", "n").distinct()
        again = stage(runs.groupBy("anchor", "right_side", "run").agg(F.sum("n").alias("m")).where("m > 1").select("anchor", "right_side", "run"))
        left_over = left_over.join(again, ["anchor", "right_side", "run"], "left_semi")
    left_over = stage(left_over.select("anchor", "content", "n", "offset", "whole"))
    again = stage(left_over.groupBy("anchor", "whole").agg(F.sum("n").alias("m")).where("m > 1").select("anchor", "whole"))
    return left_over.join(again, ["anchor", "whole"], "left_semi").groupBy("anchor", "content").agg(F.collect_list("offset").alias("offsets"))


def remove_repeats(docs: DataFrame, *, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and the kept text of every row of ``docs`` (doc_id, text).

    A word goes if a window of ``size`` words that covers it starts anywhere
    else too, in the same document or another; rows with equal texts are
    different places. Windows are judged on the input. Null, empty and shorter
    texts lose nothing; the kept words are joined by one space.
    """
    steps = levels(size)
    places, contents, mixed = survey(docs, units, size, steps[0])
    read = read_contexts(docs, mixed, units, size, _describe(size, steps), "far int, rights array<long>, lefts array<long>, whole array<long>")
    spots = places_to_cut(places, contents, repeated_offsets(read, size, steps))

    def keep(text, at):
        w = words(text)
        if at is None:
            return len(w), 0, b" ".join(w).decode("utf-8", "surrogatepass")
        gone = covered(Hashes(units(text)), at, size)
        return len(w), int(gone.sum()), b" ".join([x for x, g in zip(w, gone.tolist()) if not g]).decode("utf-8", "surrogatepass")

    return rewrite(docs, spots, keep, "n_words long, n_removed long, kept string")


def op4_doubling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op4_doubling_windows": op4_doubling_windows}

ORACLES = {"op4_doubling_windows": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT rid, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM d, unnest(range(1, len(w) - 33)) AS t(i)),
rep AS (SELECT rid, i FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT DISTINCT rid, i + k AS i FROM rep, unnest(range(0, 35)) AS t(k)),
word AS (SELECT rid, i, w[i] AS x FROM d, unnest(range(1, len(w) + 1)) AS t(i)),
kept AS (SELECT rid, string_agg(x, ' ' ORDER BY i) AS kept FROM word ANTI JOIN gone USING (rid, i) GROUP BY rid),
lost AS (SELECT rid, count(*) AS n FROM gone GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN lost USING (rid) LEFT JOIN kept USING (rid)"""}

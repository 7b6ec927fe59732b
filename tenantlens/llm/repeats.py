"""Find windows that start at two places or more, over contexts (see contexts.py).

Both substring operators use these steps and differ in how they resolve the
contexts that share an anchor but not all units.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tenantlens.llm.common import stage
from tenantlens.llm.contexts import Hashes, contexts


SLAB = 300_000


def text_hash():
    """64-bit name of a text. Two texts with one name are told apart by the content hashes of their contexts."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def _slabs(texts: pd.Series, units: Callable, size: int, gram: int):
    """(place of the first text, contexts) of runs of texts with about SLAB units together."""
    held, total, first = [], 0, 0
    for k, t in enumerate(texts):
        u = units(t)
        held.append(u)
        total += len(u)
        if total >= SLAB or k == len(texts) - 1:
            yield first, contexts(Hashes(np.concatenate(held)), size, gram, np.concatenate(([0], np.cumsum([len(x) for x in held]))))
            held, total, first = [], 0, k + 1


def survey(docs: DataFrame, units: Callable, size: int, gram: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(places, contents, mixed) of the contexts whose anchor occurs twice or more.

    places: anchor, content, name, start, windows, one row per context and row of
    docs. contents: anchor, content, n (places that have it) and one of them.
    mixed: the contents whose anchor has other contents too; all other contents
    stand at two places with all their windows.
    """
    def anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, (_, anchor, *_) in _slabs(b["text"], units, size, gram):
                value, n = np.unique(anchor, return_counts=True)
                yield pd.DataFrame({"anchor": _signed(value), "n": n})

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            name = b["name"].to_numpy()
            for first, (which, anchor, content, start, windows) in _slabs(b["text"], units, size, gram):
                yield pd.DataFrame({"anchor": _signed(anchor), "content": _signed(content), "name": name[first + which], "start": start, "windows": windows})

    texts = docs.where(F.col("text").isNotNull()).select("text", text_hash().alias("name"))
    twice = stage(texts.select("text").mapInPandas(anchors, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor"))
    places = stage(texts.mapInPandas(cut, "anchor long, content long, name long, start int, windows int").join(twice, "anchor", "left_semi"))
    contents = stage(places.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("name", "start", "windows")).alias("at"))
                     .select("anchor", "content", "n", "at.*"))
    several = stage(contents.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("anchor"))
    return places, contents, contents.join(several, "anchor", "left_semi")


def read_contexts(docs: DataFrame, mixed: DataFrame, units: Callable, size: int, describe: Callable, schema: str) -> DataFrame:
    """One row per mixed content: anchor, content, n, windows and what ``describe(text, hashes, start, windows)`` returns (``schema``)."""
    wanted = stage(mixed.groupBy("name").agg(F.collect_list(F.struct("anchor", "content", "n", "start", "windows")).alias("_at")))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text, at in zip(b["text"], b["_at"]):
                h = Hashes(units(text))
                for c in at:
                    start, windows = int(c["start"]), int(c["windows"])
                    if start + windows + size - 1 < len(h.sums) and _signed(h.runs(np.array([start]), windows + size - 1))[0] == c["content"]:
                        rows.append((c["anchor"], c["content"], c["n"], windows, *describe(text, h, start, windows)))
            yield pd.DataFrame(rows, columns=["anchor", "content", "n", "windows", *names])

    texts = docs.where(F.col("text").isNotNull()).select("text", text_hash().alias("name"))
    found = texts.join(wanted, "name").select("text", "_at").mapInPandas(run, f"anchor long, content long, n long, windows int, {schema}")
    return stage(found.dropDuplicates(["anchor", "content"]))  # equal texts give equal rows


def places_to_cut(places: DataFrame, contents: DataFrame, offsets: DataFrame) -> DataFrame:
    """(name, spots): the contexts of each text with repeated windows.

    ``offsets`` (anchor, content, offsets) lists the repeated windows of mixed
    contents; a content at several places has all windows repeated.
    """
    whole = contents.where("n > 1").select("anchor", "content", F.lit(None).cast("array<int>").alias("offsets"))
    part = offsets.join(contents.where("n = 1").select("anchor", "content"), ["anchor", "content"], "left_semi")
    verdict = stage(whole.unionByName(part.select("anchor", "content", F.col("offsets").cast("array<int>").alias("offsets"))))
    hit = places.join(verdict, ["anchor", "content"]).select("name", F.struct("start", "windows", "content", "offsets").alias("spot"))
    return stage(hit.groupBy("name").agg(F.collect_set("spot").alias("spots")).select("name", "spots.start", "spots.windows", "spots.content", "spots.offsets"))


def covered(h: Hashes, spots: tuple, size: int) -> np.ndarray:
    """Which units of a sequence lie in a repeated window; ``spots`` are a row's starts, windows, contents and offsets."""
    n = len(h.sums) - 1
    start, windows, content = (np.asarray(x, np.int64) for x in spots[:3])
    own = start + windows + size - 1 <= n
    own[own] = _signed(h.runs(start[own], windows[own] + size - 1)) == content[own]  # else of another text with this name
    change = np.zeros(n + 1, np.int64)
    whole = own & np.array([o is None for o in spots[3]])
    np.add.at(change, start[whole], 1)
    np.add.at(change, (start + windows + size - 1)[whole], -1)
    for k in np.flatnonzero(own & ~whole):
        first = start[k] + np.asarray(spots[3][k], np.int64)
        np.add.at(change, first, 1)
        np.add.at(change, first + size, -1)
    return np.cumsum(change[:-1]) > 0


def rewrite(docs: DataFrame, spots: DataFrame, keep: Callable, schema: str) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) as doc_id and what ``keep(text, spots)`` returns (``schema``)."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = [None if s[0] is None else s for s in zip(b["start"], b["windows"], b["content"], b["offsets"])]
            rows = [(i, *keep(t, s)) for i, t, s in zip(b["doc_id"], b["text"], at)]
            yield pd.DataFrame(rows, columns=["doc_id", *names])

    kind = docs.schema["doc_id"].dataType
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", text_hash().alias("name")).join(spots, "name", "left")
    return rows.drop("name").mapInPandas(run, f"doc_id string, {schema}").withColumn("doc_id", F.col("doc_id").cast(kind))

"""Repeated byte strings found in suffix-sorted shards."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tenantlens.llm.common import partitions_for, table
from tenantlens.llm.contexts import Hashes
from tenantlens.llm.induced import BASE_ITEMS, MEMORY_ITEMS, repeated_starts
from tenantlens.llm.repeats import covered, places_to_cut, read_contexts, rewrite, survey

WINDOW = 200
GRAM = 64
SHARD_BYTES = 1 << 20
_END, _GAP, _FIRST = 0, 1, 2  # symbols: end of the shard, end of a context, byte 0

_UNIT = np.random.default_rng(200).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def as_bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def units(text: str | None) -> np.ndarray:
    return _UNIT[np.frombuffer(as_bytes(text), np.uint8)]


class _Shard:
    """Contexts of one shard, appended to a scratch file and sorted as one text."""

    def __init__(self):
        self.file, self.rows, self.length = tempfile.TemporaryFile(), [], 0

    def add(self, anchor: int, content: int, windows: int, part: bytes) -> None:
        self.rows.append((anchor, content, windows, self.length))
        symbols = np.frombuffer(part, np.uint8).astype("<u2") + np.uint16(_FIRST)
        self.file.write(symbols.tobytes() + np.array([_GAP], "<u2").tobytes())
        self.length += len(part) + 1

    def resolve(self, size: int, memory_items: int, base_items: int) -> pd.DataFrame:
        self.file.write(np.array([_END], "<u2").tobytes())
        self.file.flush()
        if self.length > memory_items:
            text = np.memmap(self.file, "<u2", "r", shape=(self.length + 1,))
        else:
            self.file.seek(0)
            text = np.frombuffer(self.file.read(), "<u2")
        again = repeated_starts(text, size, memory_items=memory_items, base_items=base_items)
        rows = [(a, c, np.flatnonzero(again[at:at + w]).astype(np.int32)) for a, c, w, at in self.rows]
        self.file.close()
        return pd.DataFrame([r for r in rows if len(r[2])], columns=["anchor", "content", "offsets"])


def _sort_shards(size: int, memory_items: int, base_items: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, number = None, None
        for b in batches:
            for n, *row in zip(b["shard"], b["anchor"], b["content"], b["windows"], b["part"]):
                if n != number:
                    if shard:
                        yield shard.resolve(size, memory_items, base_items)
                    shard, number = _Shard(), n
                shard.add(*row)
        if shard:
            yield shard.resolve(size, memory_items, base_items)
    return run


def repeated_offsets(contexts: DataFrame, size: int, *, shard_bytes: int = SHARD_BYTES, memory_items: int = MEMORY_ITEMS, base_items: int = BASE_ITEMS) -> DataFrame:
    """(anchor, content, offsets): windows of mixed contexts that occur again, from suffix-sorted shards.

    A shard holds whole anchors; one with very many contexts makes a large
    shard, which is sorted in files.
    """
    volume = contexts.agg(F.sum(F.octet_length("part") + 1)).first()[0] or 0
    shards = partitions_for(volume, shard_bytes)
    dealt = contexts.select("anchor", "content", "windows", "part").withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    return (dealt.repartition(shards, "shard").sortWithinPartitions("shard", "anchor", "content")
            .mapInPandas(_sort_shards(size, memory_items, base_items), "anchor long, content long, offsets array<int>"))


def remove_repeats(docs: DataFrame, *, size: int = WINDOW, gram: int = GRAM, **limits) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the kept bytes of every row of ``docs`` (doc_id, text).

    A byte of the UTF-8 text goes if a string of ``size`` bytes that covers it
    starts anywhere else too, in the same document or another; rows with equal
    texts are different places. Strings are judged on the input. Null, empty
    and shorter texts lose nothing.
    """
    places, contents, mixed = survey(docs, units, size, gram)

    def describe(text, h, start, windows):
        return (as_bytes(text)[start:start + windows + size - 1],)

    read = read_contexts(docs, mixed, units, size, describe, "part binary")
    spots = places_to_cut(places, contents, repeated_offsets(read, size, **limits))

    def keep(text, at):
        data = as_bytes(text)
        if at is None:
            return len(data), 0, 0, data
        gone = covered(Hashes(units(text)), at, size)
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
        return len(data), int(gone.sum()), spans, np.frombuffer(data, np.uint8)[~gone].tobytes()

    return rewrite(docs, spots, keep, "n_bytes long, n_removed long, n_spans long, kept binary")


def op5_suffix_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op5_suffix_induction": op5_suffix_induction}

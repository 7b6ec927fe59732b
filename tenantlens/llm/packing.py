"""Tokenise documents and pack them into fixed-length sequences by sum of squares."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tenantlens.llm.common import groups, partitions_for, stage, table

CAPACITY = 4096
END_ID = 1
GROUP_TOKENS = 2048 * CAPACITY  # packed by one task
GROUP_PIECES = 200_000
REOPEN = 256  # a sequence with more free tokens is packed again in the next round
CACHE_WORDS = 500_000

_SPLITS_MORE = re.compile("[\x1c-\x1f]")  # white space for str.split, not for Unicode
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@[-`{-~]*)")  # letters that have one lower-case form, and symbols behind them
_TO_SYMBOLS = {b: 256 + n for n, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}  # how byte-level models write bytes
_ENCODERS: dict = {}


class Encoder(dict):
    """Little-endian ids of a text; caches the ids of each white-space word.

    Holds for tokenizers that drop white space and never join words over it,
    as word_bpe_49k does. The cache is emptied at CACHE_WORDS words.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.cores, self.tails = {}, {"": b""}

    def _core(self, core: str) -> bytes:
        """Ids of a lower-case word of plain letters: the model alone, without normaliser and splitter."""
        letters = core if core.isascii() else core.encode().decode("latin-1").translate(_TO_SYMBOLS)
        ids = self.cores[core] = array("I", [t.id for t in self.tokenizer.model.tokenize(letters)]).tobytes()
        return ids

    def _whole(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        plain = _PLAIN.fullmatch(word)
        if plain:
            core, tail = plain.groups()
            core = core.lower()
            ids = self.cores.get(core) or self._core(core)
            if tail:  # a run of symbols is a word of its own
                if tail not in self.tails:
                    self.tails[tail] = self._whole(tail)
                ids += self.tails[tail]
        else:
            ids = self._whole(word)
        if len(self) >= CACHE_WORDS:
            for cache in (self, self.cores, self.tails):
                cache.clear()
            self.tails[""] = b""
        self[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        words = [w for w in _SPACE.split(text) if w] if _SPLITS_MORE.search(text) else text.split()
        return b"".join(map(self.__getitem__, words))


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32[, ids].

    A document is its ids and ``end_id``; a null or empty text is ``end_id``
    alone. Only longer documents are cut. ``ids`` (little-endian unsigned
    32-bit) is added on demand.
    """
    end, width = np.array([end_id], "<u4").tobytes(), 4 * capacity

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer)
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"], b["text"]):
                ids = enc.encode(text) + end
                for k, a in enumerate(range(0, len(ids), width)):
                    part = ids[a:a + width]
                    rows.append((doc_id, k, a // 4, len(part) // 4, zlib.crc32(part), *([part] if with_ids else [])))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])

    kind = docs.schema["doc_id"].dataType
    schema = "doc_id string, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    made = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, schema)
    return made.withColumn("doc_id", F.col("doc_id").cast(kind))


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum-of-squares packing, longest first: bin and offset per item, free room per bin.

    With N(g) open bins of gap g, an item goes where the sum of N(g) squared
    becomes smallest: into a gap g (change 2 (N(g - s) - N(g)) + 2), an exact
    gap (1 - 2 N(s)), or a new bin (2 N(capacity - s) + 1). Ties take the
    smallest gap.
    """
    n = np.zeros(capacity + 1, np.int64)  # n[0]: full bins, not counted
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    free: list[int] = []
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    never = np.iinfo(np.int64).max
    for i in np.argsort(-lengths, kind="stable").tolist():
        s = int(lengths[i])
        have = n[s:]
        change = np.where(have > 0, 2 * (n[:capacity + 1 - s] - have) + 2, never)
        if have[0]:
            change[0] = 1 - 2 * have[0]
        g = int(change.argmin())
        fresh = 2 * int(n[capacity - s]) + 1 if s < capacity else 0
        if change[g] <= fresh:
            g += s
            b = open_bins[g].pop()
            n[g] -= 1
        else:
            b, g = len(free), capacity
            free.append(capacity)
        bins[i], offsets[i] = b, capacity - g
        free[b] = g - s
        if g > s:
            n[g - s] += 1
            open_bins[g - s].append(b)
    return bins, offsets, np.array(free, np.int64)


def _pack_groups(capacity: int, turn: int, last: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in groups(batches, ["_group"]):
            bins, offsets, free = place(g["length"].to_numpy(), capacity)
            ident = (turn << 56) + (int(g["_group"].iloc[0]) << 24)
            yield g.drop(columns="_group").assign(sequence_id=ident + bins, offset=offsets, _again=(free[bins] > REOPEN) & (not last))
    return run


def pack(items: DataFrame, *, capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Place every row of ``items`` (column length, 1 to capacity) in a sequence: adds sequence_id and offset.

    Rows are dealt to groups of a bounded number of tokens and rows, each
    packed by one task. Sequences that a group leaves with much room are taken
    apart, and their rows go to the next round. The last round, which keeps all
    its sequences, is the one with one group or with more than half the tokens
    of the round before: what comes back then are pieces that fill no sequence.
    So all rounds together write at most twice the first. Equal rows are
    separate items; an empty table gives an empty result.
    """
    width = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = ", ".join(f"`{n}` {t}" for n, t in items.dtypes) + ", sequence_id long, offset long, _again boolean"
    left, done, turn, before = stage(items), None, 0, None
    while True:
        rows, tokens = left.agg(F.count(F.lit(1)), F.sum("length")).first()
        count = max(partitions_for(tokens or 0, group_tokens), partitions_for(rows, group_pieces))
        last = count == 1 or (before is not None and 2 * tokens > before)
        dealt = left.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(count)))
        out = stage(dealt.repartition(min(count, max(width, 1)), "_group").sortWithinPartitions("_group", F.desc("length"))
                    .mapInPandas(_pack_groups(capacity, turn, last), schema))
        placed = out.where("not _again").drop("_again")
        done = placed if done is None else done.unionByName(placed)
        if last:
            return done
        before = tokens
        left, turn = out.where("_again").drop("_again", "sequence_id", "offset"), turn + 1


def pack_documents(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Pieces of all rows of ``docs`` (doc_id, text) with their place in the packed sequences."""
    return pack(pieces(docs, tokenizer), **options)


def sequences(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (array<long>), doc_ids in order."""
    placed = pack(pieces(docs, tokenizer, with_ids=True), **options)

    def join(g: pd.DataFrame) -> pd.DataFrame:  # at most ``capacity`` ids
        g = g.sort_values("offset")
        ids = np.frombuffer(b"".join(g["ids"]), "<u4").astype(np.int64)
        return pd.DataFrame({"sequence_id": [g["sequence_id"].iloc[0]], "ids": [ids], "doc_ids": [g["doc_id"].tolist()]})

    named = placed.select("sequence_id", "offset", "ids", F.col("doc_id").cast("string").alias("doc_id"))
    return named.groupBy("sequence_id").applyInPandas(join, "sequence_id long, ids array<long>, doc_ids array<string>")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), default_tokenizer())


QUERIES = {"op6_sum_of_squares_packing": op6_sum_of_squares_packing}

"""Chunkers whose cuts depend on one another, for use inside Arrow-batched UDFs.

Both work in two steps: measure the text once (break positions, lengths of
paragraphs or sentences), then choose cuts by binary search in those numbers.
Each call sees one whole document; Spark spreads the documents.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa

# Preferred break points, best first.
BREAKS = ["\n\n", "\n", ". ", " "]

OUT_CHARS = 1 << 21  # of the chunks that a task hands on at once

_PARAGRAPH = re.compile(r"\n{2,}")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def break_ends(text: str) -> list[tuple[int, list[int]]]:
    """For each kind of break its length and where its occurrences end, rising."""
    return [(len(mark), [m.start() + len(mark) for m in re.finditer(f"(?={re.escape(mark)})", text)]) for mark in BREAKS]


def boundary_spans(text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """(start, end) of pieces of at most ``size``, each ending at the best break in its second half.

    A text no longer than ``size`` is one piece. The next start always moves
    forward, even if the overlap is larger than the piece.
    """
    kinds, n = break_ends(text), len(text)
    start, end = 0, 0
    while end < n:
        reach = start + size
        middle = start + size // 2
        last_ends = ((ends[bisect_right(ends, reach) - 1] if ends and ends[0] <= reach else 0, width) for width, ends in kinds)
        end = n if reach >= n else next((e for e, width in last_ends if e - width > middle), reach)
        yield start, end
        start = max(end - overlap, start + 1)


def boundary_chunks(text: str | None, size: int = 800, overlap: int = 100) -> Iterator[str]:
    """Overlapping pieces that end on a paragraph, line, sentence or word where possible; blank ones are left out."""
    text = text or ""
    return filter(None, (text[a:b].strip() for a, b in boundary_spans(text, size, overlap)))


class Lengths:
    """Running lengths of parts that are joined by a gap."""

    def __init__(self, parts: list[str], gap: int):
        self.totals, self.gap = list(accumulate((len(p) + gap for p in parts), initial=0)), gap

    def fit(self, first: int, room: int) -> int:
        """End of the longest run of parts from ``first`` that is no longer than ``room``; one part at least."""
        return max(first + 1, bisect_right(self.totals, self.totals[first] + self.gap + room) - 1)


def sentence_groups(text: str, limit: int) -> Iterator[str]:
    """Whole sentences packed up to ``limit``.

    A sentence longer than the limit is cut into limit-sized parts, so no
    text is lost.
    """
    parts = [s[k:k + limit] for s in _SENTENCE.split(text.strip()) for k in range(0, len(s), limit)]
    lengths, at = Lengths(parts, 1), 0
    while at < len(parts):
        end = lengths.fit(at, limit)
        yield " ".join(parts[at:end])
        at = end


def packed_chunks(text: str | None, size: int = 1500, overlap: int = 200) -> Iterator[str]:
    """Paragraphs packed up to ``size``; each new chunk opens with the tail of the last one.

    A text no longer than ``size`` is one chunk. A longer paragraph that no
    tail precedes is packed by sentences.
    """
    text = (text or "").strip()
    parts = [text] if 0 < len(text) <= size else [p for p in (x.strip() for x in _PARAGRAPH.split(text)) if p]
    lengths, at, tail = Lengths(parts, 2), 0, ""
    while at < len(parts):
        if not tail and len(parts[at]) > size:
            yield from sentence_groups(parts[at], size)
            at += 1
            continue
        end = lengths.fit(at, size - (len(tail) + 2 if tail else 0))
        chunk = "\n\n".join([tail, *parts[at:end]] if tail else parts[at:end])
        yield chunk
        at, tail = end, chunk[-overlap:].lstrip()


METHODS = {"boundary": boundary_chunks, "packed": packed_chunks}


def chunk_batches(method: str, size: int, overlap: int, keep: list[str], text: str = "extracted_text"):
    """Arrow batches of documents to batches of chunks (``keep``, chunk_index, piece) of some OUT_CHARS characters.

    Texts are taken one by one, so a task holds one batch as it came and one
    batch of chunks, however many chunks the documents give.
    """
    fn = METHODS[method]

    def made(batch: pa.RecordBatch, rows: list[int], index: list[int], pieces: list[str]) -> pa.RecordBatch:
        columns = [batch.column(c).take(pa.array(rows, pa.int64())) for c in keep]
        return pa.RecordBatch.from_arrays([*columns, pa.array(index, pa.int32()), pa.array(pieces, pa.string())], [*keep, "chunk_index", "piece"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, index, pieces, chars = [], [], [], 0
            for i, value in enumerate(batch.column(text)):
                for j, piece in enumerate(fn(value.as_py(), size, overlap)):
                    rows.append(i)
                    index.append(j)
                    pieces.append(piece)
                    chars += len(piece)
                    if chars >= OUT_CHARS:
                        yield made(batch, rows, index, pieces)
                        rows, index, pieces, chars = [], [], [], 0
            if rows:
                yield made(batch, rows, index, pieces)

    return run

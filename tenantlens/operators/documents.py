"""Document jobs: chunking, classification, summaries, contract fields, pending work."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tenantlens.functions import text as tx
from tenantlens.functions.chunking import chunk_batches
from tenantlens.functions.columns import nz, stable_id
from tenantlens.sources.sinks import materialize

DOC = ["document_id", "org_id"]
LABELS = list(tx.LABEL_WORDS)
CHUNK_COLUMNS = ("document_id", "org_id", "document_name", "document_type")  # of its document that a chunk keeps


def _finish(df: DataFrame, chunk_text: Column, all_columns: bool = False) -> DataFrame:
    """Common chunk columns, or with ``all_columns`` all of the document's but its text; the id derives from document and position."""
    keep = [c for c in df.columns if c not in ("extracted_text", "piece", "chunk_index", "chunks")] if all_columns else [
        c for c in CHUNK_COLUMNS if c in df.columns]
    return df.select(
        stable_id(F.col("document_id"), F.col("chunk_index").cast("string")).alias("chunk_id"), *keep, "chunk_index",
        chunk_text.alias("chunk_text"), F.length(chunk_text).alias("char_count"))


def chunk_paragraphs(docs: DataFrame, *, sep: str = "\n\n", min_chars: int = 50) -> DataFrame:
    """Separator-delimited pieces longer than ``min_chars``; the index is the position in the split."""
    text = docs.filter(F.length(F.trim("extracted_text")) > 0)
    pieces = text.select("*", F.posexplode(F.split("extracted_text", re.escape(sep))).alias("chunk_index", "piece"))
    return _finish(pieces.filter(F.length(F.trim("piece")) > min_chars), F.trim("piece"))


def chunk_window(docs: DataFrame, *, size: int = 1500, overlap: int = 200, all_columns: bool = False) -> DataFrame:
    """Fixed windows with overlap.

    The text is cut once into pieces of one step; a window is a piece plus the
    head of the next. Taking substrings by offset would rescan the text from
    its start for every window.
    """
    step = size - overlap
    if not 0 <= overlap <= step:
        raise ValueError("overlap must not exceed half of the window")
    text = F.col("extracted_text")
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    parts = docs.filter(F.length(text) > 0).withColumn("_p", pieces)
    windows = F.transform("_p", lambda piece, i: F.concat(piece, F.substring(F.coalesce(F.get("_p", i + 1), F.lit("")), 1, overlap)))
    whole = F.when(F.length(text) <= size, F.array(text)).otherwise(windows)
    rows = parts.withColumn("_w", whole).drop("extracted_text", "_p").select("*", F.posexplode("_w").alias("chunk_index", "piece")).drop("_w")
    return _finish(rows, F.col("piece"), all_columns)


def chunk_sequential(docs: DataFrame, *, method: str, size: int, overlap: int) -> DataFrame:
    """Boundary-aware or paragraph-packing chunks (``boundary`` or ``packed``).

    The text and the columns a chunk keeps cross to Python as Arrow; chunks
    come back as rows, a bounded number at a time. The id is made in the JVM.
    """
    keep = [c for c in CHUNK_COLUMNS if c in docs.columns]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("chunk_index", T.IntegerType()), T.StructField("piece", T.StringType())])
    pieces = docs.select(*keep, "extracted_text").mapInArrow(chunk_batches(method, size, overlap, keep), schema)
    return _finish(pieces, F.col("piece"))


def chunk(docs: DataFrame, *, method: str = "paragraph", size: int = 1500, overlap: int = 200, sep: str = "\n\n") -> DataFrame:
    if method == "paragraph":
        return chunk_paragraphs(docs, sep=sep)
    if method == "window":
        return chunk_window(docs, size=size, overlap=overlap)
    return chunk_sequential(docs, method=method, size=size, overlap=overlap)


def classify(docs: DataFrame, *, min_score: float = 0.6, vocabulary=tx.LABEL_WORDS) -> DataFrame:
    """Label by keyword share; the given type stays unless the score reaches ``min_score``.

    Ties go to the label listed first.
    """
    out = docs.withColumn("_best", tx.best_label("extracted_text", vocabulary))
    score, label = nz(F.col("_best.score"), 0.0), F.when(F.col("_best.score").isNotNull(), F.col("_best.label"))
    given = F.lower(nz("document_type", "other"))
    return out.select(
        "document_id", "org_id", F.coalesce(label, given).alias("document_category"), score.alias("category_score"),
        F.when(score >= min_score, label).otherwise(given).alias("document_type"))


def summarize(docs: DataFrame, *, k: int = 3) -> DataFrame:
    return docs.select("document_id", "org_id", tx.summary("extracted_text", k).alias("summary"))


def extract_contract_fields(docs: DataFrame) -> DataFrame:
    """Typed contract fields by rule; a text that yields none is marked for review.

    Values that do not convert become NULL instead of failing the row.
    """
    raw = docs.select("document_id", "org_id", "extracted_text", *[tx.contract_field("extracted_text", f).alias(f) for f in tx.CONTRACT_RULES])
    found = F.coalesce(*tx.CONTRACT_RULES).isNotNull()
    text = F.lower("extracted_text")
    renews = F.when(text.contains("does not renew"), False).when(text.contains("renews automatically"), True)
    flags = F.array_compact(F.array(
        F.when(~found, "Parsing failed - manual review required"),
        F.when(found & F.col("expiration_date").try_cast("date").isNull(), "missing_expiration"),
        F.when(renews & F.col("notice_days").isNull(), "renewal_without_notice"),
        F.when(text.contains("unlimited liability"), "unlimited_liability")))
    return raw.select(
        "document_id", "org_id",
        F.col("effective_date").try_cast("date").alias("start_date"), F.col("expiration_date").try_cast("date").alias("end_date"),
        F.col("total_value").try_cast("decimal(18,2)").alias("contract_value"), "total_value_currency",
        renews.alias("auto_renewal"), F.col("notice_days").try_cast("int").alias("notice_days"), "governing_law", "party_a", "party_b",
        "payment_terms", F.col("uptime_pct").try_cast("decimal(6,3)").alias("sla_uptime_pct"),
        flags.alias("risk_flags"), (~found).alias("parse_error"), F.lit("completed").alias("extraction_status"))


def pending(items: DataFrame, done: DataFrame, key: str | list[str], *, text: str | None = None, min_chars: int = 0, limit: int | None = None,
            order: str = "created_at") -> DataFrame:
    """Items without a result yet; ``limit`` bounds one run's cost, oldest first."""
    keys = [key] if isinstance(key, str) else key
    left = items.join(done.select(*keys).distinct(), keys, "left_anti")
    if text is not None:
        left = left.filter(F.length(F.trim(text)) > min_chars)
    return left if limit is None else left.orderBy(order, *keys).limit(limit)


def advance_status(docs: DataFrame, finished: DataFrame, failed: DataFrame) -> DataFrame:
    """pending -> completed or failed, by the ids of this run."""
    marks = finished.select("document_id", F.lit("completed").alias("_to")).unionByName(
        failed.select("document_id", F.lit("failed").alias("_to")))
    marks = marks.groupBy("document_id").agg(F.max("_to").alias("_to"))
    return docs.join(marks, "document_id", "left").withColumn(
        "processing_status", F.when(F.col("processing_status") == "pending", nz("_to", "pending")).otherwise(F.col("processing_status"))
    ).drop("_to")


def kb_documents(pages: DataFrame) -> DataFrame:
    """Web pages as knowledge-base documents with their visible text."""
    # Knowledge-base names by page number.
    names = F.array(F.lit("product_docs"), F.lit("support_articles"), F.lit("release_notes"))
    return pages.select(
        F.col("page_id").alias("doc_id"), F.get(names, (F.col("page_id") % 3).cast("int")).alias("kb_name"), "url",
        tx.html_to_text("html").alias("content"), (F.col("page_id") % 10 != 7).alias("is_active"))


def kb_view(kb: DataFrame, *, min_chars: int = 50) -> DataFrame:
    return kb.filter("is_active").filter(F.length("content") > min_chars)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Different words of every row, and how often each stands there."""
    for b in batches:
        words = b.column(2)
        flat = words.flatten().dictionary_encode()
        row = np.repeat(np.arange(len(b)), pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))
        width = max(1, len(flat.dictionary))
        found, tf = np.unique(row * width + flat.indices.to_numpy(zero_copy_only=False), return_counts=True)
        bounds = pa.array(np.searchsorted(found, np.arange(len(b) + 1) * width), pa.int32())
        terms = flat.dictionary.take(pa.array(found % width))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.ListArray.from_arrays(bounds, x) for x in (terms, pa.array(tf)))],
                                         names=["document_id", "org_id", "terms", "tfs"])


def _counts(docs: DataFrame) -> DataFrame:
    words = F.array_remove(F.split(F.lower("extracted_text"), r"[^\p{L}\p{N}]+"), "")
    keys = ", ".join(f"{k} {docs.schema[k].dataType.simpleString()}" for k in DOC)
    return docs.select(*DOC, words.alias("words")).mapInArrow(_count_words, f"{keys}, terms array<string>, tfs array<long>")


def _counted(docs: DataFrame) -> DataFrame:
    """(document_id, org_id, terms, tfs) of every row of ``docs``, staged: the texts are split once."""
    return materialize(_counts(docs))


def _repeated(counted: DataFrame) -> tuple[DataFrame, Column]:
    """Keys that more than one row has, staged, and the condition that a row has one of them."""
    again = materialize(counted.groupBy(*DOC).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*[F.col(k).alias(f"_{k}") for k in DOC]))
    return again, F.col("document_id").eqNullSafe(F.col("_document_id")) & F.col("org_id").eqNullSafe(F.col("_org_id"))


def _frequencies(counted: DataFrame) -> DataFrame:
    tf = counted.select(*DOC, F.inline(F.arrays_zip("terms", "tfs")).alias("term", "tf"))
    again, same = _repeated(counted)
    if again.isEmpty():
        return tf
    merged = materialize(tf.join(again, same, "left_semi").groupBy(*DOC, "term").agg(F.sum("tf").alias("tf")))
    return tf.join(again, same, "left_anti").unionByName(merged)


def term_frequencies(docs: DataFrame) -> DataFrame:
    """(document_id, org_id, term, tf): how often each word stands in each document.

    Words are counted inside the row; only rows of a key that comes more than
    once have to meet.
    """
    return _frequencies(_counted(docs))


def term_weights(docs: DataFrame, *, frequent: int = 1 << 16) -> DataFrame:
    """(document_id, org_id, term, weight): term frequency times ln((documents + 1) / (documents with the term + 1)).

    The ``frequent`` terms that most documents have are a bounded table, which
    goes to the words where they are; only the other words are exchanged.
    """
    counted = _counted(docs)
    tf, n = _frequencies(counted), counted.count()
    df = materialize(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    most = materialize(df.orderBy(F.col("df").desc(), "term").limit(frequent))
    rare = df.join(F.broadcast(most), "term", "left_anti")
    met = tf.join(F.broadcast(most), "term").unionByName(tf.join(F.broadcast(most), "term", "left_anti").join(rare, "term"))
    return met.select(*DOC, "term", (F.col("tf") * F.log((F.lit(float(n)) + 1) / (F.col("df") + 1))).alias("weight"))


def document_terms(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The weights of ``term_weights`` in two tables that need no exchange of single words.

    (doc, document_id, org_id, terms, tfs), one row a document with a key, and
    (term, n, scale): documents with a key that have the term, and its logarithm.
    """
    counted = materialize(_counts(docs).withColumn("doc", F.monotonically_increasing_id()))
    rows, (again, same) = counted, _repeated(counted)
    if not again.isEmpty():
        tf = counted.join(again, same, "left_semi").select("doc", *DOC, F.inline(F.arrays_zip("terms", "tfs")).alias("term", "tf"))
        tf = tf.groupBy(*DOC, "term").agg(F.min("doc").alias("doc"), F.sum("tf").alias("tf"))
        merged = tf.groupBy(*DOC).agg(F.min("doc").alias("doc"), F.collect_list(F.struct("term", "tf")).alias("t"))
        merged = materialize(merged.select(*DOC, "doc", F.col("t.term").alias("terms"), F.col("t.tf").alias("tfs")))
        rows = counted.join(again, same, "left_anti").unionByName(merged)
    df = rows.select("document_id", F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.count("document_id").alias("n"))
    scale = F.log((F.lit(float(counted.count())) + 1) / (F.col("df") + 1))
    return rows.where("document_id is not null"), materialize(df.where("n > 0").select("term", "n", scale.alias("scale")))


def embed(docs: DataFrame, *, dims: int = 1 << 12) -> DataFrame:
    """TF-IDF features of the whole text with Spark ML."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import HashingTF, IDF, Normalizer, RegexTokenizer

    stages = [
        RegexTokenizer(inputCol="extracted_text", outputCol="tokens", pattern=r"[^\p{L}\p{N}]+"),
        HashingTF(inputCol="tokens", outputCol="tf", numFeatures=dims),
        IDF(inputCol="tf", outputCol="tfidf"), Normalizer(inputCol="tfidf", outputCol="embedding"),
    ]
    return Pipeline(stages=stages).fit(docs).transform(docs).select("document_id", "org_id", "embedding")

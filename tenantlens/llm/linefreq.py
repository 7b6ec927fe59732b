"""Quality rules with cross-document line frequency. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tenantlens.llm.common import stage, table, text_key

MAX_DOCUMENTS = 20  # of one host that may share a line
MIN_LEFT = 0.3  # share of a document's words that must survive
MIN_WORDS = 50
ADDED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_words_left", "kept"]
_SPACE = r"[\x20\x09-\x0D]+"
_SYMBOLS = "#*$%&|<>"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, _SPACE), "")


def base_metrics(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed.

    Words are runs without ASCII white space; a null text has none. A word is
    repeated if a window of three words that covers it occurs twice in the text.
    """
    # Each step is a column of its own: what several later columns use is computed once.
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    out = docs.withColumns({"_w": F.transform(_words(text), lambda x: F.xxhash64(x)), "_lines": lines})
    window = F.transform(F.sequence(F.lit(1), F.size("_w") - 2), lambda i: F.xxhash64(
        F.get(F.col("_w"), i - 1), F.get(F.col("_w"), i), F.get(F.col("_w"), i + 1)))
    out = out.withColumn("_win", F.when(F.size("_w") > 2, window).otherwise(F.array().cast("array<bigint>")))
    # windows that repeat, by position: neighbours of equal hash once sorted
    ranked = F.sort_array(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    out = out.withColumn("_ranked", F.when(F.size(F.array_distinct("_win")) < F.size("_win"), ranked))
    same = F.filter("_ranked", lambda x, i: (F.get(F.col("_ranked"), i - 1).h == x.h) | (F.get(F.col("_ranked"), i + 1).h == x.h))
    out = out.withColumn("_same", F.sort_array(F.transform(same, lambda x: x.at)))
    covered = F.aggregate(F.transform("_same", lambda p, i: F.least(F.lit(3), F.coalesce(F.get(F.col("_same"), i + 1) - p, F.lit(3)))),
                          F.lit(0).cast("long"), lambda a, x: a + x)
    out = out.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.regexp_replace(text, _SPACE, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, _SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0).cast("long")),
    })
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return out.withColumn("base_failed", failed).drop("_w", "_win", "_ranked", "_same", "_lines")


def _normal(line: str | Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), _SPACE, " "), "[0-9]+", "0"))


def lines_of(docs: DataFrame) -> DataFrame:
    """(host, text_id, line, words, times): each different normalised line of a text, with its words and occurrences.

    Lines are compared lower-cased, with runs of white space as one space and
    digit runs as one 0.
    """
    each = docs.select("host", "text_id", F.explode(F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)).alias("x"))
    each = each.select("host", "text_id", _normal("x").alias("x")).where("x != ''")
    words = F.length("x") - F.length(F.replace(F.col("x"), F.lit(" "), F.lit(""))) + 1
    return each.select("host", "text_id", F.xxhash64("x").alias("line"), words.alias("words"))


def boilerplate(docs: DataFrame, max_documents: int = MAX_DOCUMENTS, *, copies: bool = True) -> DataFrame:
    """(host, line) of the lines that more than ``max_documents`` documents of the host share.

    ``docs`` has host, text_id and text; each row is a document, and a line
    counts once in it. With ``copies`` false, documents with equal texts of a
    host count as one. Counts are summed before they are exchanged.
    """
    each = docs if copies else docs.select("host", "text_id", "text").dropDuplicates(["host", "text_id"])
    normal = F.transform(F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1), _normal)
    hashes = F.array_distinct(F.transform(F.filter(normal, lambda x: x != ""), lambda x: F.xxhash64(x)))
    counts = each.select("host", F.explode(hashes).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("documents"))
    return counts.where(F.col("documents") > max_documents).select("host", "line")


def judge(docs: DataFrame, *, max_documents: int = MAX_DOCUMENTS, min_left: float = MIN_LEFT, copies: bool = True) -> DataFrame:
    """``docs`` with the base metrics, n_words_left (after boilerplate lines went) and kept.

    ``source`` is the host; rows without one share the empty host. With ``copies``
    false, equal texts of a host count as one document. A document
    is kept if it passes the base rules and at least ``min_left`` of its words
    are left. A null or empty text has no words and fails. Rows are judged by
    host and text alone, so repeated rows get equal verdicts. Added columns
    replace columns of the same name.
    """
    rest = [c for c in docs.columns if c not in ADDED]
    # the text stays a column of its own, so that it need not move where the caller drops it
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest if c != "text"]).alias("row"), "text", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"),
                       text_key(F.col("text")).alias("text_id"))
    lines = lines_of(docs)
    common = stage(boilerplate(docs, max_documents, copies=copies))
    # a text's lines are read once for each row that has it: sum over one row's share
    hit = lines.join(common, ["host", "line"]).groupBy("host", "text_id").agg(F.sum("words").alias("gone"))
    rows = docs.select("host", "text_id").join(common.select("host").distinct(), "host", "left_semi").groupBy("host", "text_id").agg(F.count(F.lit(1)).alias("rows"))
    gone = stage(hit.join(rows, ["host", "text_id"]).select("host", "text_id", (F.col("gone") / F.col("rows")).cast("long").alias("gone")))
    out = base_metrics(docs).join(gone, ["host", "text_id"], "left")
    out = out.withColumn("n_words_left", F.col("n_words") - F.coalesce("gone", F.lit(0)))
    kept = ~F.col("base_failed") & (F.col("n_words_left") >= F.col("n_words") * min_left)
    return out.withColumn("kept", kept).select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in rest], *ADDED)


def strip_boilerplate(docs: DataFrame, *, max_documents: int = MAX_DOCUMENTS, min_left: float = MIN_LEFT, copies: bool = True) -> DataFrame:
    """The rows of ``docs`` that are kept, without their boilerplate lines; same columns."""
    judged = judge(docs.select("source", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")), max_documents=max_documents, min_left=min_left, copies=copies)
    kept = judged.where("kept").select("doc", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"), text_key(F.col("text")).alias("text_id"))
    hosted = docs.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"), text_key(F.col("text")).alias("text_id"), "text")
    common = stage(boilerplate(hosted, max_documents, copies=copies))
    once = kept.select("host", "text_id", F.col("doc.text").alias("text")).dropDuplicates(["host", "text_id"])
    each = once.select("host", "text_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "x")).withColumn("line", F.xxhash64(_normal("x")))
    left = each.join(common, ["host", "line"], "left_anti")
    lines = F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda s: s.x)
    texts = left.groupBy("host", "text_id").agg(F.array_join(lines, "\n").alias("new"))
    out = kept.join(stage(texts), ["host", "text_id"])
    return out.select(*[(F.col("new") if c == "text" else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def op2_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_words_left")


QUERIES = {"op2_line_frequency": op2_line_frequency}

ORACLES = {"op2_line_frequency": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM w, unnest(range(1, len(w) - 1)) AS t(i)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1),
rw AS (SELECT rid, count(DISTINCT i + k) AS n FROM rep, range(0, 3) AS t(k) GROUP BY rid),
line AS (SELECT rid, host, text, trim(regexp_replace(regexp_replace(lower(x), '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]+', '0', 'g')) AS x
         FROM (SELECT rid, host, text, unnest(string_split(text, chr(10))) AS x FROM d)),
common AS (SELECT host, x FROM line WHERE x <> '' GROUP BY host, x HAVING count(DISTINCT rid) > 20),
gone AS (SELECT rid, sum(len(x) - len(replace(x, ' ', '')) + 1) AS n FROM line JOIN common USING (host, x) GROUP BY rid),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rw.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS gone
      FROM w LEFT JOIN rw USING (rid) LEFT JOIN gone USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - gone >= n_words * CAST(0.3 AS DOUBLE) AS kept, n_words - gone AS n_words_left
FROM m"""}

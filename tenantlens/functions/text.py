"""Text columns: HTML to text, markdown clean-up, sentiment, labels, field extraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# What is removed or replaced, in this order.
HTML_STEPS = [
    (r"<script[^>]*>[\s\S]*?</script>", ""),
    (r"<style[^>]*>[\s\S]*?</style>", ""),
    (r"<[^>]+>", " "),
    (r"&nbsp;", " "),
    (r"&lt;", "<"),
    (r"&gt;", ">"),
    (r"&amp;", "&"),
    (r"\s{3,}", "\n\n"),
]

# Markdown marks dropped before chunking; their text is kept.
MARKDOWN_STEPS = [
    (r"\[([^\]]+)\]\([^)]+\)", "$1"),
    (r"(?m)^#{1,6}\s+", ""),
    (r"\*\*([^*]+)\*\*", "$1"),
    (r"\*([^*]+)\*", "$1"),
]

POSITIVE = ["good", "great", "excellent", "happy", "love", "thanks", "resolved", "fast", "helpful", "easy",
            "reliable", "perfect", "pleased", "improved", "success", "recommend", "smooth", "best"]
NEGATIVE = ["bad", "poor", "terrible", "angry", "hate", "broken", "slow", "error", "failed", "issue", "problem",
            "outage", "refund", "cancel", "worst", "trash", "idiot", "late", "unacceptable"]

# Own English vocabulary per document label, matched as whole words.
LABEL_WORDS = {
    "contract": ["agreement", "contract", "parties", "term", "termination"],
    "sla": ["uptime", "availability", "response", "resolution"],
    "amendment": ["amendment", "amended", "supersedes"],
    "invoice": ["invoice", "billed", "due"],
    "proposal": ["proposal", "offer", "scope"],
    "nda": ["confidential", "disclosure", "nondisclosure"],
}

# Extraction rules: field -> (pattern, group 1 is the value).
CONTRACT_RULES = {
    "effective_date": r"[Ee]ffective date: *([0-9]{4}-[0-9]{2}-[0-9]{2})",
    "expiration_date": r"[Ee]xpiration date: *([0-9]{4}-[0-9]{2}-[0-9]{2})",
    "total_value_currency": r"[Tt]otal value: *([A-Z]{3})",
    "total_value": r"[Tt]otal value: *[A-Z]{3} *([0-9.]+)",
    "notice_days": r"notice of ([0-9]+) days",
    "governing_law": r"laws of ([A-Z][A-Z ]*[A-Z])",
    "party_a": r"between ([^,]+), ",
    "party_b": r", and ([^.]+)\.",
    "payment_terms": r"[Pp]ayment terms: *([^.]+)\.",
    "uptime_pct": r"[Uu]ptime of ([0-9.]+)%",
}


def _rewrite(col: Column, steps) -> Column:
    return reduce(lambda c, step: F.regexp_replace(c, F.lit(step[0]), F.lit(step[1])), steps, col)


def strip(col: Column) -> Column:
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def html_to_text(col: Column | str) -> Column:
    """Visible text of a page: scripts, styles and tags out, four entities decoded."""
    return strip(_rewrite(F.col(col) if isinstance(col, str) else col, HTML_STEPS))


def strip_markdown(col: Column | str) -> Column:
    return _rewrite(F.col(col) if isinstance(col, str) else col, MARKDOWN_STEPS)


def words(col: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(col), F.lit(r"[a-z]+"), F.lit(0))


def sentiment_score(col: Column | str, positive=POSITIVE, negative=NEGATIVE) -> Column:
    """(positive - negative) / hits over the whole text, 0 without any hit.

    Counts run inside the row with array functions: no explode, no shuffle.
    """
    tokens = words(F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")))
    # one fold over the tokens: the text is split once, whatever the result refers to
    zero = F.struct(F.lit(0).alias("up"), F.lit(0).alias("down"))
    counted = F.aggregate(tokens, zero, lambda a, t: F.struct((a.up + t.isin(positive).cast("int")).alias("up"), (a.down + t.isin(negative).cast("int")).alias("down")),
                          lambda a: F.when(a.up + a.down > 0, F.round((a.up - a.down) / (a.up + a.down), 3)).otherwise(F.lit(0.0)))
    return counted


def best_label(col: Column | str, vocabulary=LABEL_WORDS) -> Column:
    """Struct (score, rank, label) of the label with the largest share, the first listed of equals; null score without hits.

    One fold counts all labels, so the text is split once. It takes the tokens
    of the vocabulary only: one look-up for each of the others.
    """
    known = sorted({term for terms in vocabulary.values() for term in terms})
    return F.aggregate(F.filter(words(col), lambda t: t.isin(known)), _no_hits(vocabulary), lambda a, t: _count(a, t, vocabulary), lambda a: F.array_max(F.array(*[
        F.struct(F.round(a[f"n{i}"] / _all_hits(a, vocabulary), 4).alias("score"), F.lit(-i).alias("rank"), F.lit(label).alias("label"))
        for i, label in enumerate(vocabulary)])))


def _no_hits(vocabulary) -> Column:
    return F.struct(*[F.lit(0).alias(f"n{i}") for i in range(len(vocabulary))])


def _count(a: Column, token: Column, vocabulary) -> Column:
    return F.struct(*[(a[f"n{i}"] + token.isin(terms).cast("int")).alias(f"n{i}") for i, terms in enumerate(vocabulary.values())])


def _all_hits(a: Column, vocabulary) -> Column:
    return F.nullif(reduce(lambda x, y: x + y, [a[f"n{i}"] for i in range(len(vocabulary))]), F.lit(0))


def sentences(col: Column | str) -> Column:
    """Runs up to and including closing punctuation; an unpunctuated tail counts too."""
    found = F.regexp_extract_all(col, F.lit(r"[^.!?]+[.!?]*"), F.lit(0))
    return F.filter(F.transform(found, strip), lambda s: s != "")


def summary(col: Column | str, k: int = 3) -> Column:
    return F.array_join(F.slice(sentences(col), 1, k), " ")


def contract_field(col: Column | str, field: str) -> Column:
    found = F.regexp_extract(col, CONTRACT_RULES[field], 1)
    return F.when(found != "", found)


def document_type(path: Column | str) -> Column:
    """Type by file extension."""
    # Extension -> document type.
    ext = F.regexp_extract(F.lower(path), r"\.([^./]+)$", 1)
    known = {"pdf": "contract", "docx": "report", "xlsx": "financial", "txt": "note"}
    out = F.lit("other")
    for suffix, kind in known.items():
        out = F.when(ext == suffix, kind).otherwise(out)
    return out

"""Document, chunk, search and text queries."""

import uuid

from pyspark.sql import functions as F

from tenantlens.functions import text as tx
from tenantlens.operators import documents as doc, embedding as em, search as se, vector_index as vi
from tenantlens.plans import content as co
from tenantlens.registry.core import define, query
from tenantlens.registry.oracle_tables import D0
from tenantlens.registry.profile import c360
from tenantlens.settings import checkpoint_root

# Values written out again, so that a wrong one in the package shows.
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
POSITIVE = ["good", "great", "excellent", "happy", "love", "thanks", "resolved", "fast", "helpful", "easy",
            "reliable", "perfect", "pleased", "improved", "success", "recommend", "smooth", "best"]
NEGATIVE = ["bad", "poor", "terrible", "angry", "hate", "broken", "slow", "error", "failed", "issue", "problem",
            "outage", "refund", "cancel", "worst", "trash", "idiot", "late", "unacceptable"]
LABEL_WORDS = {
    "contract": ["agreement", "contract", "parties", "term", "termination"],
    "sla": ["uptime", "availability", "response", "resolution"],
    "amendment": ["amendment", "amended", "supersedes"],
    "invoice": ["invoice", "billed", "due"],
    "proposal": ["proposal", "offer", "scope"],
    "nda": ["confidential", "disclosure", "nondisclosure"],
}
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

_HTML = "html"
for pattern, repl in HTML_STEPS:
    _HTML = f"regexp_replace({_HTML}, '{pattern}', {'chr(10) || chr(10)' if repl.strip(chr(10)) == '' and repl else chr(39) + repl + chr(39)}, 'g')"
define("m_kb", f"""
SELECT page_id AS doc_id, CASE page_id % 3 WHEN 0 THEN 'product_docs' WHEN 1 THEN 'support_articles' ELSE 'release_notes' END AS kb_name, url,
  regexp_replace({_HTML}, '^\\s+|\\s+$', '', 'g') AS content, page_id % 10 <> 7 AS is_active FROM pages""")

define("m_window_chunks", """
SELECT md5(document_id || '::' || i) AS chunk_id, document_id, org_id, document_name, document_type, i AS chunk_index,
  substring(extracted_text, i * 1300 + 1, 1500) AS chunk_text, length(substring(extracted_text, i * 1300 + 1, 1500)) AS char_count
FROM (SELECT *, unnest(generate_series(0, CASE WHEN length(extracted_text) <= 1500 THEN 0 ELSE (length(extracted_text) - 1) // 1300 END)) AS i
  FROM b_documents WHERE length(extracted_text) > 0)""")


def window_chunks(t):
    return doc.chunk(t.documents, method="window")


@query("a9_html_to_text", "SELECT doc_id, url, content FROM m_kb")
def _(t):
    return doc.kb_documents(t.pages).select("doc_id", "url", "content")


@query("a8_document_type_by_extension", """
SELECT document_id, CASE document_id[-1] WHEN '0' THEN 'report' WHEN '1' THEN 'financial' WHEN '2' THEN 'note' WHEN '3' THEN 'other' ELSE 'contract' END AS inferred_type
FROM b_documents""")
def _(t):
    tail = F.substring("document_id", -1, 1)
    ext = F.when(tail == "0", ".DOCX").when(tail == "1", ".xlsx").when(tail == "2", ".txt").when(tail == "3", ".bin").otherwise(".pdf")
    path = F.concat(F.lit("in.box/"), F.col("document_id"), ext)
    return t.documents.select("document_id", tx.document_type(path).alias("inferred_type"))


@query("e22_contract_intelligence", f"""
SELECT document_id, d.org_id, document_name AS contract_name, entity_id AS customer_id, c.customer_name, end_date,
  date_diff('day', {D0}, end_date) AS days_to_expiry,
  CASE WHEN end_date < {D0} THEN 'EXPIRED' WHEN end_date <= {D0} + 30 THEN 'EXPIRING_SOON' WHEN end_date <= {D0} + 90 THEN 'RENEW_WATCH' ELSE 'ACTIVE' END AS renewal_status,
  auto_renewal, risk_flag_count, created_at AS uploaded_at
FROM b_documents d LEFT JOIN m_c360 c ON d.entity_id = c.customer_id AND d.org_id = c.org_id WHERE document_type = 'contract'""", dates="end_date uploaded_at")
def _(t):
    return co.contract_intelligence(t.documents, c360(t))


define("m_chunk_counts", "SELECT document_id, count(*) AS n FROM m_window_chunks GROUP BY 1")


@query("e23_document_chunk_counts", """
SELECT document_id, org_id, document_name, document_type, processing_status, created_at, coalesce(n, 0) AS chunk_count
FROM b_documents LEFT JOIN m_chunk_counts USING (document_id) WHERE document_type IN ('contract', 'sla', 'amendment')""", times="created_at")
def _(t):
    return co.document_chunk_counts(t.documents, window_chunks(t))


@query("e24_contract_chunks", """
SELECT k.chunk_id, k.document_id, k.chunk_index, k.chunk_text, d.org_id, d.document_name AS contract_name, d.document_type, d.entity_id AS customer_id,
  d.end_date, d.auto_renewal, c.name AS customer_name
FROM m_window_chunks k JOIN b_documents d ON k.document_id = d.document_id LEFT JOIN b_customers c ON d.entity_id = c.customer_id
WHERE d.document_type IN ('contract', 'sla', 'amendment')""", dates="end_date")
def _(t):
    return co.contract_chunks(t.documents, t.customers)


define("m_library", """
SELECT document_id, d.org_id, document_name, document_type, 'customer' AS entity_type, coalesce(name, entity_id) AS entity_name, processing_status,
  coalesce(n, 0) AS chunks, d.created_at
FROM b_documents d LEFT JOIN b_customers c ON entity_id = customer_id LEFT JOIN m_chunk_counts USING (document_id)""")


def library(t):
    return co.document_library(t.documents, t.customers, window_chunks(t))


@query("e35_document_library", "SELECT * FROM m_library", times="created_at")
def _(t):
    return library(t)


@query("e35_library_totals", """
SELECT org_id, count(*) AS documents, count(*) FILTER (processing_status = 'completed') AS completed,
  count(*) FILTER (processing_status = 'pending') AS pending, CAST(sum(chunks) AS BIGINT) AS chunks FROM m_library GROUP BY 1""")
def _(t):
    return co.library_totals(library(t))


@query("e36_kb_view", "SELECT * FROM m_kb WHERE is_active AND length(content) > 50")
def _(t):
    return doc.kb_view(doc.kb_documents(t.pages))


def _list(ws):
    return "[" + ", ".join(f"'{w}'" for w in ws) + "]"


_TOK = "regexp_extract_all(lower(extracted_text), '[a-z]+')"


def _n(ws):
    return f"len(list_filter({_TOK}, lambda w: list_contains({_list(ws)}, w)))"


@query("m6_sentiment", f"""
SELECT document_id, score AS sentiment_score, CASE WHEN score > 0.2 THEN 'positive' WHEN score < -0.2 THEN 'negative' ELSE 'neutral' END AS sentiment_label
FROM (SELECT document_id, CASE WHEN p + n > 0 THEN round((p - n) / (p + n), 3) ELSE 0 END AS score
  FROM (SELECT document_id, {_n(POSITIVE)} AS p, {_n(NEGATIVE)} AS n FROM b_documents))""")
def _(t):
    from tenantlens.functions.columns import sentiment_label
    return t.documents.select("document_id", tx.sentiment_score("extracted_text").alias("sentiment_score")) \
        .withColumn("sentiment_label", sentiment_label(F.col("sentiment_score"), 0.2))


@query("m7_paragraph_chunks", """
SELECT md5(document_id || '::' || (i - 1)) AS chunk_id, document_id, org_id, document_name, document_type, i - 1 AS chunk_index, trim(piece) AS chunk_text,
  length(trim(piece)) AS char_count
FROM (SELECT * EXCLUDE pieces, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS i FROM (SELECT *, string_split(extracted_text, chr(10)) AS pieces FROM b_documents))
WHERE length(trim(piece)) > 50""")
def _(t):
    return doc.chunk(t.documents, method="paragraph", sep="\n")


@query("m8_window_chunks", "SELECT * FROM m_window_chunks")
def _(t):
    return window_chunks(t)


_SEPS = [("chr(10) || chr(10)", 2), ("chr(10)", 1), ("'. '", 2), ("' '", 1)]
_CUT = " ".join(
    f"WHEN contains(s, {sep}) AND 800 - (position(reverse({sep}) IN reverse(s)) - 1) - {n} > 400 THEN pos + 800 - (position(reverse({sep}) IN reverse(s)) - 1)" for sep, n in _SEPS)


@query("m9_boundary_chunks", rf"""
WITH RECURSIVE walk AS (
  SELECT document_id, org_id, document_name, document_type, extracted_text AS t, 0 AS pos, 0 AS stop FROM b_documents
  UNION ALL SELECT document_id, org_id, document_name, document_type, t, CASE WHEN e >= length(t) THEN length(t) ELSE greatest(e - 100, pos + 1) END, e
  FROM (SELECT *, CASE WHEN pos + 800 >= length(t) THEN length(t) {_CUT} ELSE pos + 800 END AS e FROM (SELECT *, substring(t, pos + 1, 800) AS s FROM walk WHERE pos < length(t)))),
cuts AS (SELECT *, lag(pos) OVER (PARTITION BY document_id ORDER BY pos) AS start FROM walk),
pieces AS (SELECT *, regexp_replace(substring(t, start + 1, stop - start), '^\s+|\s+$', '', 'g') AS chunk_text FROM cuts WHERE start IS NOT NULL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY start) - 1 AS chunk_index FROM pieces WHERE chunk_text <> '')
SELECT md5(document_id || '::' || chunk_index) AS chunk_id, document_id, org_id, document_name, document_type, chunk_index, chunk_text, length(chunk_text) AS char_count FROM numbered""")
def _(t):
    return doc.chunk(t.documents, method="boundary", size=800, overlap=100)


_NN = "chr(10) || chr(10)"
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
# Sentences of a paragraph, cut at the limit, folded into groups: the last list entry is the open one.
_PIECES = r"flatten(list_transform(string_split(regexp_replace(x[1], '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda z: regexp_extract_all(z, '(?s).{1,1500}')))"
_GROUPS = f"""list_reduce(list_transform({_PIECES}, lambda z: [z]), lambda g, y: CASE WHEN length(g[-1]) + length(y[1]) + 1 <= 1500
  THEN list_concat(g[:-2], [g[-1] || ' ' || y[1]]) ELSE list_concat(g, y) END)"""
_PARTS = r"list_filter(list_transform(regexp_split_to_array(t, '\n{2,}'), lambda z: " + _STRIP.format("z") + "), lambda z: z <> '')"


@query("m10_packed_chunks", f"""
SELECT md5(doc_id || '::' || (i - 1)) AS chunk_id, CAST(doc_id AS VARCHAR) AS document_id, i - 1 AS chunk_index, c AS chunk_text, length(c) AS char_count
FROM (SELECT doc_id, unnest(list_filter(l, lambda z: z <> '')) AS c, generate_subscripts(list_filter(l, lambda z: z <> ''), 1) AS i FROM (
  SELECT doc_id, CASE WHEN length(t) <= 1500 THEN [t] ELSE list_reduce(list_transform({_PARTS}, lambda z: [z]), lambda a, x:
      CASE WHEN a[-1] <> '' AND length(a[-1]) + length(x[1]) + 2 > 1500 THEN list_concat(a, [{_STRIP.format(f"right(a[-1], 200) || {_NN} || x[1]")}])
        WHEN a[-1] <> '' THEN list_concat(a[:-2], [a[-1] || {_NN} || x[1]]) WHEN length(x[1]) > 1500 THEN list_concat(a[:-2], {_GROUPS}, ['']) ELSE list_concat(a[:-2], x) END, ['']) END AS l
  FROM (SELECT doc_id, {_STRIP.format("m")} AS t FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(content,
    '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g'), '(?m)^#{{1,6}}\\s+', '', 'g'), '\\*\\*([^*]+)\\*\\*', '\\1', 'g'), '\\*([^*]+)\\*', '\\1', 'g') AS m FROM m_kb))))""")
def _(t):
    pages = doc.kb_documents(t.pages)
    docs = pages.select(F.col("doc_id").cast("string").alias("document_id"), tx.strip_markdown("content").alias("extracted_text"))
    return doc.chunk(docs, method="packed", size=1500, overlap=200)


_SC = {label: _n(ws) for label, ws in LABEL_WORDS.items()}
_TOT = " + ".join(f"n_{label}" for label in _SC)
_BEST = "CASE " + " ".join(f"WHEN n_{label} = top THEN '{label}'" for label in _SC) + " END"


@query("m11_classify", f"""
SELECT document_id, org_id, CASE WHEN total > 0 THEN {_BEST} ELSE given END AS document_category, CASE WHEN total > 0 THEN round(top / total, 4) ELSE 0 END AS category_score,
  CASE WHEN total > 0 AND round(top / total, 4) >= 0.6 THEN {_BEST} ELSE given END AS document_type
FROM (SELECT *, {_TOT} AS total, greatest({", ".join(f"n_{label}" for label in _SC)}) AS top
  FROM (SELECT document_id, org_id, document_type AS given, {", ".join(f"{sql} AS n_{label}" for label, sql in _SC.items())} FROM
    (SELECT document_id, org_id, document_type, extracted_text FROM b_documents UNION ALL SELECT document_id, org_id, document_type, extracted_text FROM b_contract_texts)))""")
def _(t):
    cols = ["document_id", "org_id", "document_type", "extracted_text"]
    return doc.classify(t.documents.select(*cols).unionByName(t.contract_texts.select(*cols)))


@query("m12_summary", r"""
SELECT document_id, org_id, array_to_string(list_slice(list_filter(list_transform(regexp_extract_all(extracted_text, '[^.!?]+[.!?]*'),
  lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> ''), 1, 3), ' ') AS summary FROM b_documents""")
def _(t):
    return doc.summarize(t.documents, k=3)


def _rx(field):
    return f"nullif(regexp_extract(extracted_text, '{CONTRACT_RULES[field]}', 1), '')"


define("m_fields_raw", "SELECT document_id, org_id, extracted_text, " + ", ".join(f"{_rx(f)} AS {f}" for f in CONTRACT_RULES) + """,
  CASE WHEN contains(lower(extracted_text), 'does not renew') THEN false WHEN contains(lower(extracted_text), 'renews automatically') THEN true END AS renews
FROM b_contract_texts""")


@query("m13_contract_fields", f"""
SELECT document_id, org_id, TRY_CAST(effective_date AS DATE) AS start_date, TRY_CAST(expiration_date AS DATE) AS end_date,
  TRY_CAST(total_value AS DECIMAL(18,2)) AS contract_value, total_value_currency, renews AS auto_renewal, TRY_CAST(notice_days AS BIGINT) AS notice_days,
  governing_law, party_a, party_b, payment_terms, TRY_CAST(uptime_pct AS DECIMAL(6,3)) AS sla_uptime_pct,
  concat_ws('|', CASE WHEN NOT found THEN 'Parsing failed - manual review required' END,
    CASE WHEN found AND TRY_CAST(expiration_date AS DATE) IS NULL THEN 'missing_expiration' END,
    CASE WHEN renews AND notice_days IS NULL THEN 'renewal_without_notice' END,
    CASE WHEN contains(lower(extracted_text), 'unlimited liability') THEN 'unlimited_liability' END) AS risk_flags,
  NOT found AS parse_error, 'completed' AS extraction_status
FROM (SELECT *, coalesce({", ".join(CONTRACT_RULES)}) IS NOT NULL AS found FROM m_fields_raw)""",
       dates="start_date end_date", nums="contract_value sla_uptime_pct")
def _(t):
    return doc.extract_contract_fields(t.contract_texts)


@query("m14_pending_chunks", """
SELECT chunk_id, document_id, chunk_index FROM m_window_chunks k WHERE NOT EXISTS (SELECT 1 FROM b_documents d WHERE d.document_id = k.document_id AND d.org_id = k.org_id
  AND d.processing_status = 'completed') AND length(trim(chunk_text)) > 20""")
def _(t):
    done = t.documents.filter(F.col("processing_status") == "completed")
    left = doc.pending(t.documents, done, ["document_id", "org_id"])  # texts of finished documents are not cut
    return doc.chunk(left, method="window").filter(F.length(F.trim("chunk_text")) > 20).select("chunk_id", "document_id", "chunk_index")


@query("m14_status_transition", """
SELECT document_id, CASE WHEN processing_status <> 'pending' THEN processing_status WHEN auto_renewal THEN 'completed'
  WHEN document_type = 'other' THEN 'failed' ELSE 'pending' END AS processing_status FROM b_documents""")
def _(t):
    d = t.documents
    failed = d.filter(~F.col("auto_renewal") & (F.col("document_type") == "other"))
    return doc.advance_status(d, d.filter("auto_renewal"), failed).select("document_id", "processing_status")


@query("m15_dense_embedding", r"""
SELECT document_id, org_id, CASE WHEN regexp_matches(extracted_text, '[\p{L}\p{N}]') THEN 32 END::BIGINT AS dims,
  CASE WHEN regexp_matches(extracted_text, '[\p{L}\p{N}]') THEN 1.0 END AS length FROM b_documents""", nums="length")
def _(t):
    """Unit vectors of 32 numbers for every document with a word; the numbers themselves are tested against numpy."""
    out = em.embed_dense(t.documents.select("document_id", "org_id", "extracted_text"), dims=32)
    v = F.col("embedding")
    return out.select("document_id", "org_id", F.when(v.isNotNull(), F.size(v)).cast("long").alias("dims"), F.round(F.sqrt(se.dot(v, v)), 6).alias("length"))


@query("m15_embed", r"""
WITH tf AS (SELECT document_id, org_id, term, count(*) AS tf FROM (SELECT document_id, org_id, unnest(regexp_extract_all(lower(extracted_text), '[\p{L}\p{N}]+')) AS term FROM b_documents) GROUP BY 1, 2, 3),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)
SELECT document_id, org_id, count(*) AS terms, round(sqrt(sum(power(tf * ln(((SELECT count(*) FROM b_documents) + 1.0::DOUBLE) / (df + 1)), 2))), 4) AS norm
FROM tf JOIN df USING (term) GROUP BY 1, 2""")
def _(t):
    weights = doc.term_weights(t.documents.select("document_id", "org_id", "extracted_text"))
    return weights.groupBy("document_id", "org_id").agg(F.count(F.lit(1)).alias("terms"), F.round(F.sqrt(F.sum(F.col("weight") * F.col("weight"))), 4).alias("norm"))


@query("m16_vector_search", """
WITH c AS (SELECT label, list(m ORDER BY pos) AS q FROM (SELECT label, pos, avg(x) AS m FROM (
    SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM b_embeddings) GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT chunk_id, e.label, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS score FROM b_embeddings e JOIN c ON e.label = c.label)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 5""")
def _(t):
    return se.search_by_group(t.embeddings, se.centroids(t.embeddings, "label"), "label", k=5)


_NEAREST = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
  SELECT q.chunk_id AS query_id, e.chunk_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
  FROM b_embeddings e, b_embeddings q WHERE q.chunk_id % 50 = 0)) WHERE rank <= 10"""


@query("m16_index_search", _NEAREST)
def _(t):
    """Neighbours of every fiftieth vector among all, by the inverted-list index in exact mode."""
    path = f"{checkpoint_root(t.spark)}/run-{uuid.uuid4().hex}"
    vi.build_index(t.embeddings, path, lists=16)
    queries = t.embeddings.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query"))
    return vi.search_index(t.spark, path, queries, k=10, probes=4, exact=True)


@query("m16_filtered_search", """
SELECT e.chunk_id, e.label, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
FROM b_embeddings e, (SELECT embedding FROM b_embeddings ORDER BY chunk_id LIMIT 1) q WHERE e.org_id = 'ORG-2' ORDER BY score DESC, chunk_id LIMIT 10""")
def _(t):
    first = t.embeddings.orderBy("chunk_id").select("embedding").first()
    return se.search(t.embeddings, first[0], k=10, filters={"org_id": "ORG-2"}).select("chunk_id", "label", "score")


_TERMS = ["license", "released", "trash", "thatin"]
_TF = ", ".join(f"len(list_filter({_TOK}, lambda w: w = '{w}')) AS tf{i}" for i, w in enumerate(_TERMS))
_DF = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(_TERMS)))
_BM = " + ".join(f"ln(1.0::DOUBLE + (n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) * tf{i} * 2.2::DOUBLE / (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))" for i in range(len(_TERMS)))


@query("m16_lexical_search", f"""
WITH c AS (SELECT document_id, org_id, len({_TOK}) AS dl, {_TF} FROM b_documents),
st AS (SELECT org_id, count(*) AS n, avg(dl) AS avgdl, {_DF} FROM c GROUP BY 1),
s AS (SELECT document_id, c.org_id, round({_BM}, 6) AS score FROM c JOIN st ON c.org_id = st.org_id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY score DESC, document_id) AS rank FROM s WHERE score > 0) WHERE rank <= 5""")
def _(t):
    return se.lexical_search(t.documents, _TERMS, k=5)

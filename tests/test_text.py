"""Chunkers, extraction and search."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tenantlens.functions import text as tx
from tenantlens.functions.chunking import boundary_chunks, packed_chunks, sentence_groups
from tenantlens.operators import documents as doc, search as se


def squash(s):
    return "".join(s.split())


def test_short_and_empty_texts():
    assert list(packed_chunks("Short text.")) == ["Short text."]
    assert list(packed_chunks("")) == list(packed_chunks("   ")) == list(boundary_chunks(None)) == list(boundary_chunks("  ")) == []


def test_packed_sizes_and_order():
    paragraph = "A sentence of some length. " * 20
    chunks = list(packed_chunks("\n\n".join([paragraph] * 10), 500, 100))
    assert len(chunks) > 1
    assert all(len(c) <= 1100 for c in packed_chunks("A" * 5000, 1000, 100))


def test_packed_loses_no_text():
    text = "B" * 4321
    assert "".join(packed_chunks(text, 1000, 100)) == text
    assert squash(" ".join(sentence_groups("One two. " * 50 + "C" * 700, 100))) == squash("One two. " * 50 + "C" * 700)


@pytest.mark.parametrize("seed", range(8))
def test_boundary_chunks_cover_the_text(seed):
    rnd = random.Random(seed)
    text = "".join(rnd.choice(["word", " ", ". ", "\n", "\n\n", "x" * 40]) for _ in range(rnd.randint(1, 900)))
    at = 0
    for piece in boundary_chunks(text, 200, 30):
        assert len(piece) <= 200
        found = text.find(piece, max(0, at - 240))
        assert found >= 0 and squash(text[at:found]) == ""
        at = max(at, found + len(piece))
    assert squash(text[at:]) == ""


def test_boundary_chunks_end_with_large_overlap():
    assert len(list(boundary_chunks("y" * 50, 10, 10))) <= 50


def test_window_chunks_against_slicing(spark):
    texts = ["a" * 10, "".join(str(i % 10) for i in range(1500)), "".join(chr(0x1F600 + i % 50) for i in range(4001)), "q" * 1501]
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "document_id string, extracted_text string")
    got = {(r.document_id, r.chunk_index): r.chunk_text for r in doc.chunk_window(docs).collect()}
    want = {}
    for i, t in enumerate(texts):
        starts = [0] if len(t) <= 1500 else range(0, len(t), 1300)
        want.update({(str(i), n): t[s:s + 1500] for n, s in enumerate(starts)})
    assert got == want


def test_sequential_chunks_are_contiguous(spark):
    docs = spark.createDataFrame([("d", "Some text here. " * 300)], "document_id string, extracted_text string")
    idx = [r[0] for r in rows(doc.chunk(docs, method="boundary", size=300, overlap=50), "chunk_index")]
    assert idx == list(range(len(idx))) and len(idx) > 3


def test_paragraph_separator_is_literal(frame):
    docs = frame([("d", "x" * 60 + ".|." + "y" * 10 + ".|." + "z" * 60)], "document_id string, extracted_text string")
    assert rows(doc.chunk_paragraphs(docs, sep=".|."), "chunk_index", "char_count") == [(0, 60), (2, 60)]


def test_html_and_markdown(frame):
    df = frame([("<style>p{}</style><p>A &amp; B&nbsp;<b>c</b></p><script>x<y</script>", "# Head\n[link](http://x) **b** *i*")], "h string, m string")
    got = df.select(tx.html_to_text("h"), tx.strip_markdown("m")).first()
    assert got[0] == "A & B  c" and got[1] == "Head\nlink b i"


def test_sentiment(frame):
    df = frame([("Great, helpful and fast",), ("terrible outage, great",), ("nothing",), (None,)], "t string")
    assert [r[0] for r in df.select(tx.sentiment_score("t")).collect()] == [1.0, -0.333, 0.0, 0.0]


@pytest.mark.parametrize("path,kind", [("a/B.PDF", "contract"), ("x.docx", "report"), ("x.xlsx", "financial"), ("x.tar.txt", "note"), ("noext", "other"), ("x.bin", "other")])
def test_document_type(frame, path, kind):
    assert frame([(path,)], "p string").select(tx.document_type("p")).first()[0] == kind


def test_classification_keeps_given_type_below_threshold(frame):
    df = frame([("1", "o", "nda", "agreement uptime availability"), ("2", "o", "nda", "invoice billed due invoice"), ("3", "o", None, "nothing")],
               "document_id string, org_id string, document_type string, extracted_text string")
    got = rows(doc.classify(df), "document_id", "document_category", "document_type")
    assert got == [("1", "sla", "sla"), ("2", "invoice", "invoice"), ("3", "other", "other")]
    assert rows(doc.classify(df, min_score=0.9), "document_id", "document_type")[0] == ("1", "nda")


def test_extraction_failure_branch(frame):
    df = frame([("1", "o", "no readable wording"), ("2", "o", "Effective date: 2024-02-30. Total value: USD 12x.")], "document_id string, org_id string, extracted_text string")
    got = {r.document_id: r for r in doc.extract_contract_fields(df).collect()}
    assert got["1"].parse_error and got["1"].risk_flags == ["Parsing failed - manual review required"]
    assert not got["2"].parse_error and got["2"].start_date is None and float(got["2"].contract_value) == 12.0


def test_vector_search_against_brute_force(spark):
    rnd = random.Random(1)
    vectors = [(i, i % 3, [rnd.uniform(-1, 1) for _ in range(8)]) for i in range(60)]
    df = spark.createDataFrame(vectors, "chunk_id int, label int, embedding array<double>")
    query = [rnd.uniform(-1, 1) for _ in range(8)]

    def cos(v):
        dot = sum(a * b for a, b in zip(v, query))
        return dot / (sum(a * a for a in v) ** 0.5 * sum(a * a for a in query) ** 0.5)

    want = sorted((v for v in vectors if v[1] == 1), key=lambda v: -cos(v[2]))[:4]
    got = se.search(df, query, k=4, filters={"label": 1}).collect()
    assert [r.chunk_id for r in got] == [v[0] for v in want]


def test_pending_limit_takes_oldest(frame):
    items = frame([(i, 10 - i, "long enough text") for i in range(10)] + [(99, 0, "x")], "id int, created_at int, t string")
    done = frame([(9,)], "id int")
    assert rows(doc.pending(items, done, "id", text="t", min_chars=5, limit=2), "id") == [(7,), (8,)]


def test_chunks_leave_in_bounded_batches():
    """A batch of long documents goes out in parts of some OUT_CHARS, with the rows in order."""
    import pyarrow as pa

    from tenantlens.functions import chunking as ck

    texts = ["word " * 200_000, None, "", "short text", "line\n" * 300_000]
    batch = pa.RecordBatch.from_pydict({"document_id": [str(i) for i in range(5)], "extracted_text": texts})
    out = list(ck.chunk_batches("boundary", 800, 100, ["document_id"])(iter([batch])))
    assert max(sum(len(p) for p in b.column("piece").to_pylist()) for b in out) <= ck.OUT_CHARS + 800
    got = [tuple(r.values()) for b in out for r in b.to_pylist()]
    assert got == [(str(i), j, p) for i, t in enumerate(texts) for j, p in enumerate(ck.boundary_chunks(t))]


def test_label_folds_only_the_vocabulary(frame):
    """Words of no label are filtered out before the fold; labels, scores and ties stay."""
    df = frame([("The Agreement, a contract; uptime uptime filler words",), ("invoice nda offer",), ("nothing here",), (None,)], "t string")
    out = df.select(tx.best_label("t").alias("b"))
    assert "filter(regexp_extract_all" in out._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.b and (r.b.score, r.b.label)) for r in out.collect()] == [(0.5, "contract"), (0.5, "invoice"), (None, "contract"), None]

"""Manifest, chat formatting and ranked search against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenantlens.llm import chat, langid, linefreq, merkle, ranked

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, root string, path string, row string, n int, term int, item_id long"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "leaf", "root", "path", "row", 1, 2, 3) for r in rows], SCHEMA).repartition(parts)


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def slow_leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def slow_tree(level):
    """The root and, for each leaf, its siblings level by level as (left, right)."""
    at, found = list(range(len(level))), [[] for _ in level]
    while len(level) > 1:
        for leaf, pos in enumerate(at):
            run = level[pos // 16 * 16:pos // 16 * 16 + 16]
            found[leaf].append((run[:pos % 16], run[pos % 16 + 1:]))
        level, at = [H(*level[i:i + 16]) for i in range(0, len(level), 16)], [p // 16 for p in at]
    return level[0], found


def slow_manifest(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append((r[0] is not None, r[0] or 0, slow_leaf(r), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: slow_tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in sources}
    root, above = slow_tree([trees[s][0] for s in sources])
    out = []
    for s, up in zip(sources, above):
        for (_, _, leaf, r), steps in zip(sorted(by[s], key=lambda x: x[:3]), trees[s][1]):
            h, proof = leaf, []
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                low = None if r[4] is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4])
                h = slow_leaf((*r[:4], low))
            for left, right in steps + up:
                h, proof = H(*left, h, *right), proof + left + right
            out.append((r[0], leaf, trees[s][0], root, H(*proof), h, h == root))
    return sorted(out, key=str)


def manifest_rows(df):
    cols = [F.col(c) for c in merkle.FIELDS]
    low = [F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") if c == "text" else F.col(c) for c in merkle.FIELDS]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    leaves = df.withColumn("leaf", merkle.leaf(cols)).withColumn("tampered", F.when(hit, merkle.leaf(low)))
    out = merkle.manifest(leaves).withColumn("end", merkle.fold(F.coalesce("row.tampered", "row.leaf"), F.col("path")))
    got = out.select("row.doc_id", "row.leaf", "subroot", "root", merkle.proof_hash(F.col("path")), "end", F.col("end") == F.col("root")).collect()
    return sorted(map(tuple, got), key=str)


@pytest.mark.parametrize("sizes", [[1], [16], [17, 1, 0], [256, 2], [257, 16, 15], [700, 33, 1, 1, 1]])
def test_manifest(spark, sizes):
    rows = [(1000 * s + i, [None, "src", "Äsrc", "a", "src2"][s], "en", i, f"Text {i} É") for s, n in enumerate(sizes) for i in range(n)]
    assert manifest_rows(frame(spark, rows, 5)) == slow_manifest(rows)


def test_manifest_awkward_rows(spark):
    rows = ([(None, None, None, None, None), (1, "a", None, 0, ""), (1, "a", None, 0, ""), (1, "a", "en", 3, "ABC"), (None, "a", "en", 3, "ABC"),
             (2, "", "de", None, "Ünï 漢字"), (3, "a", "en", 9, "X" * 100_000), (-5, "b", "en", 1, "no capital")]
            + [(7, "hot", "en", 4, "Copy")] * 300 + [(i, f"s{i}", "en", 1, "T") for i in range(20)])
    assert manifest_rows(frame(spark, rows)) == slow_manifest(rows)
    assert merkle.manifest(frame(spark, [])).count() == 0


def test_manifest_finds_a_changed_row(spark):
    rows = [(i, "ab"[i % 2], "en", i, f"text {i}") for i in range(60)]
    got = merkle.manifest(frame(spark, rows).withColumn("leaf", merkle.leaf([F.col(c) for c in merkle.FIELDS])))
    wrong = merkle.leaf([F.col(f"row.{c}") if c != "text" else F.when(F.col("row.doc_id") == 31, "other").otherwise(F.col("row.text")) for c in merkle.FIELDS])
    assert [r[0] for r in got.where(merkle.fold(wrong, F.col("path")) != F.col("root")).select("row.doc_id").collect()] == [31]


TURNS = [
    (1, 0, "system", "Be brief."), (1, 1, "user", "Hi ### User: x"), (1, 2, "assistant", "a</turn>\nb"), (1, 3, "user", None), (1, 4, "assistant", ""),
    (2, 5, "assistant", "out of turn"), (2, 7, "user", "late"), (2, 6, "user", "#### \\a \\\\c </turn"), (2, None, "tool: x\n", "first ⟂ 漢"),
    (3, 1, "user", "same"), (3, 1, "user", "same"), (None, 0, "user", "no id"), (None, 1, "assistant", "</turn></turn>"), (4, 0, None, "no role"),
    (5, 0, "user", "x" * 5000), (5, 1, "assistant", "###" * 2000), (5, 2, "user", "tail"), (6, 0, "?", "odd role"),
]
TEMPLATE = chat.Template()


def turn_frame(spark, rows):
    return spark.createDataFrame([(*r, "s", "p", 1) for r in rows], "conv_id long, turn long, role string, text string, segments string, piece string, conv int").repartition(3)


@pytest.mark.parametrize("piece_chars", [100, 1 << 20])
def test_chat_round_trip(spark, piece_chars):
    made = chat.format_turns(turn_frame(spark, TURNS), piece_chars=piece_chars)
    got = {r.conv_id: r for r in chat.read_back(made).collect()}
    by = defaultdict(list)
    for c, t, role, text in TURNS:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(by)
    shown = defaultdict(str)
    for r in sorted(made.collect(), key=lambda r: r.piece):
        shown[r.conv_id] += "".join(s.text for s in r.segments)
    for c, turns in by.items():
        turns = [(role, text) for *_, role, text in sorted(turns)]
        loss = "".join(text for role, text in turns if role == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), H(*[f"{role}\n{text}\n" for role, text in turns]))
        assert (got[c].loss_chars, got[c].loss_sha256, got[c].formatted_chars) == (len(loss), H(loss), len(shown[c]))
        # in the formatted text, control strings stand at turns only
        assert shown[c].count("###") == shown[c].count("</turn>") == len(turns)
        assert got[c].valid == bool(re.fullmatch("(system,)?(user,assistant,)*(user,)?", "".join(role + "," for role, _ in turns)))
    assert chat.read_back(chat.format_turns(turn_frame(spark, []))).count() == 0


def test_escapes_are_reversible():
    r = random.Random(4)
    for _ in range(2000):
        text = "".join(r.choice(["#", "##", "###", "\\", "a", "c", "<", "</turn>", "\n", ": ", "é"]) for _ in range(r.randint(0, 9)))
        assert TEMPLATE.unquote(TEMPLATE.quote(text)) == TEMPLATE.unquote(TEMPLATE.quote(text, name=True)) == text
        assert not any(c in TEMPLATE.quote(text) for c in TEMPLATE.controls) and ": " not in TEMPLATE.quote(text, name=True)


def test_own_template(spark):
    own = chat.Template({"q": chat.Role("Q", after=("", "a")), "a": chat.Role("A", loss=True, after=("q",))}, opens="<|", names="|>", closes="<|end|>", controls=("<|",))
    made = chat.format_turns(turn_frame(spark, [(1, 0, "q", "why <| ?"), (1, 1, "a", "so")]), own)
    assert "".join(s.text for s in made.first().segments) == "<|Q|>why \\a| ?<|end|><|A|>so<|end|>"
    assert [s.text for s in made.first().segments if s.loss] == ["so"] and chat.read_back(made, own).first().valid


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def slow_terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def slow_search(docs, items, k):
    bags = [(i, Counter(slow_terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_all, l_all = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    terms = defaultdict(set)
    for i, t in items:
        terms[i] |= set(slow_terms(t))
    out = []
    for item, wanted in terms.items():
        scores = []
        for i, b in bags:
            m = 50 + 50 * sum(b.values()) * n_all // l_all
            s = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 20 * m)) for t in wanted if b[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def ranked_rows(spark, docs, items, k, **more):
    d = spark.createDataFrame([(i, t, 1, 2, "s") for i, t in docs], "doc_id long, text string, score int, item_id int, term string").repartition(3)
    q = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, doc_id int")
    return sorted(map(tuple, ranked.search(d, q, k=k, **more).collect()), key=str)


def test_ranked_search(spark):
    r = random.Random(5)
    words = ["".join(r.choice("abcdeé9") for _ in range(r.randint(1, 4))) for _ in range(120)]
    prose = lambda n: " ".join(r.choice(words[:1 + int(120 * r.random() ** 2)]) for _ in range(n))
    docs = [(i, prose(r.randint(1, 60))) for i in range(500)]
    docs += [(1000 + i, docs[3][1]) for i in range(150)]  # copies: ties to be cut by id
    docs += [(None, docs[3][1]), (None, None), (2000, None), (2001, ""), (2002, "-- ## _"), (2003, "Straße_漢字 ABC abc"), (2004, prose(20_000)), (5, docs[5][1])]
    items = [(1, docs[3][1]), (2, docs[7][1]), (3, "STRASSE straße 漢字"), (4, None), (5, "nowhere zzzzz"), (6, "abc"), (6, "Straße"), (None, docs[9][1]), (7, prose(40))]
    for k, more in ((10, {}), (50, {"shard_postings": 400}), (5, {"block_chars": 60, "shard_postings": 2000})):
        assert ranked_rows(spark, docs, items, k, **more) == slow_search(docs, items, k)
    assert ranked_rows(spark, [], items, 5) == [] and ranked_rows(spark, docs, [], 5) == []


def test_nra_stops_early():
    """A list that cannot change the result is not read to its end."""
    read = []

    class Watched(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, slice):
                read.append(key.stop)
            return super().__getitem__(key)
    n = 100_000
    strong = (np.arange(20), np.arange(2000, 1980, -1).astype(float))
    weak = (np.arange(n), np.sort(np.random.default_rng(1).integers(1, 6, n))[::-1].astype(float).view(Watched))
    near, scores = ranked.best([strong, weak], n, 5, 0)
    assert len(near) == 5 and set(near) == set(range(5)) and max(read) <= 128
    exact = np.zeros(n)
    np.add.at(exact, strong[0], strong[1])
    np.add.at(exact, weak[0], np.asarray(weak[1]))
    assert sorted(scores)[-5:] == sorted(exact.astype(int))[-5:]


def test_boilerplate_counts_documents(spark):
    """A line of a hundred equal documents of a host is shared by a hundred documents, by one text if copies do not count."""
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(i, text, "h") for i in range(100)] + [(200, text, "other"), (201, text.replace("word7", "x") + "\nown line\nown line", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.kept for r in linefreq.judge(docs).collect()}
    assert not any(got[i] for i in range(100)) and got[200] and got[201]
    assert all(r.kept for r in linefreq.judge(docs, copies=False).collect())
    twice = spark.createDataFrame([(1, "a line\n" * 30 + text, "h")], "doc_id long, text string, source string")
    hosted = twice.select(F.col("source").alias("host"), F.lit("k").alias("text_id"), "text")
    assert linefreq.boilerplate(hosted).count() == 0  # repeats inside one document count once


def test_language_sample_is_bounded_and_keeps_rare_languages(spark):
    r = random.Random(2)
    words = {"xx": "the and of ship water", "yy": "uber und der schiff wasser", "zz": "kala vene vesi meri laiva"}
    say = lambda lang, n=12: " ".join(r.choice(words[lang].split()) for _ in range(n))
    rows = [(i, say("xx" if i % 2 else "yy"), "xx" if i % 2 else "yy") for i in range(3000)] + [(None, say("xx") + f" {i}", "xx") for i in range(3000)]
    rows += [(10_000 + i, say("zz"), "zz") for i in range(20)] + [(20_000 + i, "the same copy of ship", "xx") for i in range(2000)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4), sample=200)
    assert model.languages == ["xx", "yy", "zz"]
    ask = [(1, "kala vesi meri vene laiva"), (2, "² ½ Ⅷ ①"), (3, "12 -- _"), (4, None), (5, "der schiff und wasser"), (6, "ʰ")]
    got = {x.doc_id: x for x in langid.predict(spark.createDataFrame(ask, "doc_id long, text string"), model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 5)] == ["zz", "und", "und", "und", "yy"] and got[6].lang_pred != "und" and got[2].score == 0

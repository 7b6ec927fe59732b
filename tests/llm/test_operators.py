"""Each operator against a brute-force version on a small table with every awkward row."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tenantlens.llm import common, components, decontaminate, doubling, induced, langid, linededup, linefreq, neardup, packing, repeats, simhash, suffixdedup, toxicity, warc

RNG = random.Random(7)
VOCABULARY = ["".join(RNG.choice("abcdefhjklmnop") for _ in range(RNG.randint(2, 9))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) + (".\n" if r.random() < .05 else "") for _ in range(n))


PASSAGE = prose(80, 1)
LONG = prose(6000, 2)
BASE = prose(300, 3)
DOCS = [
    (1, prose(120, 4) + " " + PASSAGE + " " + prose(90, 5), "en", "a"),
    (2, prose(60, 6) + " " + PASSAGE, "en", "a"),
    (3, BASE, "en", "a"), (4, BASE, "en", "b"), (5, BASE, None, "a"),                     # equal texts
    (6, BASE.replace(BASE.split()[150], "changed"), "en", "a"),                            # near copy
    (7, None, "en", None), (8, "", None, "a"), (9, " \n\t ", "en", None), (10, "...!? 123", "en", "a"),
    (11, LONG, "en", "a"), (12, LONG[:20000] + " other end", "en", "b"),
    (13, "Übung macht den Meister – ñandú 漢字 " * 30, "de", "b"),
    (14, "same words again " * 90, "en", "b"), (15, "x" * 3000, "en", "b"),                # periodic
    (None, prose(50, 8) + " " + PASSAGE, None, None), (None, None, None, None),
    (16, "Hello there\nHello  THERE\nunique line here", "en", "a"), (16, "Hello there\nHello  THERE\nunique line here", "en", "a"),  # a row twice
    (17, "IDIOT. You are a clown, a moron!", "en", "a"), (18, "short", "en", "a"),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, line int, key string, id int, row string, n_words string, items string, gone int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, lang, s, None if t is None else len(t), "s", "k", 1, "key", 2, "r", "n", "i", 3) for i, t, lang, s in DOCS]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


def by_text(rows, *cols):
    """Results keyed by nothing: sorted tuples, as ids repeat."""
    return sorted((tuple(r[c] for c in cols) for r in rows), key=str)


def union(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    r = random.Random(3)
    links = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(30)] + [(5, 5), (None, 3)]
    got = components.components(spark.createDataFrame(links, "a int, b int")).collect()
    want = union([x for x in links if None not in x], range(500))
    assert {x.node: x.root for x in got} == {n: want[n] for n in {n for a, b in links if None not in (a, b) and a != b for n in (a, b)}}
    assert components.components(spark.createDataFrame([], "a int, b int")).count() == 0


def slow_fingerprint(text, words=3):
    import xxhash
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in low.replace("\n", " ").replace("\t", " ").split(" ") if x]
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + words]).encode(), 42) for i in range(max(1, len(w) - words + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash(docs, none):
    got = simhash.near_duplicates(docs, tree_nodes=4).collect()
    prints = [(i, slow_fingerprint(t)) for i, t, *_ in DOCS]
    comp = union([(a, b) for a in range(len(prints)) for b in range(a) if (prints[a][1] ^ prints[b][1]).bit_count() <= 3], range(len(prints)))
    smallest = defaultdict(list)
    for k, (i, _) in enumerate(prints):
        if i is not None:
            smallest[comp[k]].append(i)
    want = [(i, f"{fp:016x}", min(smallest[comp[k]], default=None)) for k, (i, fp) in enumerate(prints)]
    assert by_text(got, "doc_id", "fingerprint", "component_id") == sorted(want, key=str)
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and {3, 7} <= {r.doc_id for r in kept.collect()} and not {4, 5, 8} & {r.doc_id for r in kept.collect()}


def test_bk_tree_finds_all_within_radius():
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 63, 40, dtype=np.uint64)
    points = np.unique(np.concatenate([base ^ (np.uint64(1) << r.integers(0, 64, 40, dtype=np.uint64)) for _ in range(8)]))
    got = {(n, int(q)) for n, near in simhash.Tree(points).within(points, 3) for q in near}
    assert got == {(i, j) for i in range(len(points)) for j in range(len(points)) if int(points[i] ^ points[j]).bit_count() <= 3}


def word_shingles(t, size=5):
    w = (t or "").encode().lower().split()
    return {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def edited(text, rate, r):
    """The text with a share of its words changed, one in each of as many equal stretches."""
    w = text.split()
    k = max(1, round(rate * len(w)))
    for i in range(k):
        w[r.randrange(i * len(w) // k, (i + 1) * len(w) // k)] = f"new{r.randrange(1 << 30)}"
    return " ".join(w)


@pytest.mark.parametrize("limits", [{}, {"shard": 2}])
def test_near_duplicates_are_those_of_exact_jaccard(spark, limits):
    r = random.Random(11)
    texts = []
    for k in range(120):  # pairs from well below to well above 0.8
        base = prose(r.randint(150, 500), 5000 + k)
        texts += [base, edited(base, (.0035, .009, .015, .021, .024, .03, .045, .08)[k % 8], r)]
    hub = prose(400, 4999)
    texts += [edited(hub, .012, r) for _ in range(40)] + ["few words", "Few  WORDS", "few other words", "", None, " \n"]
    sets = [word_shingles(t) for t in texts]

    def alike(a, b):
        both = len(a & b)
        return both >= .8 * (len(a) + len(b) - both)
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if alike(sets[a], sets[b])]
    at = Counter(int(100 * len(sets[a] & sets[b]) / len(sets[a] | sets[b])) // 5 * 5 if sets[a] else 100 for a, b in pairs)
    assert all(at[x] >= 10 for x in (80, 85, 90, 95))
    root = union(pairs, range(len(texts)))
    kept = neardup.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3), **limits)
    assert sorted(x.doc_id for x in kept.collect()) == sorted(k for k in root if root[k] == k)


def test_one_row_of_each_group_stays(spark):
    a, b = prose(200, 91), prose(200, 92)
    near = edited(a, .005, random.Random(1))
    rows = [(1, a, "x"), (1, a, "y"), (1, b, "x"), (2, near, "x"), (None, b, "x"), (None, near, "x"), (None, prose(90, 93), "x"), (None, prose(90, 93), "x"), (3, None, "x"), (3, "", "y")]
    kept = neardup.keep_one(spark.createDataFrame(rows, "doc_id int, text string, source string")).collect()
    assert len(kept) == 4 and {(x.doc_id, x.text or None) for x in kept} == {(1, a), (1, b), (None, prose(90, 93)), (3, None)}


def removed(sequences, size):
    """Brute force: covered units of each sequence."""
    seen = Counter(tuple(s[i:i + size]) for s in sequences for i in range(len(s) - size + 1))
    out = []
    for s in sequences:
        gone = [False] * len(s)
        for i in range(len(s) - size + 1):
            if seen[tuple(s[i:i + size])] > 1:
                gone[i:i + size] = [True] * size
        out.append(gone)
    return out


@pytest.mark.parametrize("size", [35, 8, 2, 1])
def test_doubling(docs, size):
    got = doubling.remove_repeats(docs, size=size).collect()
    words = [(t or "").split() for _, t, *_ in DOCS]
    want = [(i, len(w), sum(g), " ".join(x for x, y in zip(w, g) if not y)) for (i, *_), w, g in zip(DOCS, words, removed(words, size))]
    assert by_text(got, "doc_id", "n_words", "n_removed", "kept") == sorted(want, key=str)


def test_levels_double():
    assert doubling.levels(35) == [9, 18, 35] and doubling.levels(1) == [1] and doubling.levels(8) == [2, 4, 8]


@pytest.mark.parametrize("limits", [{}, {"shard_bytes": 2000, "memory_items": 500, "base_items": 50}])
def test_suffix_induction(docs, limits):
    got = suffixdedup.remove_repeats(docs, **limits).collect()
    texts = [(t or "").encode() for _, t, *_ in DOCS]
    want = []
    for (i, *_), b, g in zip(DOCS, texts, removed(texts, 200)):
        spans = sum(1 for k, x in enumerate(g) if x and not (k and g[k - 1]))
        want.append((i, len(b), sum(g), spans, hashlib.sha256(bytes(x for x, y in zip(b, g) if not y)).hexdigest()))
    have = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got]
    assert sorted(have, key=str) == sorted(want, key=str)


def test_repeats_of_nothing(none):
    assert doubling.remove_repeats(none).count() == 0 and suffixdedup.remove_repeats(none).count() == 0


def test_induced_order_in_memory_and_in_files():
    r = np.random.default_rng(5)
    for trial in range(120):
        t = r.integers(1, int(r.integers(2, 6)) + 1, int(r.integers(1, 90)))
        if trial % 3 == 0:
            t = np.concatenate([t, t, t[:len(t) // 2]])
        t = np.append(t, 0).astype("<u2")
        for limits in ({}, {"memory_items": 5, "base_items": 2}):
            out = []
            induced.suffixes(t, len(t), lambda p, c: out.append((p, c)), **limits)
            order = np.concatenate([p for p, _ in out]).tolist()
            common = np.concatenate([c for _, c in out]).tolist()
            want = sorted(range(len(t) - 1), key=lambda i: t[i:].tolist(), reverse=True)
            assert order == want
            for a, b, n in zip(want, want[1:], common[1:]):
                x, y = t[a:].tolist(), t[b:].tolist()
                assert n == next(k for k in range(len(t) + 1) if k >= min(len(x), len(y)) or x[k] != y[k])


def test_line_dedup(docs, none):
    lines = defaultdict(list)
    for i, t, *_ in DOCS:
        for n, x in enumerate((t or "").split("\n")):
            if linededup.normalise(x):
                lines[linededup.normalise(x)].append((linededup.NO_ID if i is None else i, n))
    names, sets = list(lines), [linededup.shingles(x) for x in lines]
    comp = union([(a, b) for a in range(len(names)) for b in range(a) if linededup.jaccard_at_least(sets[a], sets[b], .8)], range(len(names)))
    owner = {}
    for k, x in enumerate(names):
        owner[comp[k]] = min(owner.get(comp[k], (1 << 64, 0)), min(lines[x]))
    keep = {p for p in owner.values()}
    got = {(r.id, r.line_no) for r in linededup.judged_lines(docs, shard=2).where("kept").collect()}
    assert got == keep
    out = linededup.dedup_lines(docs)
    assert out.columns == docs.columns
    texts = {r.doc_id: r for r in out.where("doc_id is not null").collect()}
    assert texts[16].text == "Hello there\nunique line here" and texts[16].n_chars == len(texts[16].text) and texts[16].key == "key"
    assert texts[3].text == BASE and not {4, 5} & set(texts) and texts[7].text is None and texts[9].text == " \n\t "
    assert linededup.dedup_lines(none).count() == 0


def test_lines_of_a_bucket_meet_by_hashes(monkeypatch):
    r = random.Random(5)
    base = ["".join(r.choice("abcdé漢 ") for _ in range(r.choice([3, 8, 60]))) for _ in range(6)]
    lines = sorted({"".join(c if r.random() > .02 else "x" for c in r.choice(base)) + r.choice(["", "", "\0"]) for _ in range(60)})
    sets = [linededup.shingles(x) for x in lines]
    want = union([(a, b) for a in range(len(lines)) for b in range(a) if linededup.jaccard_at_least(sets[a], sets[b], .8)], range(len(lines)))
    monkeypatch.setattr(linededup, "shingles", None)  # sets of strings took most of the time
    frame = pd.DataFrame({"members": 1, "one": 0, "two": 0, "shard": 0, "key": range(len(lines)), "line": lines})
    links = [tuple(x) for out in linededup._verify(.8)(iter([frame])) for x in out.itertuples(index=False)]
    assert union(links, range(len(lines))) == want and len(set(want.values())) < len(lines)


def test_bands_find_similar_lines():
    r = random.Random(2)
    pairs = missed = 0
    for k in range(150):
        a = prose(60, 1000 + k).replace("\n", " ")
        b = a.split()
        b[r.randrange(len(b))] = "zzzz"
        b = " ".join(b)
        if linededup.jaccard_at_least(linededup.shingles(a), linededup.shingles(b), .85):
            pairs += 1
            x, y = linededup.band_keys(linededup.signatures([a, b], 40), 10, 4)
            missed += not (x == y).any()
    assert pairs > 60 and missed <= 1


def test_similar_pairs_are_exact():
    r = random.Random(1)
    base = prose(50, 77).replace("\n", " ").split()
    lines = list({" ".join(w if r.random() > rate else r.choice(VOCABULARY) for w in base) for rate in (.01, .05, .3) for _ in range(12)})
    sets = [linededup.shingles(x) for x in lines]
    alike = linededup._alike(sets, .8)
    want = {(i, j) for i in range(len(sets)) for j in range(i) if linededup.jaccard_at_least(sets[i], sets[j], .8)}
    for i in range(len(sets)):
        for j in range(i):
            assert alike[i, j] == ((i, j) in want)
    pairs = [(i, j) for i in range(len(lines)) for j in range(i)]
    near = linededup._close([lines[i] for i, _ in pairs], [lines[j] for _, j in pairs], .8)
    assert {p for p, yes in zip(pairs, near) if yes} == want
    for n in (2, 3, 7, len(sets)):
        every = np.arange(n)
        assert union(linededup._links(sets[:n], every, every, .8), every) == union([(i, j) for i, j in want if i < n], every)
        one, two = every[::2], every[1::2]
        got, across = union(linededup._links(sets[:n], one, two, .8), every), union([(i, j) for i, j in want if i < n and (i - j) % 2], every)
        assert all(got[i] == got[j] for i, j in want if i < n and (i - j) % 2) and set(got.values()) >= set(across.values())


def test_line_dedup_keeps_any_kind_of_id(spark):
    rows = [("b", "one line of text here\nsecond line of text"), ("a", "one line of text here"), (None, "second line of text"), ("c", "x\n" * 20_000 + "own ending")]
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert {(r.doc_id, r.text) for r in got} == {("a", "one line of text here"), ("b", "second line of text"), ("c", "x\nown ending")}


def test_packing(docs, none):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    got = packing.pack_documents(docs, packing.default_tokenizer()).collect()
    want = []
    for i, t, *_ in DOCS:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want += [(i, k, a, len(ids[a:a + 4096]), zlib.crc32(ids[a:a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
    assert by_text(got, "doc_id", "piece", "start", "length", "ids_crc32") == sorted(want, key=str)
    check_places(got, 4096)
    assert packing.pack_documents(none, packing.default_tokenizer()).count() == 0


def check_places(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_in_rounds_stays_near_the_bound(spark):
    r = random.Random(1)
    sizes = [min(4096, int(r.lognormvariate(6, 1)) + 1) for _ in range(3000)]
    items = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "i int, length long")
    got = packing.pack(items, group_tokens=200_000).collect()
    assert sorted(x.i for x in got) == list(range(3000))
    assert check_places(got, 4096) <= -(-sum(sizes) // 4096) * 1.02 + 1


def test_packing_ends_when_no_sequence_can_be_filled(spark):
    for sizes, bins in (([2500] * 4000, 4000), ([2500] * 3000 + [1500] * 1000 + [90] * 500, 3000)):
        items = spark.createDataFrame(list(enumerate(sizes)), "i int, length long")
        got = packing.pack(items, group_tokens=300_000).collect()
        assert sorted((x.i, x.length) for x in got) == list(enumerate(sizes))
        assert bins <= check_places(got, 4096) <= bins * 1.02


def test_packed_ids(docs):
    seqs = packing.sequences(docs.where("doc_id in (16, 17, 18)"), packing.default_tokenizer()).collect()
    assert len(seqs) == 1 and seqs[0].ids.count(1) == 4 and sorted(seqs[0].doc_ids) == ["16", "16", "17", "18"]


def test_word_ids_match_the_tokenizer():
    from tokenizers import Tokenizer
    tokenizer, own = Tokenizer.from_file(packing.default_tokenizer()), packing.Encoder(packing.default_tokenizer())
    for text in ["It's we'll DON'T a.b, c,, 1234 naïve Ångström ǅ İstanbul ΑΣ é ́x", "a b c　d\x1ce\x85f", "<|endoftext|> x<|startoftext|>y", "漢字 ñ 🙂 --- ## x_y", "가 · A.", "Hello, World. foo."]:
        assert own.encode(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def brute_contamination(docs, items, size=13):
    def words(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in low).split(" ") if t else []
    out = []
    wanted = [(i, [x for x in words(t) if x]) for i, t in items]
    for d, t in docs:
        w = [x for x in words(t) if x]
        hit, who = set(), set()
        for i, b in wanted:
            n = min(size, len(b))
            wins = {tuple(b[k:k + n]) for k in range(len(b) - n + 1)} if n else set()
            for k in range(len(w) - n + 1):
                if n and tuple(w[k:k + n]) in wins:
                    hit |= set(range(k, k + n))
                    who.add(i)
        out.append((d, len(w), len(hit), sorted(map(str, who - {None})), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def test_decontamination(spark, docs, none):
    items = [(1, " ".join(PASSAGE.split()[10:40])), (2, "Unique, LINE here!"), (3, None), (4, "..."), (10, " ".join(PASSAGE.split()[20:33])), (5, "x-x words nowhere"), (1, "hello"), (6, "漢字 Übung macht")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.scan(docs, bench).collect()
    want = brute_contamination([(i, t) for i, t, *_ in DOCS], items)
    have = [(r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in got]
    assert sorted(have, key=str) == sorted(want, key=str)
    assert decontaminate.scan(none, bench).count() == 0
    assert decontaminate.scan(docs, bench.limit(0)).where("contaminated or n_hit > 0").count() == 0


def test_decontamination_in_blocks(spark, docs, monkeypatch):
    bench = spark.createDataFrame([(1, PASSAGE), (2, BASE)], "item_id long, text string")
    whole = by_text(decontaminate.scan(docs, bench).collect(), "doc_id", "n_hit", "contaminated")
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 3000)
    assert by_text(decontaminate.scan(docs, bench).collect(), "doc_id", "n_hit", "contaminated") == whole


def test_line_frequency(spark, none):
    common = "Read   more HERE 12"
    rows = [(k, f"{prose(60, 50 + k).replace(chr(10), ' ')}\n{common}", "h") for k in range(6)]
    rows += [(10, f"{common}\nread more here 7\nx", "h"), (11, f"{prose(55, 90)}\n{common}", "other"), (12, None, "h"), (13, "", None), (14, prose(70, 91), None), (None, prose(70, 92), "h"), (0, rows[0][1], "h")]
    frame = spark.createDataFrame([r + ("x", 1, 2) for r in rows], "doc_id long, text string, source string, gone string, host int, line int")
    got = linefreq.judge(frame, max_documents=5).collect()
    assert len(got) == len(rows)
    at = {r.doc_id: r for r in got}
    assert at[1].kept and at[1].n_words_left == at[1].n_words - 4 and at[1].gone == "x"
    assert not at[10].kept and at[10].n_words_left == 1 and at[11].n_words_left == at[11].n_words
    assert at[12].n_words == 0 and at[12].base_failed and not at[13].kept and at[14].kept and at[None].kept
    out = linefreq.strip_boilerplate(frame, max_documents=5)
    texts = {r.doc_id: r.text for r in out.collect()}
    assert out.columns == frame.columns and "more" not in texts[1].lower().split() and texts[11] == rows[7][1] and 10 not in texts
    assert linefreq.judge(none).count() == 0


def test_base_metrics(spark):
    cases = {"a b c a b c": 6, "a a a a": 4, "a b c d": 0, "x y z q x y z w x y": 6, "": 0, "a b": 0}
    got = linefreq.base_metrics(spark.createDataFrame([(t,) for t in cases], "text string")).collect()
    assert {r.text: r.n_repeat_words for r in got} == cases
    r = linefreq.base_metrics(spark.createDataFrame([("añ #1\n\n#x\n#x\n #x",)], "text string")).first()
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (5, 10, 4, 1)


def test_language(docs, none, spark):
    more = spark.range(100, 160).select(F.col("id").alias("doc_id"), F.lit(next(d[1] for d in DOCS if d[2] == "de")).alias("text"), F.lit("de").alias("lang"))
    model = langid.train(docs.select("doc_id", "text", "lang").unionByName(more), sample=1000)
    got = langid.predict(docs, model).collect()
    assert len(got) == len(DOCS) and all(0 <= r.score <= 1 for r in got)
    guesses = {r.doc_id: r.lang_pred for r in got if r.doc_id}
    assert guesses[13] == "de" and guesses[3] == "en" and {guesses[k] for k in (7, 8, 9, 10)} == {"und"}
    assert langid.train(none) is None and {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}
    assert langid.predict(none, model).count() == 0


def test_ftrl_shrinks_idle_weights_to_zero():
    f = langid.Ftrl(2)
    for k in range(200):
        f.learn(np.array([1, 2 + k % 50, langid.BUCKETS]), np.array([1.0, .01, 1.0]), 1)
        f.learn(np.array([60, 2 + k % 50, langid.BUCKETS]), np.array([1.0, .01, 1.0]), 0)
    w = f.weights(slice(None))
    assert w[1, 1] > 1 > 0 > w[1, 0] and w[60, 0] > 1 and not w[2:52].any()


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.op3_ftrl_language(spark, "/root/testdata/sf0.01").where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97


def slow_clauses(letters):
    """(insult part, threat part) of each clause that has one, by searching the string of symbols instead of machines."""
    inside = lambda spans, i: any(m.start() < i < m.end() for m in spans)
    reports = list(re.finditer(r'(?<!S)R[^".\n]*(?:\.|"[^"\n]*"?)?', letters))
    negations = list(re.finditer(r"N[^U,.\n]*", letters))
    for m in re.finditer(r"[^,.\n]+", letters):
        at = [i for i in range(*m.span()) if letters[i] != '"']
        q = "".join(letters[i] for i in at)
        code = [inside(reports, i) + 2 * inside(negations, i) for i in at]
        insult = min((code[j] + 1 for j, x in enumerate(q) if x == "I"), default=0)
        threat = 0
        for j in (j for j, x in enumerate(q) if x == "T"):
            before, after = q[:j], q[j + 1:]
            order = re.match("([^YC]{0,2})[YC]", after)
            if re.search("[SM].*C", before) or (re.search("[SM]", before) and re.match("[^YPCT]{0,2}[YPC]", after)) or (
                    j == 0 and order and not re.search("[SM].*T", order[1])):
                threat = code[j] + 1
                break
        if insult or threat:
            yield insult + (4 if insult and set("YPC") & set(q) else 0), threat


def test_grammar_path_by_path():
    letters, fst, rand = 'OITYPCSMNUR,".\n', toxicity.grammar(), random.Random(5)
    for _ in range(6000):
        text = "".join(rand.choice(letters + "OITYSR") for _ in range(rand.randrange(1, 14))) + "\n"
        state, got = 0, []
        for a in map(letters.index, text):
            if fst.emit[state, a]:
                insult, threat = divmod(int(fst.emit[state, a]), 5)
                got.append((insult, threat))
                assert fst.weight[state, a] == max(toxicity.DISCOUNT[(x - 1) % 4] for x in (insult, threat) if x)
            state = fst.step[state, a]
        assert got == list(slow_clauses(text)), text


@pytest.mark.parametrize("toxic, text", [
    (0, "He said you are an idiot."), (0, "He said: you are an idiot."), (0, 'He said, "you are an idiot."'), (1, "You idiot did not call."),
    (1, "You idiot"), (0, "Beat the eggs, then burn the sugar."), (0, "He won the match and beat them."), (1, "I will kill you"),
    (1, "Kill yourself"), (1, "Ich werde dich töten"), (0, "you are not an idiot"), (1, "You are not smart but an idiot"), (1, "No, you idiot!"),
    (1, "I said you are an idiot."), (0, "I will beat the eggs for you"), (0, 'He said, "you moron. You idiot." fine'),
    (1, 'He said "hello". You idiot.'), (0, "Nobody will kill you")])
def test_sentences_with_the_prior_alone(toxic, text):
    model = toxicity.Model()
    z = toxicity.clause_features(text, toxicity.Lexicon(model)) @ model.weights + model.bias
    assert (1 / (1 + np.exp(-z)) >= toxicity.THRESHOLD) == bool(toxic)


def test_equal_texts_with_two_labels(spark):
    rows = [(i, f"text {i // 4} word{i // 4} calm") for i in range(400)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(400)], "doc_id long, quality int, toxic int")
    fits = [toxicity.train(spark.createDataFrame(rows, "doc_id long, text string").repartition(n), labels) for n in (1, 5)]
    assert fits[0].stems == fits[1].stems and np.allclose(fits[0].weights, fits[1].weights)


def test_clauses_not_words_are_scored(spark, docs, none):
    texts = ["you are an idiot", "nobody said you are an idiot", "you are not an idiot", "a calm text", None, "", "you idiot. you moron. you scum, you clown"]
    got = toxicity.score(spark.createDataFrame([(t,) for t in texts], "text string"), toxicity.Model()).collect()
    score = [r.score for r in got]
    assert score[6] > score[0] > score[2] and score[0] > score[1] > score[3] - 1e-9 and score[4] == score[5]
    assert toxicity.score(none, toxicity.Model()).count() == 0 and toxicity.score(docs, toxicity.Model()).count() == len(DOCS)


def test_toxicity_without_labels(docs, none, spark):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.train(docs, empty).stems == {} and toxicity.train(none, empty).stems == {}
    odd = spark.createDataFrame([(None, 1, 1), (1, 0, None), (3, 1, 0), (17, 1, 1), (17, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.train(docs, odd).weights is not None


def test_toxicity_held_out(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic")
    got = toxicity.op7_clause_toxicity(spark, "/root/testdata/sf0.1").where("held_out").join(labels, "doc_id").collect()
    hit = sum(r.toxic and r.predicted for r in got)
    assert hit / sum(r.toxic for r in got) > 0.8 and hit / sum(r.predicted for r in got) > 0.85


def test_warc_round_trip(spark, tmp_path):
    big = "<html>" + "ä\r\n\r\nWARC/1.1\r\n" * 100
    rows = [(1, "http://www.B.example.com:80/x?q=1#top", big), (2, None, big), (3, "https://a.example.com", big), (4, "http://a.example.com/", None), (5, "u", "small"), (6, "u", "small"),
            (None, "http://z.org/\r\nX", big), (3, "https://a.example.com", big), (7, "http://a.example.com/", "")]
    path = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), path)
    got = warc.merge_runs(warc.capture_runs(spark, path), merge_rows=2).orderBy("position").collect()
    assert [r.position for r in got] == list(range(len(rows)))
    keys = [(r.url_key, r.captured_at, -1 if r.page_id is None else r.page_id) for r in got]
    assert keys == sorted(keys) and "com,example,b)/x?q=1" in {k for k, *_ in keys}
    for r in got:
        html = next((h for i, _, h in rows if i == r.page_id), "") or ""
        assert (r.payload_bytes, r.payload_digest) == (len(html.encode()), hashlib.sha1(html.encode()).hexdigest())
        again = r.page_id in (1, 2, None)
        assert (r.record_type, r.refers_to) == (("revisit", 3) if again else ("response", None))
    empty = str(tmp_path / "e")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), empty)
    assert warc.merge_runs(warc.capture_runs(spark, empty)).count() == 0


def test_loser_tree():
    r = random.Random(4)
    for k in range(9):
        runs = [sorted(r.randint(0, 20) for _ in range(r.randint(0, 12))) for _ in range(k)]
        got = [(runs[a][i], a, i) for a, i in warc.LoserTree(runs)]
        assert got == sorted((v, a, i) for a, run in enumerate(runs) for i, v in enumerate(run))


def test_same_windows_meet_in_same_contexts():
    from tenantlens.llm.contexts import Hashes, contexts
    r = np.random.default_rng(3)
    for size, gram, symbols in ((12, 4, 3), (35, 9, 50), (5, 5, 2), (7, 1, 2)):
        parts = [r.integers(1, symbols + 1, int(n)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for n in r.integers(0, 150, 12)]
        bounds = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        which, anchor, content, start, windows = contexts(Hashes(np.concatenate(parts)), size, gram, bounds)
        seen, at = defaultdict(set), Counter()
        for k, a, s, w in zip(which, anchor, start, windows):
            for i in range(s, s + w):
                at[k, i] += 1
                seen[parts[k][i:i + size].tobytes()].add(a)
        assert set(at) == {(k, i) for k, p in enumerate(parts) for i in range(len(p) - size + 1)} and set(at.values()) <= {1}
        assert all(len(x) == 1 for x in seen.values())


def test_pipeline_stages_keep_the_columns(spark, docs, none, tmp_path):
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for frame in (docs, none):
        rows, kept = frame, None
        for name, step in corpus_pipeline.STAGES[:-1]:
            out = common.stage(step(spark, rows, str(tmp_path)))
            assert out.dtypes == frame.dtypes, name
            kept = out.count()
            rows = out
        packed = corpus_pipeline.STAGES[-1][1](spark, rows, str(tmp_path)).collect()
        assert len({r.doc_id for r in packed}) == rows.select("doc_id").distinct().count()
        if frame is docs:
            ids = {r.doc_id for r in rows.collect()}
            assert not {1, 17} & ids and {3, 11, 13, 14} <= ids and not {4, 5} & ids and kept > 5


def test_near_duplicates_meet_in_bk_trees(spark, monkeypatch):
    """Texts that no MinHash band brings together are met by their SimHash and decided by exact Jaccard."""
    base = [f"w{i}" for i in range(400)]
    texts = {1: base, 2: base[:399] + ["other"], 3: [f"x{i}" for i in range(400)], 4: base[:300] + [f"y{i}" for i in range(100)]}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()] + [(5, None), (6, "")], "doc_id long, text string")
    one, two = (neardup.simhash.fingerprint(" ".join(texts[i]), 5) for i in (1, 2))
    assert (one ^ two).bit_count() <= 3
    monkeypatch.setattr(neardup, "with_simhash", lambda nodes, own=neardup.with_simhash: own(nodes.withColumn("buckets", F.array().cast("array<long>"))))
    assert sorted(r.doc_id for r in neardup.keep_one(docs).collect()) == [1, 3, 4, 5]

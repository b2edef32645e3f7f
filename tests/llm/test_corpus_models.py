"""Neighbours, archives, language-model scores, token counts, classifiers: against plain versions, round trips, held-out accuracy."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_corpus_native import odd_docs

# components


def test_components(spark):
    from tarnwick.llm.graph import components

    rng = np.random.default_rng(3)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 300)] + [tuple(map(int, rng.integers(2000, 2600, 2))) for _ in range(500)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = [(r.node, r.root) for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()]
    assert len(got) == len(set(n for n, _ in got))
    assert dict(got) == {n: find(n) for n in parent if find(n) != n}


# neighbours


def brute_nearest(rows, every=50, k=5):
    rows = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in rows:
        if q % every == 0:
            s = sorted((-(v @ w) / math.sqrt(v @ v) / math.sqrt(w @ w), i) for i, w in rows if i != q)[:k]
            out[q] = [(i, -x) for x, i in s]
    return out


def test_neighbours_recall_and_scores(spark):
    from tarnwick.llm import neighbours

    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = brute_nearest([(r.vec_id, r.embedding) for r in df.collect()])
    got = defaultdict(dict)
    for r in neighbours.nearest(df).collect():
        got[r.query_id][r.vec_id] = (r["rank"], r.score)
    found = sum(i in got[q] for q, xs in want.items() for i, _ in xs)
    assert found >= 0.9 * sum(map(len, want.values()))
    for q, xs in want.items():
        assert sorted(n for n, _ in got[q].values()) == [1, 2, 3, 4, 5]
        for i, s in xs:
            assert i not in got[q] or abs(got[q][i][1] - s) < 1e-12


def test_neighbours_odd_rows(spark):
    from tarnwick.llm import neighbours

    v = [1.0, 2.0, 3.0]
    rows = [(0, v), (0, v), (50, None), (100, [0.0, 0.0, 0.0]), (150, [1.0, None, 2.0]), (200, [float("nan"), 1.0, 1.0]), (250, [1.0, 2.0]), (None, v), (300, [3.0, 1.0, 0.0])]
    rows += [(i, v) for i in range(1, 40)] + [(i, [float(i), 1.0, -1.0]) for i in range(41, 45)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = brute_nearest([r for r in rows if r[1] is None or len(r[1]) == 3])
    got = defaultdict(list)
    for r in sorted(neighbours.nearest(df).collect(), key=lambda r: r["rank"]):
        got[r.query_id].append(r.vec_id)
    assert got[0] == [1, 2, 3, 4, 5]
    assert {q: [i for i, _ in xs] for q, xs in want.items() if q} == {q: xs for q, xs in got.items() if q}
    assert neighbours.nearest(df.limit(0)).count() == 0
    assert [r.vec_id for r in neighbours.nearest(df.filter("vec_id in (0, 41)")).collect()] == [41]


def test_neighbours_many_copies_and_dealt_ranges(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tarnwick.llm import neighbours

    monkeypatch.setattr(neighbours, "BLOCK", 64)
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    one = df.filter("vec_id = 3").select("embedding").first()[0]
    df = df.withColumn("embedding", F.when(F.col("vec_id") % 3 == 0, F.lit(one)).otherwise(F.col("embedding")))
    got = {(r.query_id, r["rank"]): r.vec_id for r in neighbours.nearest(df).collect()}
    assert [got[150, i] for i in range(1, 6)] == [0, 3, 6, 9, 12]
    assert [got[0, i] for i in range(1, 6)] == [3, 6, 9, 12, 15]


def test_hilbert_is_a_curve():
    from tarnwick.llm.neighbours import hilbert

    for p, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(2**bits)] * p), -1).reshape(-1, p)
        key = hilbert(cells, bits)
        assert sorted(key) == list(range(2 ** (bits * p)))
        walk = cells[np.argsort(key)]
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


# archives


def plain_archive(pages):
    best = {}
    for i, html in pages:
        b = (html or "").encode()
        if len(b) >= 1000 and i is not None:
            best[b] = max(i, best.get(b, i))
    out = []
    for i, html in pages:
        b = (html or "").encode()
        w = best.get(b) if len(b) >= 1000 else None
        again = w is not None and w != i
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", w if again else None))
    return Counter(out)


@pytest.mark.parametrize("limit", [200_000, -1])
def test_archives(spark, sf, limit, monkeypatch):
    from tarnwick.llm import archives

    monkeypatch.setattr(archives, "BROADCAST_ROWS", limit)
    big = "é\r\n\r\nWARC/1.0\n" * 200
    odd = [(9000, None, None), (9001, "http://a b/\n", ""), (9002, "http://x/", big), (9003, "http://y/", big), (9003, "http://y/", big), (None, "http://z/", big), (9004, "u", "small"), (9005, "u", "small"), (9006, "u", "x" * 1000), (9007, "ü", "x" * 1000)]
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").unionByName(spark.createDataFrame(odd, "page_id long, url string, html string"))
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in archives.archived(pages.repartition(3)).collect())
    assert got == plain_archive([(r.page_id, r.html) for r in pages.collect()])
    assert archives.archived(pages.limit(0)).count() == 0


def test_arc_versions_and_lengths():
    import gzip

    from tarnwick.llm import archives

    for version in (1, 2):
        text = archives.arc_version_block(version, "n.arc") + "\n" + archives.arc_record(version, 5, "http://a/b c", "<p>\n\nx 200 7</p>") + "\n" + archives.arc_record(version, None, None, None) + "\n"
        for content in (text.encode(), gzip.compress(text.encode()[:100]) + gzip.compress(text.encode()[100:])):
            a, b = archives.arc_records(content)
            assert (a["page_id"], a["payload"], a["url"], a["date"], a["version"]) == (5, b"<p>\n\nx 200 7</p>", "http://a/b%20c", archives.ARC_DATE, version)
            assert (b["page_id"], b["payload"], b["url"]) == (None, b"", archives.NO_URL)
    with pytest.raises(ValueError):
        list(archives.arc_records(text.encode()[:-20]))
    with pytest.raises(ValueError):
        list(archives.arc_records(b"http://a 0.0.0.0 20200101000000 text/html 1\nx\n"))


# language model


def test_scores(spark, sf):
    from tarnwick.llm import suffixtree

    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), odd_docs(spark)):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
        toks = lambda t: [*(t or "").encode().lower().split(), b""]
        c = Counter(w for d, t in rows if not held(d) for w in toks(t))
        n, v = sum(c.values()), len(c)
        base = lambda w: math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1)))
        want = Counter((d, held(d), len(toks(t)), sum(c[w] > 0 for w in toks(t)), n, round(sum(map(base, toks(t))), 6)) for d, t in rows)
        got = suffixtree.scored(docs).collect()
        assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
        if len(rows) > 100:
            out = [r for r in got if r.held_out]
            assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert suffixtree.scored(docs.limit(0)).count() == 0
    assert suffixtree.scored(docs.filter("doc_id = 1"), modulus=1).first().n_known == 0


def test_states_are_distributions():
    """Every state's probabilities sum to 1 over the words, the unknown ones included; scoring uses the longest kept suffix."""
    import plain_tree

    names, rng = [f"w{i}".encode() for i in range(6)], np.random.default_rng(2)
    seq, word = [], 0
    for _ in range(6000):
        word = (word + 1) % 6 if rng.random() < 0.8 else int(rng.integers(6))
        seq.append(names[word])
    ids = {w: i for i, w in enumerate(names, 1)}
    count = np.array([1.0, *[seq.count(w) for w in names]])
    total, distinct = count.sum(), 7
    tree = plain_tree.Tree(ids, np.log10((count + 0.1) / (total + 0.1 * (distinct + 1))))
    numbers = [ids[w] for w in seq]
    for depth in (1, 2):
        joint = Counter()
        for i in range(depth, len(numbers)):
            key = 0
            for x in numbers[i - depth : i]:
                key = key * tree.span + x
            joint[key, numbers[i]] += 1
        keys = np.array(sorted({k for k, _ in joint}))
        size = np.array([sum(n for (k, _), n in joint.items() if k == key) for key in keys], dtype=float)
        owner = np.array([np.searchsorted(keys, k) for k, _ in joint])
        tree.grow(keys, size, owner, np.array([w for _, w in joint]), np.array(list(joint.values()), dtype=float))
    assert len(tree.levels[0][0]) == 6
    unknown = 0.1 / (total + 0.1 * (distinct + 1))
    for state in range(len(tree.back)):
        p = 10 ** tree.log10(np.full(7, state), np.arange(7))
        rest = 10 ** tree.log10(np.array([state]), np.array([-1]))[0] * unknown
        assert abs(p.sum() + rest - 1) < 1e-6
    s, ends, _ = tree.sequence([" ".join(w.decode() for w in seq[:50]), None, "w1 other w2"])
    states = tree.states(s)
    assert states[0] == 0 and states[1] > 0 and states[ends[0]] == 0 and list(ends) == [51, 52, 56] and states[54] == 0


@pytest.mark.parametrize("depth", [2, 3])
def test_scores_equal_the_tree(spark, sf, depth):
    """Every context and next word seen twice is weighed, whatever its share of the tokens: as the tree in one place has it."""
    import plain_tree

    from tarnwick.llm import suffixtree

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows += [(9000 + i, "zqa zqb zqc zqd") for i in range(3)] + [(9100 + i, "zqd zqb zqa zqc") for i in range(3)] + [(9200, None), (9201, " \n"), (9202, "only here unseenword")]
    held = lambda d: zlib.crc32(str(d).encode()) % 10 == 0
    texts = [plain_tree.words_of(t) for d, t in rows if not held(d)]
    c = Counter(w for ws in texts for w in ws)
    total, names = sum(c.values()) + len(texts), sorted(c)
    ids = {w: i for i, w in enumerate(names, 1)}
    count = np.array([len(texts), *[c[w] for w in names]], dtype=float)
    tree = plain_tree.Tree(ids, np.log10((count + 0.1) / (total + 0.1 * (len(names) + 2))))
    seqs, size = [[*[ids[w] for w in ws], 0] for ws in texts], {i: c[w] for w, i in ids.items()}
    key = lambda xs: sum(x * tree.span ** (len(xs) - 1 - k) for k, x in enumerate(xs))
    for d in range(1, depth + 1):
        joint = Counter((key(s[i - d : i]), s[i]) for s in seqs for i in range(d, len(s)))
        joint = {k: n for k, n in joint.items() if n >= 2}
        keys = np.array(sorted({k for k, _ in joint}))
        owner = np.array([np.searchsorted(keys, k) for k, _ in joint])
        tree.grow(keys, np.array([size[k] for k in keys], dtype=float), owner, np.array([w for _, w in joint]), np.array(list(joint.values()), dtype=float))
        size = {k * tree.span + w: n for (k, w), n in joint.items() if w}
    assert all(len(keys) for keys, _ in tree.levels)
    unknown = math.log10(0.1 / (total + 0.1 * (len(names) + 2)))
    want = {}
    for d, t in rows:
        seq, _, _ = tree.sequence([t])
        want[d] = tree.log10(tree.states(seq), seq).sum() + (seq < 0).sum() * unknown
    small = {"MOST_FREQUENT": 50, "PLACES": 16, "SLICE": 500, "FLUSH": 900, "BUCKET": 700}
    for change in ({}, small) if depth == 2 else (small | {"ROUNDS": 3},):
        with pytest.MonkeyPatch.context() as m:
            for k, v in change.items():
                m.setattr(suffixtree, k, v)
            got = {r.doc_id: r.score for r in suffixtree.scored(spark.createDataFrame(rows, "doc_id long, text string"), depth=depth).collect()}
        assert got.keys() == want.keys() and max(abs(got[d] - want[d]) for d in want) < 1e-6


def test_words_beyond_the_vocabulary_end_contexts(spark, sf, monkeypatch):
    """With few words in contexts base scores are as before, and grams of other words change nothing."""
    from tarnwick.llm import suffixtree

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    whole = {r.doc_id: r for r in suffixtree.scored(docs).collect()}
    monkeypatch.setattr(suffixtree, "VOCABULARY", 40)
    few = {r.doc_id: r for r in suffixtree.scored(docs).collect()}
    assert all(abs(few[d].base_score - r.base_score) < 1e-6 and (few[d].n_known, few[d].n_tokens) == (r.n_known, r.n_tokens) for d, r in whole.items())
    assert sum(r.base_score for r in few.values()) < sum(r.score for r in few.values()) < sum(r.score for r in whole.values())


def test_words_not_at_hand_are_in_contexts(spark):
    """540,000 words, each three times: more than every task knows, and all of them states."""
    from tarnwick.llm import suffixtree

    texts = [" ".join(f"w{i}x{j}" for j in range(540)) for i in range(1000)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(3 * texts)], "doc_id long, text string")
    got = [r.score for r in suffixtree.scored(docs, modulus=1, held=1).collect()]
    first = math.log10(3.1 / (3000 * 541 + 0.1 * (540_001 + 1)))  # by the root; then a word and its only next one, or the end
    want = first + 540 * math.log10((3 - suffixtree.DISCOUNT) / 3)
    assert len(got) == 3000 and max(abs(s - want) for s in got) < 1e-6


@pytest.mark.parametrize("depth, change", [(2, {"AT_HAND": 40, "ROUNDS": 2}), (3, {"AT_HAND": 1, "SLICE": 500, "FLUSH": 900, "BUCKET": 700, "MOST_FREQUENT": 50, "PLACES": 16})])
def test_scores_do_not_depend_on_the_words_at_hand(spark, sf, monkeypatch, depth, change):
    from tarnwick.llm import suffixtree

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(odd_docs(spark).select("doc_id", "text"))
    rounded = lambda: Counter((r.doc_id, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in suffixtree.scored(docs, depth=depth).collect())
    want = rounded()
    for k, v in change.items():
        monkeypatch.setattr(suffixtree, k, v)
    assert rounded() == want


@pytest.mark.parametrize("length, bits", [(2, 31), (3, 21), (3, 24), (3, 31), (4, 21)])
def test_grams_as_numbers(length, bits):
    """Grams whose words take few bits are one number, in their order; of the others none is mistaken for one."""
    from tarnwick.llm import suffixtree

    rng = np.random.default_rng(7)
    words = rng.integers(0, 1 << rng.integers(1, bits + 1, (length, 3000)))
    words[:, 0] = (1 << bits) - 1
    context = np.zeros(3000, np.int64)
    for w in words[:-1]:
        context = context << bits | w
    code, fits = suffixtree._coded(context, words[-1], length, bits)
    assert (fits == (words.max(0) < 1 << 63 // length) | (length * bits <= 63)).all()
    back = suffixtree._decoded(code[fits], length, bits)
    assert (back[0] == context[fits]).all() and (back[1] == words[-1][fits]).all()
    assert (np.diff(context[fits][np.argsort(code[fits])]) >= 0).all()


# token counts


@pytest.mark.parametrize("most", [300_000, 5])
def test_token_counts_equal_the_library(spark, sf, most):
    import public_tokenizers
    from tokenizers import Tokenizer

    from tarnwick.llm import tokencount

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rng = np.random.default_rng(5)
    pool = [*"aàÀ'sΣσς1٣½ⅷ-!|́ͅ  \u0085\x1c\x1f﻿​\n\t İIıﬁ漢字é😀<|>", "<|endoftext|>", "<|startoftext|>", "'ll", "'RE"]
    odd = ["".join(rng.choice(pool, 60)) for _ in range(300)] + ["<|endoftext|><|endoftext|>x<|ENDOFTEXT|>", "ΑΣ ΑΣΑ ΣΣ. Σ", "don't DON'T 12 a1b2"]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(odd)], "doc_id long, text string").unionByName(odd_docs(spark).select("doc_id", "text"))
    docs = docs.unionByName(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    want = Counter()
    for r in docs.collect():
        n = len(t.encode(r.text or "", add_special_tokens=False).ids)
        want[r.doc_id, len((r.text or "").encode()), n, n > 2048] += 1
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokencount.counted(docs, path, most).collect())
    assert got == want
    assert tokencount.counted(docs.limit(0), path).count() == 0


# classifiers


def accuracy(df, labels, column):
    got = {(r.held_out, r[column], r.predicted): r["count"] for r in df.join(labels, "doc_id").groupBy("held_out", column, "predicted").count().collect()}
    part = lambda y, p: sum(n for (h, a, b), n in got.items() if h and a == y and b == p)
    return [part(y, y) / max(1, part(y, 0) + part(y, 1)) for y in (0, 1)]


@pytest.mark.parametrize("module, column, modulus, held", [("quality", "quality", 3, 1), ("toxicity", "toxic", 5, 0)])
def test_classifiers(spark, module, column, modulus, held):
    import importlib

    from pyspark.sql import functions as F

    m = importlib.import_module(f"tarnwick.llm.{module}")
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = m.classify(docs, labels)
    assert min(accuracy(out, labels, column)) > 0.85
    assert out.filter("score is null or score < 0 or score > 1 or predicted != cast(score >= 0.5 as int)").count() == 0
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == held
    assert out.filter(F.col("held_out") != fold).count() == 0
    # labels of held-out rows change nothing
    flipped = labels.withColumn(column, F.when(fold, 1 - F.col(column)).otherwise(F.col(column)))
    some = docs.limit(300)
    key = lambda df: sorted((r.doc_id, r.score) for r in df.collect())
    same = labels.join(some, "doc_id", "left_semi")
    assert key(m.classify(some, same)) == key(m.classify(some, flipped.join(some, "doc_id", "left_semi")))
    odd = odd_docs(spark)
    got = m.classify(odd, spark.createDataFrame([(1, 1, 1), (1, 0, 0), (None, 1, 1), (4, None, None), (5, 1, 1)], "doc_id long, quality int, toxic int"))
    assert got.count() == odd.count() and got.filter("score is null").count() == 0
    assert m.classify(odd, labels.limit(0)).count() == odd.count()
    assert m.classify(odd.limit(0), labels).count() == 0


def test_offending_sentences(spark):
    from tarnwick.llm import toxicity

    rows = [(i, f"Text {i}. " + ("All is calm. " * 5) + ("You are vile! " if i % 4 == 0 else "You are kind! ") + "The end is near.") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    for r in toxicity.scored(docs, model).collect():
        text = dict(rows)[r.doc_id]
        assert (r.score >= 0.5) == (r.doc_id % 4 == 0)
        assert [text[s["begin"] : s["end"]].strip() for s in r.offending] == (["You are vile!"] if r.doc_id % 4 == 0 else [])


def test_few_labels_make_no_constant_model(spark, sf):
    from pyspark.sql import functions as F

    from tarnwick.llm import toxicity

    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.classify(docs, labels)
    found = {r.toxic: r.n for r in out.join(labels, "doc_id").filter("held_out and predicted = 1").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    assert found.get(1, 0) >= 1 and found.get(0, 0) <= 2
    one = spark.createDataFrame([(1, "all is vile"), (2, "all is kind"), (3, "vile")], "doc_id long, text string")
    model = toxicity.train(one, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"), modulus=1, held=1)
    got = {r.doc_id: r.score for r in toxicity.scored(one, model).collect()}
    assert got[1] >= 0.5 > got[2] and got[3] >= 0.5


def test_labelled_texts_are_told_apart_by_their_middles(spark):
    """Equal texts count as often as they occur; texts that agree in header and footer are texts of their own."""
    from tarnwick.llm import toxicity

    edge = "A page of the same long header and footer on every document. "
    plain = [(i, ("All is calm. " * 5) + ("You are vile! " if i % 4 == 0 else "You are kind! ") + "The end is near.") for i in range(400)]
    bad, good = ["scum", "moron", "vile", "trash"], ["calm", "kind", "warm", "fair"]
    framed = [(i, f"{edge}Note {i} says that you are {(bad if i % 4 == 0 else good)[i // 4 % 4]}! {edge}") for i in range(400)]
    for rows in (plain, framed):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
        out = toxicity.scored(docs, toxicity.train(docs, labels)).collect()
        assert all((r.score >= 0.5) == (r.doc_id % 4 == 0) for r in out)
        for r in out:
            spans = [dict(rows)[r.doc_id][s["begin"] : s["end"]] for s in r.offending]
            assert len(spans) == (r.doc_id % 4 == 0) and all(any(w in x for w in bad) for x in spans)


def test_compiled_rules_equal_the_model(spark):
    from pyspark.sql import functions as F

    from tarnwick.llm import quality

    rng = np.random.default_rng(4)
    x = rng.random((500, len(quality.STATISTICS)))
    y = ((x[:, 0] > 0.4) & (x[:, 3] <= 0.7)).astype(float)
    base, rules = model = quality.fit(x, y)
    want = 1 / (1 + np.exp(-(base + sum(w * quality._holds(x, r) for r, w in rules))))
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "i long, s array<double>")
    got = np.array([r.p for r in df.select("i", quality.compiled(model, lambda f: F.col("s")[f]).alias("p")).orderBy("i").collect()])
    assert np.abs(got - want).max() < 1e-9
    assert ((got >= 0.5) == (y > 0)).mean() > 0.97
    assert len(rules) < 200


def plain_noisy_or(model, text):
    """A document's score from the model's weights, sentence by sentence, each word by itself."""
    import re

    edges, clean = ".,;:!?*#$%&|\"'()[]{}<>-_/\\`~+=", 1 - model.leak
    for sentence in re.findall(r"[^.!?\n]+[.!?]*", (text or "").lower()):
        names = set()
        for word in sentence.split():
            w = word.strip(edges)
            names |= {w, w[:4] + "~"} if len(w) >= 4 else {w}
        z = [model.weights[n] for n in names if n in model.weights]
        if z:
            clean *= 1 - 1 / (1 + math.exp(-max(-30, min(30, model.bias + sum(z)))))
    return 1 - clean


def test_toxicity_scores_are_noisy_or(spark, sf):
    from tarnwick.llm import toxicity

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    odd = odd_docs(spark).select("doc_id", "text")
    model = toxicity.train(docs, labels)
    texts = docs.select("doc_id", "text").unionByName(odd)
    want = Counter((r.doc_id, round(plain_noisy_or(model, r.text), 9)) for r in texts.collect())
    assert Counter((r.doc_id, round(r.score, 9)) for r in toxicity.scored(texts, model).collect()) == want
    out = toxicity.classify(docs, labels)
    hit = {(r.toxic, r.predicted): r["count"] for r in out.join(labels, "doc_id").filter("held_out").groupBy("toxic", "predicted").count().collect()}
    assert hit.get((0, 1), 0) <= 0.02 * sum(n for (y, _), n in hit.items() if not y)


def test_quality_scores_equal_the_rules(spark, sf):
    """The whole query against the fitted rules applied in plain Python; columns of any name stay; hopeless labels give the rate."""
    from pyspark.sql import functions as F
    from test_corpus_native import CLASHES, clashing

    from tarnwick.llm import quality

    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    base, rules = model = quality.train(docs, labels)
    want = {}
    for r in docs.collect():
        s = quality.statistics(r.text)
        z = base + sum(w for rule, w in rules if all((s[f] <= cut) == low for f, low, cut in rule))
        want[r.doc_id] = 1 / (1 + math.exp(-z))
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert got.keys() == want.keys() and all(abs(got[d].score - p) < 1e-9 and got[d].predicted == (p >= 0.5) for d, p in want.items())
    kept = quality.accepted(clashing(docs), model)
    assert kept.columns == clashing(docs).columns and {r.doc_id for r in kept.collect()} == {d for d, p in want.items() if p >= 0.5}
    assert kept.select(*CLASHES).distinct().count() == 1
    for text in (None, "the same words for all"):
        same = spark.range(60).select(F.col("id").alias("doc_id"), F.lit(text).cast("string").alias("text"))
        out = quality.classify(same, spark.range(60).selectExpr("id AS doc_id", "cast(id % 3 = 0 as int) AS quality")).collect()
        assert len(out) == 60 and len({r.score for r in out}) == 1 and 0.2 < out[0].score < 0.45


def test_sampled_classes_keep_their_shares(spark):
    """A class beyond the sample's bound counts by what its rows stand for."""
    from pyspark.sql import functions as F

    from tarnwick.llm import quality

    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "one text here").otherwise("ONE OTHER TEXT !!!").alias("text"))
    labels = spark.range(3000).selectExpr("id AS doc_id", "cast(id % 10 < 9 as int) AS quality")
    for per_class in (6000, 150):
        model = quality.train(docs, labels, per_class=per_class)
        rate = quality.scored(docs.filter("doc_id = 1"), model).select(F.col(quality.SCORE).alias("s")).first().s
        assert 0.7 < rate < 0.9  # 0.8 of these texts have label 1


def test_neighbours_of_few_vectors_use_the_curves(spark):
    from tarnwick.llm import neighbours

    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    want = brute_nearest([(r.vec_id, r.embedding) for r in df.collect()], every=5)
    got = defaultdict(set)
    for r in neighbours.nearest(df, every=5).collect():
        got[r.query_id].add(r.vec_id)
    assert sum(i in got[q] for q, xs in want.items() for i, _ in xs) >= 0.9 * sum(map(len, want.values()))


def test_archives_of_many_files(spark, sf, monkeypatch):
    from tarnwick.llm import archives

    monkeypatch.setattr(archives, "FILE_RECORDS", 7)
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in archives.archived(pages.coalesce(2)).collect())
    assert got == plain_archive([(r.page_id, r.html) for r in pages.collect()])

"""Decontamination, mixing, SimHash and sharding against plain versions over whole tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, size long"
#: Columns that a table may bring along, named like the operators' own ones.
CLASHES = ("rn", "same", "d", "h", "fp", "row", "range", "copies", "taken", "words", "w", "text_hash", "quality_score", "score", "held_out", "item", "win", "shard", "tail", "p", "n", "mark", "least", "root")


def odd_docs(spark):
    """Nulls, empty and blank texts, a long text, repeated rows, repeated ids, clashing extra columns."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [
        (1, None, "en", "b", 0, "k", 1), (2, "", "en", "b", 0, "k", 1), (3, " \n ", None, None, 0, "k", 1), (4, long, "en", "a", 9, "k", 1),
        (5, "one two three four five six seven eight nine ten eleven", "en", "a", 1, "k", 1), (5, "one two three four five six seven eight nine ten eleven", "en", "a", 1, "k", 1),
        (6, "A b", "en", "a", 1, "k", 1), (6, "another text of the same id with some more words in it", "en", "c", 1, "k", 1),
        (None, "a text without any id at all here", "en", None, 1, "k", 1), (7, "x ONE two Three four five six seven eight nine TEN, eleven y", "de", "d", None, "k", None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def clashing(docs):
    """docs with a column of each name in CLASHES."""
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit(f"own {c}") for c in CLASHES})


def rows(df):
    return [r.asDict() for r in df.collect()]


# decontamination

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall((t or "").encode().lower())


def brute_hits(docs, items, span=10):
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(span, len(w))
        for i in range(len(w) - n + 1) if n else ():
            windows[tuple(w[i : i + n])].add(item)
    sizes = sorted({len(k) for k in windows})
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (got := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= got
        names = sorted(str(x) for x in found if x is not None)
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return Counter(out)


def as_counter(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


COLS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def test_decontamination_equals_brute_force(spark, sf):
    from tarnwick.llm import decontamination

    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    want = brute_hits([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert sum(k[5] for k in want) > 0
    assert as_counter(decontamination.report(docs, items), *COLS) == want


@pytest.mark.parametrize("broadcast", [True, False])
def test_decontamination_odd_rows_and_short_items(spark, broadcast, monkeypatch):
    from tarnwick.llm import decontamination

    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", decontamination.BROADCAST_BYTES if broadcast else -1)
    items = spark.createDataFrame(
        [(1, "one two three four five six seven eight nine ten"), (2, "TEN eleven"), (3, "b"), (4, None), (5, ""), (2, "TEN eleven"), (9, "É b c d e"), (10, "nine ten eleven y z")], "item_id long, text string"
    )
    docs = odd_docs(spark)
    want = brute_hits([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert as_counter(decontamination.report(docs, items), *COLS) == want
    kept = decontamination.clean(docs, items)
    assert kept.columns == docs.columns
    assert kept.count() == sum(n for k, n in want.items() if not k[5])
    assert decontamination.report(docs, items.limit(0)).filter("contaminated").count() == 0
    assert decontamination.report(docs.limit(0), items).count() == 0


def test_decontamination_words_are_exact_and_repeats_are_cheap(spark):
    """Words that full lower-casing of a text would change; runs of one word; marks that all items share."""
    import time

    from tarnwick.llm import decontamination

    common = "this common phrase of five"
    items = [(1, "alpha beta gamma delta ΑΣ ΑΣ epsi zeta eta theta"), (2, "spam " * 400), (3, "ham " * 30 + "eggs"), (None, "no id has this item here, of ten words in all")]
    items += [(100 + i, f"{common} words {i} a{i} b{i} c{i} d{i} e{i}") for i in range(60)]
    docs = [(1, "alpha beta gamma delta ΑΣ'ΑΣ'epsi zeta eta theta"), (2, "spam " * 1000), (3, "ham " * 500 + "eggs eggs"), (4, "spam " * 9), (5, f"{common} " * 50), (6, f"{common} words 7 a7 b7 c7 d7 e7 {common} words 8 a8 b8 c8 d8 e8"), (7, "No ID has this item here of ten words in all"), (8, "İ ΑΣ " * 30)]
    began = time.time()
    got = as_counter(decontamination.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")), *COLS)
    assert got == brute_hits(docs, items) and sum(k[5] for k in got) == 5
    assert time.time() - began < 60


def test_decontamination_keeps_columns_of_any_name(spark, sf):
    from tarnwick.llm import decontamination

    docs, items = clashing(spark.read.parquet(f"{sf}/documents.parquet")), clashing(spark.read.parquet(f"{sf}/benchmark.parquet"))
    kept = decontamination.clean(docs, items)
    assert kept.columns == docs.columns
    want = decontamination.report(docs, items).filter("not contaminated")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in want.collect())
    assert kept.select(*CLASHES).distinct().collect() == [tuple(f"own {c}" for c in CLASHES)]


# mixing

def plain_targets(sizes):
    """sizes: {source: words}; the excess over three times is shared again, round by round."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    left, free, out = float(sum(sizes.values())), set(names), {}
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 3 * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = 3.0 * sizes[s]
        left -= sum(out[s] for s in over)
        free -= over
    return out


@pytest.mark.parametrize("which", ["table", "odd", "few"])
def test_mixing(spark, sf, which):
    from tarnwick.llm import mixing

    docs = odd_docs(spark) if which == "odd" else spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.filter("source in ('src0', 'src1', 'src2') and (source != 'src1' or doc_id < 50)") if which == "few" else docs
    size = lambda t: len((t or "").encode().split())
    want_rows = Counter((r.doc_id, size(r.text)) for r in docs.collect())
    sizes = Counter()
    for r in docs.collect():
        sizes[r.source] += size(r.text)
    want = plain_targets(dict(sizes))
    got = rows(mixing.planned(docs))
    assert Counter((r["doc_id"], r["size"]) for r in got) == want_rows
    assert all(r["copies"] <= 3 for r in got)
    for s, target in want.items():
        mine = [r for r in got if r["source"] == s]
        assert all(abs(r["target"] - target) < 1e-6 * max(1, target) for r in mine)
        taken, biggest = sum(r["size"] * r["copies"] for r in mine), max(r["size"] for r in mine)
        assert abs(taken - target) <= biggest + 1e-6
    again = rows(mixing.mixed(docs.repartition(7)))
    first = rows(mixing.mixed(docs))
    key = lambda r: tuple((v is None, v or 0) for v in r.values())
    assert sorted(again, key=key) == sorted(first, key=key)
    mix = mixing.repeated(docs)
    assert mix.columns == docs.columns
    assert Counter((r.doc_id, r.source) for r in mix.collect()) == Counter({k: n for k, n in sum((Counter({(r["doc_id"], r["source"]): r["copies"]}) for r in got), Counter()).items() if n})


def test_mixing_empty(spark):
    from tarnwick.llm import mixing

    assert mixing.mixed(odd_docs(spark).limit(0)).count() == 0


def test_pivotal_rounding_keeps_expectations(spark):
    from pyspark.sql import functions as F

    from tarnwick.llm import mixing

    base = spark.range(400).select(F.lit(0).cast("long").alias("source_rank"), F.col("id").alias("doc_id"), F.lit(1).alias("rn"), (F.col("id") % 7 + 1).alias("size"), F.lit(0.3).alias("p"))
    ups = [mixing.rounded(base, seed=s).groupBy().agg(F.sum("up").alias("u"), F.sum(F.col("up") * F.col("size")).alias("w")).first() for s in range(4)]
    mass = 0.3 * sum(i % 7 + 1 for i in range(400))
    assert all(abs(u.w - mass) <= 7 for u in ups)
    assert all(90 <= u.u <= 150 for u in ups)


# SimHash

def plain_fingerprint(t):
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    count = [0] * 64
    for s in sh:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            count[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * count[b] > len(sh))


def plain_components(fps, radius=3):
    """fps: [(doc_id, fp)] -> {fp: smallest id}"""
    distinct = sorted({f for _, f in fps})
    parent = {f: f for f in distinct}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                parent[find(b)] = find(a)
    least = {}
    for d, f in fps:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return {f: least.get(find(f)) for f in distinct}, len({find(f) for f in distinct})


@pytest.mark.parametrize("which", ["table", "odd"])
def test_simhash(spark, sf, which):
    from tarnwick.llm import simhash

    docs = odd_docs(spark) if which == "odd" else spark.read.parquet(f"{sf}/documents.parquet")
    fps = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.collect()]
    comp, n_components = plain_components(fps)
    got = as_counter(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id")
    assert got == Counter((d, f"{f:016x}", comp[f]) for d, f in fps)
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert all(r.doc_id == comp[plain_fingerprint(r.text)] for r in kept.collect())
    assert kept.count() == n_components
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_vantage_point_tree_finds_every_link(spark):
    """Random fingerprints, chains and a dense ball, over many shards."""
    import numpy as np

    from tarnwick.llm import simhash

    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    flips = lambda x, n: x ^ np.bitwise_or.reduce([np.uint64(1) << np.uint64(b) for b in rng.choice(64, n, replace=False)])
    near = [flips(x, int(rng.integers(1, 5))) for x in base[:600]]
    chain = [base[0]]
    for _ in range(40):
        chain.append(flips(chain[-1], 3))
    ball = [flips(base[1], int(rng.integers(1, 7))) for _ in range(500)]
    values = np.unique(np.concatenate([base, near, chain, ball]).astype(np.uint64))
    fps = [(i, int(v)) for i, v in enumerate(rng.permutation(values))]
    want, _ = plain_components(fps)
    df = spark.createDataFrame([(i, f - 2**64 if f >= 2**63 else f) for i, f in fps], "doc_id long, fp long")
    got = {(r.fp + 2**64) % 2**64: r.component_id for r in simhash.grouped(df).collect()}
    assert got == want


# sharding

@pytest.mark.parametrize("which", ["table", "odd", "copies", "same"])
def test_sharding(spark, sf, which):
    from pyspark.sql import functions as F

    from tarnwick.llm import sharding

    docs = odd_docs(spark) if which == "odd" else spark.read.parquet(f"{sf}/documents.parquet")
    if which == "copies":  # a third of the rows are copies of one text
        docs = docs.withColumn("text", F.expr("if(doc_id % 3 = 0, repeat('copy of it ', 100), text)"))
    if which == "same":  # one row, repeated
        docs = docs.limit(1).withColumn("x", F.explode(F.sequence(F.lit(1), F.lit(2000))))
    got = rows(sharding.sharded(docs))
    text = [((r.doc_id), len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs.collect()]
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(text)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
        assert r["law"] == "bytes" and r["grown_shard"] is None
    for s, mine in by.items():
        assert 0 <= s < 24
        assert sorted(r["slot"] for r in mine) == list(range(len(mine)))
    total, biggest = sum(t[1] for t in text), max(t[1] for t in text)
    for s in range(24):
        assert abs(sum(r["size"] for r in by[s]) - total / 24) <= 1.02 * biggest + 0.02 * total / 24
    groups = defaultdict(set)
    for r in got:
        groups[r["text_crc32"]].add(r["shard"])
    assert all(max(g) - min(g) == len(g) - 1 for g in groups.values())  # copies lie side by side


def test_sharding_many_ranges_and_small_groups(spark, sf, monkeypatch):
    """Ranges follow the rows, splitters go through both levels, overfull ranges are subdivided, small groups of copies stay whole."""
    from pyspark.sql import functions as F

    from tarnwick.llm import sharding

    monkeypatch.setattr(sharding, "ROWS", 10)
    monkeypatch.setattr(sharding, "COARSE", 5)
    monkeypatch.setattr(sharding, "OVERFULL", 1.2)
    docs = clashing(spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.floor(F.col("id") / 4), F.repeat(F.lit("x"), (F.floor(F.col("id") / 4) % 50).cast("int"))).alias("text")))
    got = rows(sharding.sharded(docs))
    assert len(got) == 20_000 and len({(r["shard"], r["slot"]) for r in got}) == 20_000
    groups = defaultdict(set)
    for r in got:
        groups[r["text_crc32"]].add(r["shard"])
    assert all(len(g) == 1 for g in groups.values())
    sums = Counter()
    for r in got:
        sums[r["shard"]] += r["size"]
    assert max(sums.values()) - min(sums.values()) < 0.03 * sum(sums.values()) / 24


def test_mixing_and_deduplication_keep_columns_of_any_name(spark, sf):
    from tarnwick.llm import mixing, simhash

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for f in (mixing.repeated, simhash.deduplicated):
        own = f(clashing(docs))
        assert own.columns == clashing(docs).columns and own.select(*CLASHES).distinct().collect() == [tuple(f"own {c}" for c in CLASHES)]
        assert sorted(r.doc_id for r in own.collect()) == sorted(r.doc_id for r in f(docs).collect())


def test_sharding_empty(spark):
    from tarnwick.llm import sharding

    assert sharding.sharded(odd_docs(spark).limit(0)).count() == 0

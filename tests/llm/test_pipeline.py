"""corpus_pipeline against plain versions of its stages, each on its predecessor's rows."""

import zlib
from collections import Counter

from test_corpus_native import brute_hits, plain_components, plain_fingerprint, plain_targets


def test_stages(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [name for name, _ in p.STAGES] == ["quality classifier", "SimHash near-dedup", "benchmark decontamination", "mixing sources to target weights", "sharding"]
    outs, at = [], docs
    for k, (_, f) in enumerate(p.STAGES):
        at = p.staged(f(spark, at, sf), f"t{k}")
        outs.append(at)
        assert k == 4 or at.columns == docs.columns
    # 1: rejected documents go, clean ones stay
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in outs[0].collect()}
    good, bad = [d for d, q in labels.items() if q == 1], [d for d, q in labels.items() if q == 0]
    assert sum(d in kept for d in good) >= 0.95 * len(good) and sum(d not in kept for d in bad) >= 0.7 * len(bad)
    # 2
    rows = outs[0].collect()
    comp, n = plain_components([(r.doc_id, plain_fingerprint(r.text)) for r in rows])
    assert {r.doc_id for r in outs[1].collect()} == set(comp.values()) and outs[1].count() == n
    # 3
    hit = brute_hits([(r.doc_id, r.text) for r in outs[1].collect()], [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])
    assert {r.doc_id for r in outs[2].collect()} == {k[0] for k in hit if not k[5]}
    # 4
    size = lambda t: len((t or "").encode().split())
    sizes, taken, most = Counter(), Counter(), Counter()
    for r in outs[2].collect():
        sizes[r.source] += size(r.text)
        most[r.source] = max(most[r.source], size(r.text))
    for r in outs[3].collect():
        taken[r.source] += size(r.text)
    for s, t in plain_targets(dict(sizes)).items():
        assert abs(taken[s] - t) <= most[s]
    # 5
    want = Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in outs[3].collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in outs[4].collect()) == want
    whole = p.run(spark, sf)
    assert Counter(map(tuple, whole.collect())) == Counter(map(tuple, outs[4].collect()))

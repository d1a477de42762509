import collections

import corpus_pipeline
from castellan.llm import exact_dedup, pii, quality, simhash

SF = "/root/testdata/sf0.001"


def test_stages_in_turn(spark, docs):
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "SimHash near-dedup", "PII", "best-fit packing"]
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    now = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, now, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        kept = {r.doc_id: r.text for r in out.collect()}
        if name == "quality rules":
            want = {d for d, t in rows if not (lambda c: c[0] < 20 or 100 * c[4] > 30 * c[0])(quality.counts(t.encode()))}
            assert set(kept) == want
        elif name == "exact dedup":
            last = {}
            for d, t in rows:
                last[t] = max(d, last.get(t, d))
            assert set(kept) == set(last.values())
        elif name == "SimHash near-dedup":
            sets = {d: set(simhash.shingle_hashes(t.encode(), 5).tolist()) for d, t in rows}
            ids = sorted(sets)
            near = {b for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
            assert set(ids) - set(kept) == near
        else:
            w = pii.weights()
            assert all(not base for base, _ in pii.find(list(kept.values()), w)) and len(kept) == len(rows)
        rows = list(kept.items())
        now = spark.createDataFrame(out.collect(), docs.schema)
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in packed} == {d for d, _ in rows}
    fill = collections.Counter()
    for r in packed:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048
    assert exact_dedup  # the stages above call these operators


def test_stages_take_odd_rows(spark, odd, nothing):
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, odd, SF).collect()
        assert stage(spark, nothing, SF).count() == 0

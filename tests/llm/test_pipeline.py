"""The pipeline against the same stages by brute force."""

import re
import zlib

import numpy as np

import corpus_pipeline
from quorum.llm import quality
from tests.llm.test_operators import brute_sets, encoded


def test_pipeline(spark, tmp_path):
    path = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{path}/documents.parquet").collect()
    good = {r.doc_id for r in quality.quality_rules(spark.read.parquet(f"{path}/documents.parquet")).collect() if r.kept}
    first = {}
    for r in sorted((r for r in rows if r.doc_id in good), key=lambda r: r.doc_id):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r)
    left = list(first.values())
    sets = [brute_sets(r.text, 5) for r in left]
    comp = list(range(len(left)))
    for i in range(len(left)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                comp = [comp[j] if c == comp[i] else c for c in comp]
    kept = [r for i, r in enumerate(left) if comp.index(comp[i]) == i]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        stage(spark, docs, path).write.parquet(out := f"{tmp_path}/{name}")
        docs = spark.read.parquet(out)
        assert docs.columns == before.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert sorted(texts) == sorted(r.doc_id for r in kept)
    whole = encoded([(i, t) for i, t in texts.items()])
    got = corpus_pipeline.run(spark, path).collect()
    assert sum(g.length for g in got) == sum(map(len, whole)) and {g.doc_id for g in got} == set(texts)
    by = dict(zip(texts, whole, strict=True))
    assert all(zlib.crc32(np.ascontiguousarray(by[g.doc_id][g.start : g.start + g.length]).tobytes()) == g.ids_crc32 for g in got)

import os

import pytest

import corpus_pipeline
from drawlake.llm import minhash, mixing, pieces, quality, secrets

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF) or not os.path.exists(pieces.MODEL_FILE), reason="no tables here")


def test_stages_on_their_own_input(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before, tables = docs.columns, docs, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, SF).write.parquet(str(tmp_path / str(k)))
        tables[name] = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert tables[name].columns == columns
        before = tables[name]
    good, single, masked, mixed, encoded = tables.values()
    scored = quality.with_score(docs, quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    assert {r["doc_id"] for r in good.collect()} == {r["doc_id"] for r in scored.where("score >= 0.3").collect()}
    # one document of each group, by the sets themselves
    rows = {r["doc_id"]: r["text"] for r in good.collect()}
    sets = {i: set(minhash.shingle_set(t).tolist()) for i, t in rows.items()}
    keep = {r["doc_id"] for r in single.collect()}
    for i in keep:
        assert not any(j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) for j in keep)
    for i in rows.keys() - keep:
        assert any(100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) for j in rows if j != i)
    assert not any(secrets.scan(r["text"])[0] for r in masked.collect())
    assert {r["doc_id"] for r in mixed.collect()} == {r["doc_id"] for r in mixing.mix(masked, budget=corpus_pipeline.BUDGET, epochs=1).collect()}
    texts = {r["doc_id"]: r["text"] for r in mixed.collect()}
    coder = pieces.Coder(pieces.load())
    assert {r["doc_id"]: coder.decode(r["ids"]) for r in encoded.collect()} == texts

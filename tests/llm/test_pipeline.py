"""The stages of the corpus pipeline, each against a plain version on its own input."""

from __future__ import annotations

import corpus_pipeline
from siftline.llm import secrets

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before = docs
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, before, SF).write.parquet(str(tmp_path / str(number)))
        after = spark.read.parquet(str(tmp_path / str(number)))
        assert after.columns == columns
        old, new = ({r.doc_id: r.text for r in df.collect()} for df in (before, after))
        assert set(new) <= set(old)
        if number == 0:
            assert all(i in new for i in old if labels.get(i) == 1)
            assert sum(i not in new for i in old if labels.get(i) == 0) * 10 >= 7 * sum(q == 0 for q in labels.values())
        elif number == 1:
            assert all(i in new for i, t in old.items() if labels.get(i) == 1 and len(t.split()) >= 50)
        elif number == 2:
            groups: dict[str, list[int]] = {}
            for i, t in old.items():
                groups.setdefault(" ".join(t.lower().split()), []).append(i)
            assert all(i not in new for g in groups.values() for i in g if i != min(g))
        else:
            assert set(new) == set(old)
            assert all(secrets.redacted(t, secrets.find_secrets(t)) == new[i] for i, t in old.items())
        before = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, before, SF).toPandas()
    assert set(pieces.doc_id) == {r.doc_id for r in before.select("doc_id").collect()}
    assert (pieces.groupby("doc_id").length.sum() == pieces.groupby("doc_id").doc_tokens.first()).all()
    whole = corpus_pipeline.run(spark, SF).toPandas()
    key = ["doc_id", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert sorted(map(tuple, whole[key].values.tolist())) == sorted(map(tuple, pieces[key].values.tolist()))

import re

import corpus_pipeline
from test_simhash import brute_components, brute_print

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    from voxelloom.llm.shared import written

    rows = [sorted(map(tuple, docs.collect()), key=str)]
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = written(stage(spark, docs, small))
        assert docs.columns == columns, name
        counts.append(docs.count())
        rows.append(sorted(map(tuple, docs.collect()), key=str))
    text, ident = columns.index("text"), columns.index("doc_id")
    assert set(rows[1]) <= set(rows[0]) and set(rows[2]) <= set(rows[1])  # filters change nothing in what they keep
    groups = brute_components([(r[ident], brute_print(r[text])) for r in rows[1]])
    assert {r[ident] for r in rows[2]} == {component for _, _, component in groups} and len(rows[2]) == len({c for *_, c in groups})
    assert [r[ident] for r in rows[3]] == [r[ident] for r in rows[2]]
    by_id = {r[ident]: set(WORD.findall(r[text])) for r in rows[3]}
    assert all(set(WORD.findall(r[text])) <= by_id[r[ident]] for r in rows[4])
    assert counts[0] >= counts[1] > counts[2] == counts[3] and counts[4] > 0
    assert not any(re.search(r"[A-Za-z0-9]@[a-z]+\.[a-z]", r.text or "") for r in docs.collect())
    packed = corpus_pipeline.STAGES[4][1](spark, docs, small)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").distinct().collect()}


def test_edge_table(spark, docs, no_docs, small):
    for df in (docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, small)
        df.count()


def test_registered():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert len(corpus_pipeline.STAGES) == 5

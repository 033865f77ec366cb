"""The pipeline's stages, each against what its operator and brute force say, on awkward rows too."""

import brute
import edge

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_keep_columns_and_decide(spark):
    import corpus_pipeline as p
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage = dict(p.STAGES)
    assert list(stage) == ["quality_rules", "near_duplicates", "repeated_passages", "personal_data", "packing"]
    texts = {r.doc_id: r.text for r in docs.collect()}

    kept = stage["quality_rules"](spark, docs, SF)
    assert kept.columns == COLUMNS
    failed = {i for i, t in texts.items() for n, _, _, _, rep in [brute.base_counts(t)] if n < 50 or 100 * rep > 50 * n}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.doc_id not in failed}
    ids = {r.doc_id for r in kept.collect()}
    assert not ids & failed
    assert sum((i in ids) == bool(q) for i, q in labels.items()) >= 0.95 * len(labels)
    assert ids >= {i for i in texts if i not in failed and labels.get(i, 1) and "###" not in texts[i] and "|" not in texts[i]}

    one = stage["near_duplicates"](spark, docs, SF)
    want = brute.near_components(list(texts.items()))
    assert one.columns == COLUMNS and sorted(r.doc_id for r in one.collect()) == sorted(i for i, (_, c) in want.items() if c == i)

    cut = stage["repeated_passages"](spark, docs, SF)
    lengths = brute.earlier_copies(list(texts.items()))
    assert cut.columns == COLUMNS
    for r in cut.collect():
        assert r.n_chars == len(r.text) and 0 <= lengths[r.doc_id][0] - lengths[r.doc_id][1] - len(r.text.encode()) <= 6 * lengths[r.doc_id][2]

    clean = stage["personal_data"](spark, docs, SF)
    assert clean.columns == COLUMNS
    for r in clean.collect():
        assert not brute.base_spans(r.text) and (brute.base_spans(texts[r.doc_id]) or r.text == texts[r.doc_id])

    assert stage["packing"](spark, docs.limit(20), SF).agg({"length": "sum"}).first()[0] > 0


def test_stages_take_awkward_and_empty_tables(spark):
    import corpus_pipeline as p
    for data in (edge.rows(), []):
        docs = edge.with_clashes(edge.frame(spark, data))
        for name, stage in p.STAGES:
            out = stage(spark, docs, SF)
            if name != "packing":
                assert out.columns == docs.columns
            n = out.count()
            assert n == 0 if not data else n > 0
            if name == "near_duplicates" and data:
                got = [r.doc_id for r in out.collect()]
                assert got.count(30) == 0 or got.count(30) == 1
                assert got.count(None) == 2 and got.count(31) == 1

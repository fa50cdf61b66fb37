"""The pipeline's stages in their order, each against its operator."""

import corpus_pipeline as p
from kinlink.llm import op04_pieces, op08_copies, op09_mixture
from tests.llm.util import awkward, documents


def test_run_equals_its_stages(spark, sf, tmp_path):
    assert [n for n, _ in p.STAGES] == ["quality", "near_copies", "private", "mixture", "pieces"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(p.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        counts.append(docs.count())
        if name != "pieces":
            assert docs.columns == columns
        if name == "near_copies":
            want = {r["doc_id"] for r in op08_copies.cluster(before).filter("kept").collect()}
            assert sorted(r["doc_id"] for r in docs.collect()) == sorted(want)
        if name == "mixture":
            takes = {r["doc_id"]: r["taken"] // max(r["size"], 1) for r in op09_mixture.mix(before).collect()}
            got = {}
            for r in docs.collect():
                got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
            assert got == {i: n for i, n in takes.items() if n}
    assert counts[0] > counts[1] > counts[2] == counts[3] and counts[4] == counts[5]
    coder = op04_pieces.prefix_table(op04_pieces.default_model())
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    assert all(r["ids"] == coder.encode(texts[r["doc_id"]]) for r in docs.collect())
    whole = p.run(spark, sf)
    key = lambda df: sorted((r["doc_id"], r["ids_sha256"]) for r in df.collect())
    assert key(whole) == key(docs)


def tables(spark, at, rows, labels):
    documents(spark, rows).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")


def test_awkward_rows_run_through(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows and ids, columns with names that stages might use."""
    rows = awkward()
    tables(spark, tmp_path, rows, [(k, 1 if k % 2 else None, 0) for k in range(40)] + [(None, 1, None)])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in p.STAGES[:4]:
        before, docs = docs, stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.schema == before.schema, name
        assert {r["doc_id"] for r in docs.collect()} <= {r["doc_id"] for r in before.collect()}
    out = p.run(spark, str(tmp_path)).collect()
    assert len(out) == docs.count() > 20
    texts = {}
    for r in docs.collect():
        texts.setdefault(r["doc_id"], set()).add(op04_pieces.prefix_table(op04_pieces.default_model()).encode(r["text"] or "").__len__())
    assert all(r["n_tokens"] in texts[r["doc_id"]] for r in out)


def test_empty_tables_run_through(spark, tmp_path):
    tables(spark, tmp_path, awkward(), [(1, 1, 0)])
    spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.read.parquet(f"{tmp_path}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/none/labels.parquet")
    assert p.run(spark, f"{tmp_path}/none").count() == 0

"""The corpus queries against their SQL; the pipeline against brute force."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import rows_of_spark, rows_of_sql  # noqa: E402

import corpus_pipeline  # noqa: E402
from voxelmill.llm import queries  # noqa: E402
from voxelmill.llm.bpe import encoder  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_agrees_with_sql(spark, sf_dir, name):
    assert rows_of_spark(queries.QUERIES[name](spark, sf_dir)) == rows_of_sql(queries.ORACLE_SQL[name], sf_dir)


def test_pipeline(spark, sf_dir):
    from test_operators import ALNUM, SPACE, components, hits, judged, lower

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, steps = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns
        rows = docs.collect()
        steps.append({r.doc_id: r.text for r in rows})
        docs = spark.createDataFrame(rows, docs.schema)
    source = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    kept = {i for i, t in source.items() if judged(t or "")[-1]}
    assert set(steps[0]) == kept
    sets = {}
    for i in kept:
        w = SPACE.findall(lower(source[i]))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
    kept = {i for i, c in components(sets, 80).items() if i == c}
    assert set(steps[1]) == kept
    items = {str(r.item_id): ALNUM.findall(lower(r.text or "")) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    kept = {i for i in kept if not hits(ALNUM.findall(lower(source[i])), items, 10)[1]}
    assert set(steps[2]) == kept
    assert set(steps[3]) <= kept and len(steps[3]) > 0.7 * len(kept)
    enc = encoder("byte_bpe_50k.json")
    out = {r.doc_id: r.n_tokens for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()}
    assert out == {i: len(enc.whole(t or "")) + 1 for i, t in steps[3].items()}


def test_pipeline_run_on_odd_tables(spark, sf_dir, tmp_path):
    """Nulls in every column, repeated rows, empty and very long texts, an empty table, columns with clashing names."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    good = docs.where("length(text) > 600").orderBy("doc_id").first()
    n = lambda i, text: (i, text, None, None, None)
    long = "\n".join(f"{good.text} {k} {k * k} {k + 7}" for k in range(60))
    odd = spark.createDataFrame([n(None, None), n(None, good.text), n(9001, None), n(9002, ""), n(9003, long), n(9003, long), n(9004, "a" * 100_000)], docs.schema)
    for table in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").write.parquet(f"{tmp_path}/odd/{table}.parquet")
        spark.read.parquet(f"{sf_dir}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{table}.parquet")
    extra = {c: F.lit(1) for c in ("spans", "items", "n_words", "chance", "kept", "x", "part")}
    docs.unionByName(odd).withColumns(extra).write.parquet(f"{tmp_path}/odd/documents.parquet")
    found = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    ids = [r.doc_id for r in found]
    assert len(ids) == len(set(ids)) and not {9001, 9002, 9004} & set(ids) and len(ids) > 10
    assert sorted(r.start for r in found) == [sum(r.n_tokens for r in sorted(found, key=lambda r: r.start)[:k]) for k in range(len(found))]
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0

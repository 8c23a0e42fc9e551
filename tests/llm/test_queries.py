"""The registered queries and the pipeline on the smallest tables."""

import glob
import os

import pytest

import corpus_pipeline
from linequarry.llm.entries import ORACLE_SQL, QUERIES, table


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got, want = QUERIES[name](spark, sf_dir).toPandas(), con.execute(ORACLE_SQL[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols and len(got) == len(want)

    def rows(df):
        return sorted(tuple(f"{float(v):.9g}" if isinstance(v, (int, float)) or hasattr(v, "item") else str(v) for v in r) for r in df[cols].fillna("-").itertuples(index=False, name=None))

    assert rows(got) == rows(want)


def test_pipeline(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows, names = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, sf_dir)
        names.append(name)
        assert rows.schema.names == docs.schema.names and [f.dataType for f in rows.schema] == [f.dataType for f in docs.schema]
    out = corpus_pipeline.run(spark, sf_dir)
    assert 0 < out.select("doc_id").distinct().count() <= docs.count() and len(corpus_pipeline.STAGES) == 5

import duckdb
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from creditspark.llm import bpe, decontaminate, lines, quality, queries
from creditspark.llm.common import table
from test_llm_bpe import digests
from test_llm_decontaminate import brute as leaks
from test_llm_neardup import brute as near

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    result = con.execute(queries.SQL[name])
    columns = [d[0] for d in result.description]
    out = queries.QUERIES[name](spark, SF)
    assert sorted(out.columns) == sorted(columns)
    assert sorted((tuple(r[c] for c in columns) for r in out.collect()), key=str) == sorted(result.fetchall(), key=str)


def test_all_operators_are_registered():
    names = contract.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names


def test_pipeline_equals_its_stages_by_brute_force(spark, monkeypatch):
    from tokenizers import Tokenizer

    machine = quality.fit(table(spark, SF, "documents"), table(spark, SF, "labels"))
    monkeypatch.setattr(quality, "fit", lambda *a, **k: machine)
    docs = table(spark, SF, "documents")
    good = {r.doc_id for r in quality.score(docs, machine).where("predicted = 1").collect()}
    slim = lines.drop_boilerplate(docs.where(docs.doc_id.isin(list(good))))  # compared with brute force in its own test
    rows = [(r.doc_id, r.text) for r in slim.collect()]
    classes = near(rows)
    rows = [(d, t) for d, t in rows if classes[d] == d]
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    bad = {r[0] for r in leaks(rows, items)}
    library = Tokenizer.from_file(bpe.VOCABULARY)
    want = {d: digests(library, t) for d, t in rows if d not in bad}
    out = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert out == want and len(want) > 50


def test_stages_keep_the_columns_of_documents(spark):
    docs = table(spark, SF, "documents").limit(40)
    assert len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
    assert decontaminate.drop_contaminated(docs.limit(0), table(spark, SF, "benchmark")).collect() == []

import duckdb
import pytest

import corpus_pipeline as cp
from gatewatch.llm import queries as q
from gatewatch.sources.tables import TABLES, load_table
from scripts.oracle_check import digest
from tests.conftest import SF_SMALL


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    got, want = q.QUERIES[name](spark, SF_SMALL).toPandas(), con.execute(q.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    assert digest(got) == digest(want)


def test_queries_and_stages():
    assert sorted(int(n[2:].split("_")[0]) for n in q.QUERIES) == list(range(1, 14))
    assert [n for n, _ in cp.STAGES] == ["toxicity", "simhash_near_dedup", "decontamination", "mixing", "sharding"]


def test_pipeline_equals_its_stages_by_brute_force(spark):
    """The decisions of the numbered queries, taken one after the other on the driver."""
    from gatewatch.llm import decontaminate as dc
    from gatewatch.llm import mixing, simhash, toxicity
    docs = load_table(spark, SF_SMALL, "documents")
    labels = load_table(spark, SF_SMALL, "labels")
    model = toxicity.train(docs, labels, q.may_learn)
    scores = toxicity.score_toxicity(docs, model).collect()
    keep = docs.where(docs.doc_id.isin([r.doc_id for r in scores if r.score < 0.5]))
    group = simhash.near_duplicates(keep).collect()
    keep = keep.where(keep.doc_id.isin([r.doc_id for r in group if r.doc_id == r.component_id]))
    texts = {}
    spans = {r.doc_id: r for r in dc.match_spans(keep, load_table(spark, SF_SMALL, "benchmark")).collect()}
    for r in keep.collect():
        s = spans[r.doc_id]
        if s.n_hit <= 0.5 * s.n_words:
            raw, at, out = r.text.encode(), 0, b""
            for x in s.spans:
                out, at = out + raw[at:x.start], x.end
            texts[r.doc_id] = (out + raw[at:]).decode()
    left = spark.createDataFrame([(r.doc_id, texts[r.doc_id], r.lang, r.source, len(texts[r.doc_id]))
                                  for r in keep.collect() if r.doc_id in texts], docs.schema)
    rates = mixing.document_rates(left, q.mix_labels(left, labels), q.MIX_TARGETS, least=1.0).collect()
    want = sorted((r.doc_id, texts[r.doc_id]) for r in rates for _ in range(r.copies))
    out = cp.run(spark, SF_SMALL)
    assert out.columns == [*docs.columns, "slot", "shard"]
    assert sorted((r.doc_id, r.text) for r in out.collect()) == want


def test_stages_on_empty_documents(spark):
    docs = load_table(spark, SF_SMALL, "documents").limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF_SMALL)
        assert docs.collect() == []

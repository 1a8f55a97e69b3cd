"""The pipeline against its stages' brute-force versions, and the queries' registration."""

import re
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from evifuse.llm import queries, toxicity

from .test_llm import brute_components, brute_quality

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables are absent")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    df = queries.queries()[name](spark, SF)
    names = sorted(df.columns)
    told = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in told.description]
    assert sorted(columns) == names
    want = sorted(repr([v for _, v in sorted(zip(columns, row))]) for row in told.fetchall())
    assert sorted(repr([r[c] for c in names]) for r in df.collect()) == want


def test_each_operator_has_one_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.queries()) == list(range(1, 14))


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = docs
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality_rules"](spark, kept, SF)
    # so few labels prove no cutoff: the base rule alone decides
    counts = {i: brute_quality(t) for i, t in texts.items()}
    good = {i for i, c in counts.items() if c[0] >= 50 and 100 * c[4] <= 50 * c[0]}
    assert {r.doc_id for r in kept.collect()} == good and kept.columns == docs.columns
    sample = toxicity.sample(kept, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    weights = toxicity.train(toxicity.ordered([(r.doc_id, bytes(r.raw), r.toxic) for r in sample]))
    scores = toxicity.Scorer(weights).scores([texts[i].encode() for i in sorted(good)])
    clean = [i for i, s in zip(sorted(good), scores) if s < 0.5]
    kept = stages["toxicity"](spark, kept, SF)
    assert sorted(r.doc_id for r in kept.collect()) == clean and kept.columns == docs.columns
    groups = brute_components([texts[i] for i in clean], 5, 80)
    firsts = [i for n, i in enumerate(clean) if groups[n][1] == n]
    kept = stages["jaccard_join"](spark, kept, SF)
    assert sorted(r.doc_id for r in kept.collect()) == firsts and kept.columns == docs.columns
    rows = stages["best_fit_packing"](spark, kept, SF).collect()
    assert {r.doc_id for r in rows} == set(firsts)
    assert {(r.doc_id, r.piece, r.ids_crc32) for r in rows} == {(r.doc_id, r.piece, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect()}

"""Every registered query of the engine against its DuckDB SQL on the smallest tables."""

import oracle
import pytest

from textatlas import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(name, spark, small, duck):
    oracle.assert_same(queries.QUERIES[name](spark, small), queries.SQL[name], duck)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_has_rows(name, spark, small):
    assert queries.QUERIES[name](spark, small).count() > 0


def test_stream_gives_the_batch_rows(spark, small):
    batch = queries.kwic_matches(spark, small).select("doc_id", "search_term", "match_term", "pos")
    stream = queries.kwic_stream(spark, small).select(batch.columns)
    assert oracle.rows_of(batch.columns, batch.collect()) == oracle.rows_of(batch.columns, stream.collect())


def test_lda_is_trained_by_default_epochs(spark, small, monkeypatch):
    seen = {}
    fit = queries.lda.fit_lda
    monkeypatch.setattr(queries.lda, "fit_lda", lambda *a, **k: seen.update(k) or fit(*a, **k))
    assert queries.lda_topics(spark, small).count() > 0 and "epochs" not in seen

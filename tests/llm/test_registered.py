"""The registered corpus queries: names, columns, and equality with their SQL where there is one."""

import pytest

COLUMNS = {
    "op1_neighbours": "query_id rank vec_id score", "op2_toxicity": "doc_id held_out score predicted", "op3_archives": "page_id payload_bytes payload_digest record_type refers_to",
    "op4_suffix_tree": "doc_id held_out n_tokens n_known train_tokens base_score score", "op5_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op6_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated", "op7_mixing": "doc_id size source_size target taken", "op8_simhash": "doc_id fingerprint component_id",
    "op9_sharding": "doc_id size text_crc32 law shard slot grown_shard", "op10_quality_rules": "doc_id held_out score predicted", "pipeline": "doc_id",
}


def test_all_are_registered():
    import __spark_entry__ as e

    assert set(COLUMNS) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, sf, name):
    import __spark_entry__ as e

    df = e.queries()[name](spark, sf)
    wanted = COLUMNS[name].split()
    assert df.columns[: len(wanted)] == wanted
    assert df.count() > 0


@pytest.mark.parametrize("name", ["op3_archives", "op6_decontamination"])
def test_equal_to_sql(spark, name):
    import duckdb

    import __spark_entry__ as e

    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    rel = con.sql(e.oracle_sql()[name])
    df = e.queries()[name](spark, d)
    assert df.columns == rel.columns
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, df.collect()), key=key) == sorted(rel.fetchall(), key=key)

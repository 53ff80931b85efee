"""Every registered query of the reference's operators against SQL over the same tables."""

import pytest
from conftest import rows_of

from corpusloom.plans import catalogue

SQL = catalogue.oracle_sql()


#: Queries whose cases a larger table holds more of: they run on it as well.
LARGER = ("simhash_dedup", "exact_dedup", "ngram_leader_dedup", "near_dup_pairs", "near_dup_clusters", "sentence_chunks", "fixed_chunks", "regex_entities", "graph_health", "structural_violations")


@pytest.mark.parametrize("name", [*catalogue.queries(), *(f"{n}/larger" for n in LARGER)])
def test_query(spark, sf, oracle, name):
    if name.endswith("/larger"):
        name, sf = name.removesuffix("/larger"), "/root/testdata/sf0.01"
    df = catalogue.queries()[name](spark, sf)
    got = rows_of(df.columns, df.collect())
    if name not in SQL:
        assert df.columns
        return
    columns, rows = oracle(sf, SQL[name])
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(columns, rows) == got

import os

import duckdb
import pytest

from hornbeam import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()
#: A cross-section; the driver compares all of them.
NAMES = ["scan_label", "conj_join", "theta_join", "anti_join", "anti_join_condition", "rule_union", "disjunction", "if_then", "cut_first", "arith_mod_div", "list_split", "in_degree", "linear_recursion", "tree_lca", "bm25_topk", "vector_topk", "valid_overlaps", "as_of_join", "overlap_join", "rrf_hybrid", "apply_patch", "cascade_delete", "session",
    "chunk_paragraph", "chunk_window", "stored_bm25_topk", "stored_bm25_after_changes", "vector_topk_all", "prepared_hybrid", "node_versions", "nodes_as_of", "outbox_tail", "outbox_to_index", "json_round_trip", "fact_files"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(catalogue.ORACLES[name]).to_arrow_table() if hasattr(con, "to_arrow_table") else con.execute(catalogue.ORACLES[name]).fetch_arrow_table()
    got = catalogue.QUERIES[name](spark, SF).toArrow()
    assert sorted(got.column_names) == sorted(want.column_names)
    cols = sorted(got.column_names)
    rows = lambda t: sorted(map(repr, zip(*(t[c].to_pylist() for c in cols))))
    assert rows(got) == rows(want)

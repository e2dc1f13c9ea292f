"""Registered queries against their SQL, and names and columns of the others."""

import duckdb
import pytest

from xmseq.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_lattice": ["vec_id", "n_links", "component_id", "kept"],
    "op2_fingerprints": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op3_kneser_ney": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op4_mixing": ["doc_id", "domain", "lang", "source", "n_tokens", "uses"],
    "op5_urls": ["page_id", "host", "path", "rule", "verdict"],
    "op6_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op7_near_groups": ["doc_id", "n_shingles", "component_id", "kept"],
    "op8_language": ["doc_id", "held_out", "lang_pred", "score"],
    "op9_substrings": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op10_lines": ["doc_id", "n_lines", "n_removed", "kept_sha256"],
    "op11_phrases": ["lang", "rank", "phrase", "a", "l", "r", "n", "score"],
    "op12_suffixes": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op13_centroids": ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
}


def test_names():
    assert set(QUERIES) == set(COLUMNS)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    ours, theirs = QUERIES[name](spark, SF).toPandas(), con.execute(SQL[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns) and len(ours) > 0

    def lines(frame):
        plain = frame[columns].astype(object)
        return sorted("|".join(map(repr, row)) for row in plain.where(plain.notna(), None).to_numpy())

    assert lines(ours) == lines(theirs)
    assert ours.columns[: len(COLUMNS[name])].tolist() == COLUMNS[name]


@pytest.mark.parametrize("name", ["op2_fingerprints", "op3_kneser_ney", "op6_packing", "op8_language"])
def test_whole_table(spark, name):
    found = QUERIES[name](spark, SF)
    assert found.columns[: len(COLUMNS[name])] == COLUMNS[name]
    table, key = ("embeddings", "vec_id") if name == "op1_lattice" else ("documents", "doc_id")
    ids = spark.read.parquet(f"{SF}/{table}.parquet").select(key)
    assert found.select(key).distinct().count() == ids.distinct().count()

"""Every registered query with SQL against DuckDB: columns, types and rows."""

import pytest

from gleaner.plans.adapters import HASHES
from gleaner.plans.queries import ORACLES, QUERIES

TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "DATE": "date"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    columns = sorted(df.columns)
    rows = [tuple(r[c] for c in columns) for r in df.collect()]
    if name not in ORACLES:
        assert columns
        return
    rel = oracle.sql(ORACLES[name])
    assert sorted(rel.columns) == columns
    assert {c: TYPES.get(str(t), str(t)) for c, t in zip(rel.columns, rel.types, strict=True)} == dict(df.dtypes)
    at = [rel.columns.index(c) for c in columns]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(rows, key=key) == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=key)


@pytest.fixture(scope="module")
def other_embeddings(tmp_path_factory):
    """2,400 vectors of two labels, some of the hash of another one, and two of a third label."""
    import duckdb
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    rng = np.random.default_rng(4)
    label = np.arange(2400) // 3 % 2
    v = rng.normal(size=(2400, 64)) + np.where(label[:, None] == np.arange(64) % 2, 0.2, 0)
    v[1::7] = v[: len(v[1::7])] * 2
    label[[600, 603]] = 2
    where = tmp_path_factory.mktemp("other")
    pq.write_table(pa.table({"vec_id": np.arange(2400), "embedding": pa.array(list(v.astype(np.float32)), pa.list_(pa.float32())), "label": label.astype(np.int32)}), where / "embeddings.parquet")
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{where}/embeddings.parquet'")
    return str(where), c


def test_all_items_of_a_tag_are_suggested(spark, other_embeddings):
    folder, oracle = other_embeddings
    want = oracle.sql(ORACLES["centroid_suggestions"]).fetchall()
    assert max(sum(r[1] == tag for r in want) for tag in (0, 1)) > 500 and any(r[1] == 2 for r in want)
    assert sorted(map(tuple, QUERIES["centroid_suggestions"](spark, folder).select("item", "tag", "score").collect())) == sorted(want)


def test_scan_pairs_different_hashes_only(spark, other_embeddings):
    folder, oracle = other_embeddings
    want = oracle.sql(ORACLES["duplicate_scan"]).fetchall()
    assert oracle.sql(f"WITH {HASHES} SELECT count(*) - count(DISTINCT hash) FROM hashes").fetchall()[0][0] > 200
    assert sorted(map(tuple, QUERIES["duplicate_scan"](spark, folder).select("a", "b", "kind", "distance").collect())) == sorted(want)

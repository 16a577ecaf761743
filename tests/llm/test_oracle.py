"""The SQL of the operators that have it, over tables with hard rows, against the registered queries."""

import duckdb
import pytest

from wideprep.llm import queries
from wideprep.llm.oracle import _CRC_TABLE, _crc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TURNS = "conv_id long, turn long, role string, text string"


def both(spark, folder, table, rows, schema, name):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    got = queries.REGISTRY[name](spark, str(folder))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    want = con.execute(queries.ORACLE[name])
    order = [d[0] for d in want.description]
    assert sorted(order) == sorted(got.columns)
    return sorted((tuple(r[c] for c in order) for r in got.collect()), key=str), sorted(want.fetchall(), key=str)


def test_crc32_in_sql():
    import zlib

    for text in ("0", "-7", "1234567890123"):
        got = duckdb.execute(f"WITH {_CRC_TABLE.strip()} SELECT {_crc('$1')} FROM crc_table", [text]).fetchone()[0]
        assert got == zlib.crc32(text.encode())


@pytest.mark.parametrize("n", [0, 1, 16, 17, 300])
def test_merkle_manifest(spark, tmp_path, n):
    rows = [(i, f"Text {i} É" if i % 7 else None, "en" if i % 3 else None, (None, "a", "b", "É")[i % 4 if i % 5 else 1], i) for i in range(n)]
    rows += [(3, "Text 3", "en", "a", None), (3, "Text 3", "en", "a", None), (None, "X", "en", "z", 1)] if n > 1 else []
    got, want = both(spark, tmp_path, "documents", rows, DOCS, "op13_merkle_manifest")
    assert got == want and len(got) == len(rows)


def test_prefix_trie(spark, tmp_path):
    rows = [(c, t, "user" if t % 2 else None, f"turn {t} {c // 10 if t > 1 else 0}" if t != 2 else None) for c in range(-6, 40) for t in range(c % 8 + 1)]
    rows += [(2, None, "user", "first"), (2, 1, "user", "tie"), (2, 1, "user", "tie"), (None, 0, "user", "x"), (1003, 0, "user", "é")]
    got, want = both(spark, tmp_path, "conversations", rows, TURNS, "op11_prefix_trie")
    assert got == want and got


def test_prefix_trie_of_no_rows(spark, tmp_path):
    assert both(spark, tmp_path, "conversations", [], TURNS, "op11_prefix_trie") == ([], [])

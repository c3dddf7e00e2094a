import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["p5_found", "p5_orphan_report", "bio_tags", "chunk_documents", "micro_prf1", "make_split", "doc_entities", "unicode_unescape"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("distemist_raw_splits", "subtrack1_entities", "text_files"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    got = entry.queries()[name](spark, FOLDER)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(f'\"{c}\"' for c in columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(str, want))


def test_core_queries_without_the_optional_imports():
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; print(' '.join(e.queries()))"
    names = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(entry.__file__).parent).stdout.split()
    assert "micro_prf1" in names and "p5_found" in names and "p1_found" not in names

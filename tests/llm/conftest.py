import duckdb
import pyarrow.parquet as pq
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def docs_rows():
    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


@pytest.fixture
def sql_rows():
    def run(sql, **tables):
        con = duckdb.connect()
        for name in ("documents", "pages"):
            con.execute(f"create view {name} as select * from read_parquet('{SF}/{name}.parquet')")
        out = con.execute(sql)
        names = [d[0] for d in out.description]
        return [dict(zip(names, r, strict=True)) for r in out.fetchall()]

    return run

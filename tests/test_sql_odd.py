"""Queries against their SQL on small tables that hold what the driver's smallest ones do not."""

import duckdb
import pytest

from foliospark import registry


@pytest.fixture
def both(spark, tmp_path):
    """both(name, **tables): the rows of query and SQL over tables given as DataFrames, sorted."""

    def run(name, **tables):
        c = duckdb.connect()
        for table, df in tables.items():
            df.coalesce(1).write.parquet(str(tmp_path / f"{table}.parquet"))
            c.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
        df = registry.QUERIES[name](spark, str(tmp_path))
        cursor = c.execute(registry.ORACLES[name])
        names = [x[0] for x in cursor.description]
        return sorted(map(tuple, df.select(*names).collect()), key=repr), sorted(cursor.fetchall(), key=repr)

    return run


def test_same_origins(spark, both):
    urls = ["http://a.example/1", "https://A.example/2#top", "https://a.example:8080/3", "https://b.example/4", "https://u:p@b.example/5", "HTTP://a.example", "/6", None, "http://a.example/7"]
    got, want = both("same_origins", pages=spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"))
    assert got == want and got[:3] == [(0, True), (1, True), (2, False)]


@pytest.mark.parametrize(("a", "b", "same"), [("http://h/1", "https://h/1", False), ("http://h/1", "http://H:80/2", True), ("http://h/1", "http://h:8080/1", False), ("/1", "/1", False)])
def test_an_origin_has_scheme_and_port(spark, a, b, same):
    from pyspark.sql import functions as F

    from foliospark.functions import urls as U

    assert spark.range(1).select(U.same_origin(F.lit(a), F.lit(b))).first()[0] is same


def test_image_headers(spark, both):
    rows = [(order, line, part, supplier) for order in range(6) for line in (3, 4) for part in (4, 58, 3058) for supplier in (1, 2434, 5837, 2676)]
    got, want = both("image_headers", lineitem=spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long"))
    assert got == want and any(r[2] == "gif" and r[4] == 59 for r in got)


@pytest.mark.parametrize("name", ["selected_counts", "range_segments"])
def test_long_books(spark, both, name):
    docs = spark.range(20_100).selectExpr("id + 7 as doc_id", "if(id < 15, 'b', 'a') as source")
    got, want = both(name, documents=docs)
    assert got == want


def test_an_open_range_ends_with_the_items(spark):
    from foliospark.operators import links as K

    items = spark.createDataFrame([("a", 2), ("a", 5), ("a", 20_000), ("a", 20_001), ("b", 3_000_000_000)], "book string, at long")
    got = [(r.book, r.at, r.place) for r in K.select_ranges(spark, items, "book", "at", "5,19999-").orderBy("book", "place").collect()]
    assert got == [("a", 5, 1), ("a", 20_000, 2), ("a", 20_001, 3), ("b", 3_000_000_000, 1)]


def test_stream_settled(spark, both):
    rows = [(None if order == 4 else order * 2**40, line, line, 1, "F" if (order + line) % 5 else "O", "NRA"[(order * line) % 3], float(line)) for order in range(12) for line in range(1, 1 + order)]
    got, want = both("stream_settled", lineitem=spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_linestatus string, l_returnflag string, l_quantity double"))
    assert got == want and any(r[0] is None for r in got)

import duckdb
import pytest

import __spark_entry__ as entry


def both(spark, folder, name, **tables):
    """Rows of the query and of its SQL over the same files."""
    con = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got = entry.queries()[name](spark, str(folder))
    found = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    return sorted((tuple(r) for r in got.select(*names).collect()), key=str), sorted(found.fetchall(), key=str)


LABELS = "doc_id long, quality int, toxic int"
PAGES = "page_id long, url string, _host string, good_rate string, upper string"


def pages():
    hosts = [f"h{k % 7}.shop{k % 3}.co.uk" for k in range(60)] + [f"x{k % 5}.org.uk" for k in range(20)] + ["co.uk", "uk", "a.com.au", "b.a.com.au", "Example.COM", "www.example.com", "one.net"] * 3
    rows = [(k, f"https://{h}/en/{k}", "x", "x", "x") for k, h in enumerate(hosts)]
    rows += [rows[0], rows[0], (None, "https://h1.shop1.co.uk/", "x", "x", "x"), (None, None, None, None, None), (900, None, "x", None, None), (901, "no scheme", None, "x", None)]
    labels = [(k, int(k % 7 > 2), 0) for k in range(0, 100, 2)] + [(0, 0, 0), (4, None, 0), (6, 5, 0), (None, 1, 0)]
    return rows, labels


def test_url_reputation(spark, tmp_path):
    rows, labels = pages()
    got, want = both(spark, tmp_path, "op3_url_reputation", pages=(rows, PAGES), labels=(labels, LABELS))
    assert len(got) == len(rows) and got == want
    assert len({r[-1] for r in want}) > 5


@pytest.mark.parametrize("empty", ["pages", "labels", "both"])
def test_url_reputation_of_empty_tables(spark, tmp_path, empty):
    rows, labels = pages()
    rows, labels = ([] if empty != "labels" else rows), ([] if empty != "pages" else labels)
    got, want = both(spark, tmp_path, "op3_url_reputation", pages=(rows, PAGES), labels=(labels, LABELS))
    assert got == want and len(got) == len(rows)


def test_snapshots(spark, tmp_path):
    schema = "conv_id long, turn long, role string, text string, _k string, _n string, part string, _block string"
    logged = {1: [("user", "hi")], 2: [("user", "hi"), ("bot", None)], 3: [("user", "hi"), ("bot", "")], 4: [("user", "hi"), ("bot", ""), (None, "z")], 5: [("", "z")], 6: [(None, "z")], 7: [("", "z")]}
    rows = [(c, t, r, x, "x", None, "p", "b") for c, turns in logged.items() for t, (r, x) in enumerate(turns)]
    rows += [rows[0], (8, None, "user", "n", "a", "b", "c", "d"), (8, 3, "user", "hi", "a", "b", "c", "d"), (None, 1, "user", "q", "a", "b", "c", "d"), (None, None, None, None, None, None, None, None)]
    rows += [(9, 5, "user", f"tied {k:05}", "x", "x", "x", "x") for k in range(3000)] + [(10, 5, "user", f"tied {k:05}", "y", "y", "y", "y") for k in range(2999)]
    got, want = both(spark, tmp_path, "op2_snapshot_collapse", conversations=(rows, schema))
    assert got == want and {r[0] for r in want} == {2, 4, 5, 6, 8, 9, None}


def test_snapshots_of_no_rows(spark, tmp_path):
    assert both(spark, tmp_path, "op2_snapshot_collapse", conversations=([], "conv_id long, turn long, role string, text string")) == ([], [])

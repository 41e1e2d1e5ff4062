import duckdb
import pytest

import __spark_entry__ as entry
from blockloom.llm import chat


@pytest.fixture
def long(spark):
    """Long conversations: by number, without numbers, of one number, without id; a snapshot of each."""
    rows = [(1, n, "user", f"t{n}") for n in range(3000)] + [(2, n, "user", f"t{n}") for n in range(2500)]
    rows += [(3, None, "user", f"n{n:05}") for n in range(5000)] + [(4, None, "user", f"n{n:05}") for n in range(4000)]
    rows += [(5, 7, "a" if n % 2 else None, f"s{n}" if n else None) for n in range(5000)] + [(None, 5000 + n // 3, "user", f"x{n}") for n in range(4000)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)


def test_query_like_its_sql_at_every_length(spark, long, tmp_path):
    long.write.parquet(str(tmp_path / "conversations.parquet"))
    got = [(r.conv_id, r.part, r.n_turns, r.rendered) for r in entry.queries()["op2_snapshot_collapse"](spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()["op2_snapshot_collapse"]).fetchall()
    assert {r[0] for r in want} == {1, 3, 5, None}
    assert sorted(got, key=str) == sorted(want, key=str)


def test_no_part_has_more_turns_than_a_block(long):
    sizes = {}
    for r in chat.collapse_and_render(long).collect():
        sizes.setdefault(r.conv_id, {})[r.part] = r.rendered.count(chat.OPEN)
    assert {k: [v[p] for p in sorted(v)] for k, v in sizes.items()} == {1: [1024, 1024, 952], 3: [1024] * 4 + [904], 5: [1024] * 4 + [904], None: [1024] * 3 + [928]}

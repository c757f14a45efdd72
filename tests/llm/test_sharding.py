import hashlib
from collections import Counter

import duckdb
import pytest

from creditmill.llm import sharding


def slow_table(shards, size):
    orders = []
    for s in shards:
        h = hashlib.md5(s.encode()).hexdigest()
        offset, step = int(h[:8], 16) % size, int(h[8:16], 16) % (size - 1) + 1
        orders.append([(offset + j * step) % size for j in range(size)])
    table = {}
    while len(table) < size:
        for n, order in enumerate(orders):
            if len(table) < size:
                table[next(slot for slot in order if slot not in table)] = n
    return [table[i] for i in range(size)]


@pytest.mark.parametrize("shards, size", [(("a",), 2), (("a", "b", "c"), 7), (tuple("abcdefg"), 211)])
def test_turns(shards, size):
    assert sharding.fill_table(shards, size) == slow_table(shards, size)


def test_balance_and_few_moves():
    table = sharding.fill_table()
    counts = Counter(table)
    assert max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.fill_table(sharding.SHARDS[:-1])
    moved = sum(a != b for a, b in zip(table, fewer) if a != len(sharding.SHARDS) - 1)
    assert moved < 0.2 * len(table)


@pytest.mark.parametrize("shards, size", [((), 7), (("a", "a"), 7), (("a",), 8), (tuple("abc"), 2)])
def test_refused_tables(shards, size):
    with pytest.raises(ValueError):
        sharding.fill_table(shards, size)


def test_rows_match_the_oracle(spark):
    ids = [1, 2, 2, None, -5, 10**15]
    docs = spark.createDataFrame([(i, "x") for i in ids], "doc_id bigint, shard_slot string")
    placed = sharding.place(docs, "doc_id")
    assert placed.columns == ["doc_id", "shard_slot", "shard_number", "shard_name"]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?)", [(i,) for i in ids])
    assert sorted(map(tuple, placed.collect()), key=str) == sorted(con.execute(sharding.oracle_sql()).fetchall(), key=str)
    assert sharding.place(docs.limit(0), "doc_id").count() == 0
    assert "Python" not in placed._jdf.queryExecution().executedPlan().toString()


def test_written_shards(spark, tmp_path):
    docs = spark.createDataFrame([(7, f"text {i}") for i in range(50)], "doc_id bigint, text string")
    sharding.write_shards(sharding.place(docs, "doc_id"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 50

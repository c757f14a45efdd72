import hashlib
import random
import re

import duckdb
import pytest

from creditmill.llm import contamination


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def slow(docs, items):
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for item, passage in items:
            p = words(passage)
            for s in range(max(1, len(p) - 9) if p else 0):
                window = p[s : s + 10]
                for at in range(len(w) - len(window) + 1):
                    if w[at : at + len(window)] == window:
                        hit.update(range(at, at + len(window)))
                        found.add(item)
        ids = ",".join(sorted(str(i) for i in found))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


PASSAGE = "The quick Brown fox, jumps over THE lazy dog; while été arrives 42 times"
ITEMS = [(1, PASSAGE), (2, "short item"), (3, None), (4, ""), (10, "the the the the the the the the the the the"), (2, "Short, ITEM")]
DOCS = [
    (1, "before " + PASSAGE.upper().replace("ÉTÉ", "été") + " after"), (2, "SHORT\nitem short item short"), (3, None), (4, " .,- "),
    (5, "the " * 15), (6, "quick brown fox jumps over the lazy dog while"), (6, PASSAGE), (None, "a short item"),
    (7, PASSAGE.replace("été", "ÉTÉ")), (8, "item short"), (9, "x " * 3000 + "short item"), (11, "Kelvin K short item İ"),
]


@pytest.mark.parametrize("bound", [None, -1])
def test_rows_match_brute_force(spark, monkeypatch, bound):
    if bound is not None:  # also the join that shuffles
        monkeypatch.setattr(contamination, "BROADCAST_BYTES", -1)
    docs = spark.createDataFrame([(i, t, "x") for i, t in DOCS], "doc_id bigint, text string, word string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    found = sorted(map(tuple, contamination.find_passages(docs, items).collect()), key=str)
    assert found == slow(DOCS, ITEMS)


def test_oracle_matches_brute_force():
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", DOCS)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", ITEMS)
    assert sorted(con.execute(contamination.oracle_sql()).fetchall(), key=str) == slow(DOCS, ITEMS)


def test_random_texts(spark):
    r = random.Random(6)
    items = [(i, " ".join(r.choice("abc") for _ in range(r.randint(0, 14)))) for i in range(12)]
    docs = [(i, " ".join(r.choice("abcd") for _ in range(r.randint(0, 60)))) for i in range(40)]
    docs += [(100 + i, f"x {text} y") for i, text in items]
    found = contamination.find_passages(
        spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    )
    assert sorted(map(tuple, found.collect()), key=str) == slow(docs, items)


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert contamination.find_passages(docs.limit(0), items).count() == 0
    none = contamination.find_passages(docs, items.limit(0)).collect()
    assert len(none) == len(DOCS) and not any(r.contaminated for r in none)


def test_dropping(spark):
    docs = spark.createDataFrame([(i, t, 0) for i, t in DOCS], "doc_id bigint, text string, carried int")
    kept = contamination.drop_contaminated(docs, spark.createDataFrame(ITEMS, "item_id bigint, text string"))
    clean = [(i, t, 0) for (i, t) in DOCS if not slow([(i, t)], ITEMS)[0][5]]
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(clean, key=str)
    assert (6, "quick brown fox jumps over the lazy dog while", 0) in clean


def test_main_path_runs_no_python(spark):
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string")
    plan = contamination.find_passages(docs, spark.createDataFrame(ITEMS, "item_id bigint, text string"))
    assert not re.search("Python|Pandas|Arrow", plan._jdf.queryExecution().executedPlan().toString())

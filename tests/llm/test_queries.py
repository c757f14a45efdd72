"""Registered queries: their columns, their oracles and whole tables."""

import os
import sys

import pytest

ROOT = os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", "..")
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

import __spark_entry__ as contract  # noqa: E402
from check_oracles import compare, connect  # noqa: E402
from creditmill.llm import queries  # noqa: E402
from test_spelling import one_edit, slow_words  # noqa: E402

COLUMNS = {
    "op1_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op2_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op4_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op6_pii": {
        "doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint",
        "base_sha256": "string", "spans": "string",
    },
    "op8_embedding_duplicates": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op9_decontamination": {
        "doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string",
        "contaminated": "boolean",
    },
    "op12_line_dedup": {"doc_id": "bigint", "n_lines": "bigint", "n_dropped": "bigint", "kept_sha256": "string"},
    "op13_centroids": {
        "vec_id": "bigint", "cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint",
        "centroid_sha256": "string",
    },
}


def test_one_query_per_operator():
    numbers = sorted(int(n.split("_")[0].removeprefix("op")) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(contract.queries())


@pytest.mark.parametrize("name", COLUMNS)
def test_contract_columns_and_all_rows(spark, sf_dir, name, monkeypatch):
    monkeypatch.setattr(queries.toxicity, "STEPS", 20)
    found = queries.QUERIES[name](spark, sf_dir)
    kinds = dict(found.dtypes)
    assert {c: kinds[c] for c in COLUMNS[name]} == COLUMNS[name]
    table = "embeddings" if name.startswith(("op8", "op13")) else "documents"
    assert found.count() == spark.read.parquet(f"{sf_dir}/{table}.parquet").count()


def test_spelling_columns_and_roots(spark, sf_dir):
    found = queries.op11_spelling_variants(spark, sf_dir)
    assert found.dtypes == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]
    rows = {r.word: r for r in found.collect()}
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert {w: r.n for w, r in rows.items()} == slow_words(texts)
    for r in rows.values():
        if r.form is None:
            assert r.root == r.word and r.form_n is None
        else:
            assert one_edit(r.word, r.form) and rows[r.form].n == r.form_n >= 2 * r.n and r.root == rows[r.form].root and r.n_near > 0
    # All words one edit apart share a word with one code point less, or are one.
    near = {}
    for w in rows:
        for key in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}:
            near.setdefault(key, []).append(w)
    pairs = {(a, b) for group in near.values() for a in group for b in group if a < b and one_edit(a, b)}
    counts = dict.fromkeys(rows, 0)
    for pair in pairs:
        for w in pair:
            counts[w] += 1
    assert {w: r.n_near for w, r in rows.items()} == counts


@pytest.mark.parametrize("name", queries.ORACLES)
def test_query_matches_oracle(spark, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    result = connect(sf_dir).execute(queries.ORACLES[name])
    columns = [c[0] for c in result.description]
    assert compare(df.collect(), df.columns, result.fetchall(), columns) == ""


def test_simhash_links_of_a_whole_table(spark, sf_dir):
    rows = queries.op2_simhash(spark, sf_dir).collect()
    first = {}
    for r in rows:
        first.setdefault(int(r.fingerprint, 16), []).append(r)
    prints = list(first)
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    low = {}
    for r in rows:
        k = find(int(r.fingerprint, 16))
        low[k] = min(low.get(k, r.doc_id), r.doc_id)
    assert all(r.component_id == low[find(int(r.fingerprint, 16))] for r in rows)

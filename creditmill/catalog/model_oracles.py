"""The fitted models and near-duplicate chunks in SQL, step by step, for DuckDB."""

from __future__ import annotations

from creditmill.catalog.oracles import building_blocks
from creditmill.learning.design import INPUTS
from creditmill.learning.trees import POISSON

_COLUMNS = [f"CAST({name} AS DOUBLE) AS {name}" for name in INPUTS]

Step = tuple[str, str]


def _with(steps: list[Step], select: str) -> str:
    return "WITH " + ",\n".join(f"{name} AS MATERIALIZED ({text})" for name, text in steps) + f"\n{select}"


_RAW = f"SELECT row_no, CAST(loan_status AS INTEGER) AS y, {', '.join(_COLUMNS)} FROM features"
#: The stored applicants, in the types of their columns.
_STORED = f"SELECT id AS row_no, CAST(loan_status AS INTEGER) AS y, {', '.join(_COLUMNS)} FROM applicants"


def _standard(rows: str = _RAW) -> list[Step]:
    scaled = ", ".join(f"coalesce((f.{n} - m.m_{n}) / m.d_{n}, 0) AS {n}" for n in INPUTS)
    return [
        ("every_row", building_blocks(rows)),
        (
            "moments",
            "SELECT "
            + ", ".join(f"avg({n}) AS m_{n}, coalesce(nullif(stddev_pop({n}), 0), 1) AS d_{n}" for n in INPUTS)
            + " FROM every_row WHERE y IN (0, 1)",
        ),
        ("z", f"SELECT row_no, y, {scaled} FROM every_row f, moments m"),
        ("train", "SELECT * FROM z WHERE y IN (0, 1)"),
    ]


# One row per row and input.
_LONG = ("long_z", " UNION ALL ".join(f"SELECT row_no, y, {i} AS input, '{n}' AS name, {n} AS z FROM z" for i, n in enumerate(INPUTS)))
_BAYES = (
    "bayes",
    "SELECT y, input, name, count(*) AS n, count(*)::DOUBLE / (SELECT count(*) FROM train) AS prior, avg(z) AS mean, "
    "avg(z * z) - avg(z) * avg(z) + 1e-9::DOUBLE AS variance FROM long_z WHERE y IN (0, 1) GROUP BY y, input, name",
)
_ODDS = (
    "odds",
    "SELECT row_no, any_value(l.y) AS y, ln(any_value(b1.prior) / any_value(b0.prior)) + sum(0.5::DOUBLE * ln(b0.variance / b1.variance) "
    "+ (z - b0.mean) * (z - b0.mean) / (2 * b0.variance) - (z - b1.mean) * (z - b1.mean) / (2 * b1.variance)) AS log_odds "
    "FROM long_z l JOIN bayes b0 ON b0.input = l.input AND b0.y = 0 JOIN bayes b1 ON b1.input = l.input AND b1.y = 1 GROUP BY row_no",
)
_BINS = (
    "bins",
    "SELECT row_no, input, CAST(greatest(0, least(31, floor((z + 3.0::DOUBLE) / 6.0::DOUBLE * 32))) AS INTEGER) AS bin FROM long_z",
)


def _md5(text: str) -> str:
    return f"CAST(concat('0x', substr(md5({text}), 1, 8)) AS BIGINT)"


def _grown(name: str, parts: str, depth: int, ridge: int = 0, inputs_per_node: int | None = None) -> list[Step]:
    """Level by level; leaves ``<name>_nodes`` and ``<name>_leaf`` (row_no, tree, value)."""
    steps = [(f"{name}_parts", parts), (f"{name}_at0", f"SELECT row_no, tree, 1 AS node FROM {name}_parts")]
    chosen = "true"
    if inputs_per_node is not None:
        order = _md5("concat('inputs|42|', h.tree, '-', h.node, '-', h.input)")
        chosen = f"dense_rank() OVER (PARTITION BY h.tree, h.node ORDER BY {order}, h.input) <= {inputs_per_node}"
    for level in range(depth):
        steps.append(
            (
                f"{name}_h{level}",
                f"SELECT tree, node, input, bin, count(*) AS rows, sum(weight) AS weight, sum(target) AS target "
                f"FROM {name}_at{level} JOIN {name}_parts USING (row_no, tree) JOIN bins USING (row_no) GROUP BY ALL",
            )
        )
        run = ", ".join(
            f"sum({a}) OVER (PARTITION BY tree, node, input ORDER BY bin) AS l_{a}, sum({a}) OVER (PARTITION BY tree, node, input) AS a_{a}"
            for a in ("rows", "weight", "target")
        )
        gain = (
            f"round(l_target * l_target / (l_weight + {ridge}) + (a_target - l_target) * (a_target - l_target) / (a_weight - l_weight + {ridge}) "
            f"- a_target * a_target / (a_weight + {ridge}), 9)"
        )
        steps.append(
            (
                f"{name}_b{level}",
                f"SELECT tree, node, input, bin, CASE WHEN gain > 0 THEN gain END AS gain, a_rows, a_weight, a_target FROM ("
                f"SELECT *, CASE WHEN l_rows >= 20 AND a_rows - l_rows >= 20 AND chosen THEN {gain} END AS gain FROM ("
                f"SELECT *, {chosen} AS chosen, {run} FROM {name}_h{level} h) c) g "
                "QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY CASE WHEN gain > 0 THEN gain END DESC NULLS LAST, input, bin) = 1",
            )
        )
        steps.append(
            (
                f"{name}_at{level + 1}",
                f"SELECT row_no, tree, 2 * node + CASE WHEN b.bin <= s.bin THEN 0 ELSE 1 END AS node FROM {name}_at{level} "
                f"JOIN {name}_b{level} s USING (tree, node) JOIN bins b USING (row_no, input) WHERE s.gain IS NOT NULL",
            )
        )
    value = f"a_target / (a_weight + {ridge})"
    steps.append(
        (
            f"{name}_b{depth}",
            f"SELECT tree, node, NULL AS input, NULL AS bin, NULL AS gain, count(*) AS a_rows, sum(weight) AS a_weight, sum(target) AS a_target "
            f"FROM {name}_at{depth} JOIN {name}_parts USING (row_no, tree) GROUP BY tree, node",
        )
    )
    every = " UNION ALL ".join(
        f"SELECT tree, node, CASE WHEN gain IS NOT NULL THEN input END AS input, CASE WHEN gain IS NOT NULL THEN bin END AS bin, gain, "
        f"a_rows AS rows, a_weight AS weight, {value} AS value FROM {name}_b{level}"
        for level in range(depth + 1)
    )
    leaves = " UNION ALL ".join(
        f"SELECT row_no, tree, {value} AS value FROM {name}_at{level} JOIN {name}_b{level} USING (tree, node) WHERE gain IS NULL"
        for level in range(depth + 1)
    )
    return [*steps, (f"{name}_nodes", every), (f"{name}_leaf", leaves)]


def _nodes(tree: str, nodes: str) -> str:
    return (
        f"SELECT CAST({tree} AS INTEGER) AS tree, CAST(node AS INTEGER) AS node, CAST(rows AS BIGINT) AS rows, round(CAST(weight AS DOUBLE), 6) AS weight, "
        f"round(value, 6) + 0 AS value, list_extract([{', '.join(repr(n) for n in INPUTS)}], input + 1) AS input, CAST(bin AS INTEGER) AS bin, "
        f"round(gain, 6) AS gain FROM {nodes}"
    )


_ONE_TREE = "SELECT row_no, 0 AS tree, 1.0::DOUBLE AS weight, y::DOUBLE AS target FROM train"
_DRAW = "CASE " + " ".join(f"WHEN u < {p!r}::DOUBLE THEN {k}" for k, p in enumerate(POISSON)) + " ELSE 8 END"
_FOREST = (
    f"SELECT row_no, tree, {_DRAW}::DOUBLE AS weight, ({_DRAW} * y)::DOUBLE AS target FROM ("
    f"SELECT row_no, y, tree, ({_md5("concat('bootstrap|', tree, '|', row_no)")} + 0.5::DOUBLE) / 4294967296::DOUBLE AS u "
    "FROM train, (SELECT unnest(range(3)) AS tree) t) d WHERE weight > 0"
)


def _boosted(rounds: int, depth: int) -> list[Step]:
    steps: list[Step] = [
        ("f0", "SELECT row_no, y, ln(s / (1 - s)) AS f FROM train, (SELECT avg(y) AS s FROM train) a"),
    ]
    for r in range(rounds):
        steps += _grown(
            f"g{r}", f"SELECT row_no, 0 AS tree, p * (1 - p) AS weight, y - p AS target FROM (SELECT *, 1 / (1 + exp(-f)) AS p FROM f{r}) q", depth, 1
        )
        steps.append((f"f{r + 1}", f"SELECT row_no, y, f + 0.3::DOUBLE * value AS f FROM f{r} JOIN g{r}_leaf USING (row_no)"))
    return steps


_ALL_NODES = " UNION ALL ".join(f"SELECT {r} AS round, * FROM g{r}_nodes" for r in range(3))
_LOSSES = " UNION ALL ".join(
    f"SELECT CAST({r} AS INTEGER) AS round, round(avg(ln(1 + exp(-abs(f))) + greatest(f, 0) - y * f), 6) AS log_loss FROM f{r}" for r in range(4)
)
# Per fold, the model of the rows of all other folds, fitted on its own.
_FOLDED = [
    ("folded", f"SELECT l.*, CAST({_md5("concat('fold|42|', row_no)")} % 5 AS INTEGER) AS fold FROM long_z l WHERE y IN (0, 1)"),
    (
        "fold_bayes",
        "SELECT fold, y, input, count(*) AS n, avg(z) AS mean, avg(z * z) - avg(z) * avg(z) + 1e-9::DOUBLE AS variance FROM ("
        "SELECT f.fold, r.y, r.input, r.z FROM (SELECT DISTINCT fold FROM folded) f JOIN folded r ON r.fold <> f.fold) o GROUP BY fold, y, input",
    ),
    (
        "fold_odds",
        "SELECT l.fold, row_no, any_value(l.y) AS y, round(1 / (1 + exp(-(ln(any_value(b1.n)::DOUBLE / any_value(b0.n)) + sum(0.5::DOUBLE * ln(b0.variance / b1.variance) "
        "+ (z - b0.mean) * (z - b0.mean) / (2 * b0.variance) - (z - b1.mean) * (z - b1.mean) / (2 * b1.variance))))), 9) AS p "
        "FROM folded l JOIN fold_bayes b0 ON b0.input = l.input AND b0.y = 0 AND b0.fold = l.fold "
        "JOIN fold_bayes b1 ON b1.input = l.input AND b1.y = 1 AND b1.fold = l.fold GROUP BY l.fold, row_no",
    ),
    (
        "cells",
        "SELECT fold, count(*) AS rows, count(*) FILTER (y = 1 AND p >= 0.5) AS tp, count(*) FILTER (y = 0 AND p >= 0.5) AS fp, "
        "count(*) FILTER (y = 1 AND p < 0.5) AS fn, count(*) FILTER (y = 0 AND p < 0.5) AS tn FROM fold_odds GROUP BY fold",
    ),
    (
        "fold_auc",
        "SELECT fold, (sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0::DOUBLE) "
        "/ (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) AS auc FROM (SELECT fold, y, rank() OVER (PARTITION BY fold ORDER BY p) "
        "+ (count(*) OVER (PARTITION BY fold, p) - 1) / 2.0::DOUBLE AS rk FROM fold_odds) r GROUP BY fold",
    ),
]
_LINEAR = (
    "linear",
    "SELECT b0.input, b0.name, (b1.mean - b0.mean) / v AS c, -(b1.mean * b1.mean - b0.mean * b0.mean) / (2 * v) AS i FROM ("
    "SELECT input, sum(n * variance) / sum(n) AS v FROM bayes GROUP BY input) p JOIN bayes b0 ON b0.input = p.input AND b0.y = 0 "
    "JOIN bayes b1 ON b1.input = p.input AND b1.y = 1",
)

_SHINGLED = [
    ("chunk_words", building_blocks(r"SELECT id, list_filter(string_split_regex(lower(chunk_text), '[ \t\n\r\f]+'), lambda w: w <> '') AS w FROM chunks")),
    (
        "sets",
        "SELECT id, list_sort(list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, greatest(len(w) - 4, 1) + 1)])) AS s FROM chunk_words WHERE len(w) > 0",
    ),
    ("classed", "SELECT id, min(id) OVER (PARTITION BY s) AS class_id, count(*) OVER (PARTITION BY s) AS class_size, s FROM sets"),
    ("held", "SELECT id, len(s) AS n, unnest(s) AS shingle FROM classed WHERE id = class_id"),
]

def _scores(key: str, model: str) -> str:
    return (
        f"SELECT {key}, {model}, CAST(p AS DECIMAL(6,4)) AS approval_probability, CASE WHEN p >= 0.5 THEN 'approved' ELSE 'rejected' END AS predicted_outcome, "
        "CASE WHEN 1.0::DOUBLE - p >= 0.8::DOUBLE THEN 'high' WHEN 1.0::DOUBLE - p >= 0.5::DOUBLE THEN 'medium' ELSE 'low' END AS risk_tier FROM ("
        "SELECT row_no, 'naive_bayes' AS model_id, round(1 / (1 + exp(-log_odds)), 4) AS p FROM odds UNION ALL "
        "SELECT row_no, 'decision_tree', round(value, 4) FROM t_leaf) s"
    )


def _best(scores: str, key: str) -> str:
    return (
        f"SELECT query_id, {key}, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id "
        f"ORDER BY round(score, 12) DESC, {key}) AS INTEGER) AS rank FROM ({scores}) s QUALIFY rank <= 5"
    )


ORACLES = {
    "train_naive_bayes": _with(
        [*_standard(), _LONG, _BAYES],
        'SELECT y AS class, name AS input, n AS rows, round(prior, 6) AS prior, round(mean, 6) AS mean, round(variance, 6) AS variance FROM bayes',
    ),
    "cross_validated_bayes": _with(
        [*_standard(), _LONG, *_FOLDED],
        "SELECT fold, rows, round((tp + tn)::DOUBLE / rows, 6) AS accuracy, round(tp::DOUBLE / nullif(tp + fp, 0), 6) AS precision, "
        "round(tp::DOUBLE / nullif(tp + fn, 0), 6) AS recall, round((coalesce(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0) * (tp + fn) "
        "+ coalesce(2 * tn::DOUBLE / nullif(2 * tn + fp + fn, 0), 0) * (fp + tn)) / rows, 6) AS f1_weighted, round(auc, 6) AS auc "
        "FROM cells JOIN fold_auc USING (fold)",
    ),
    "train_decision_tree": _with([*_standard(), _LONG, _BINS, *_grown("t", _ONE_TREE, 3)], _nodes("tree", "t_nodes")),
    "train_random_forest": _with([*_standard(), _LONG, _BINS, *_grown("t", _FOREST, 2, 0, 4)], _nodes("tree", "t_nodes")),
    "train_gradient_boosting": _with([*_standard(), _LONG, _BINS, *_boosted(3, 2)], _nodes("round", f"({_ALL_NODES}) n")),
    "boosting_losses": _with([*_standard(), _LONG, _BINS, *_boosted(3, 2)], _LOSSES),
    "batch_scores": _with([*_standard(), _LONG, _BAYES, _ODDS, _BINS, *_grown("t", _ONE_TREE, 3)], _scores("row_no", "model_id")),
    "stored_predictions": _with(
        [*_standard(_STORED), _LONG, _BAYES, _ODDS, _BINS, *_grown("t", _ONE_TREE, 3)], _scores("row_no AS applicant_id", "model_id AS algorithm")
    ),
    "stored_model_scores": _with(
        [*_standard(_STORED), _LONG, *_FOLDED],
        "SELECT 'naive_bayes' AS algorithm, true AS is_from_scratch, true AS is_champion, "
        + ", ".join(
            f"CAST(avg({value}) AS DECIMAL(6,4)) AS {name}"
            for name, value in (
                ("cv_accuracy", "(tp + tn)::DOUBLE / rows"),
                ("cv_precision", "tp::DOUBLE / nullif(tp + fp, 0)"),
                ("cv_recall", "tp::DOUBLE / nullif(tp + fn, 0)"),
                (
                    "cv_f1_weighted",
                    "(coalesce(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0) * (tp + fn) "
                    "+ coalesce(2 * tn::DOUBLE / nullif(2 * tn + fp + fn, 0), 0) * (fp + tn)) / rows",
                ),
                ("cv_auc_roc", "auc"),
            )
        )
        + " FROM cells JOIN fold_auc USING (fold)",
    ),
    "linear_attributions": _with(
        [*_standard(), _LONG, _BAYES, _LINEAR],
        "SELECT row_no, round(sum(c * z) + (SELECT sum(i) FROM linear), 6) AS log_odds, "
        "array_to_string(list(l.name ORDER BY round(abs(c * z), 12) DESC, l.name)[1:3], ',') AS top_shap_features "
        "FROM long_z l JOIN linear USING (input) GROUP BY row_no",
    ),
    "near_duplicate_chunks": _with(
        _SHINGLED,
        "SELECT a, b, shared, round(shared::DOUBLE / (n_a + n_b - shared), 6) AS similarity FROM ("
        "SELECT x.id AS a, y.id AS b, any_value(x.n) AS n_a, any_value(y.n) AS n_b, count(*) AS shared FROM held x JOIN held y "
        "ON x.shingle = y.shingle AND x.id < y.id GROUP BY x.id, y.id) p WHERE shared * 185 >= (n_a + n_b) * 85",
    ),
    "duplicate_chunk_classes": _with(_SHINGLED, "SELECT id, class_id, class_size FROM classed"),
    "chunk_content_hashes": building_blocks("SELECT id, sha256(chunk_text) AS content_sha256 FROM chunks"),
    "vector_topk_set": _best(
        "SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score "
        "FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0",
        "vec_id",
    ),
    "tfidf_topk_set": building_blocks(
        _best(
            "SELECT q.id AS query_id, w.id, sum(q.weight * w.weight) AS score FROM term_weights q JOIN term_weights w USING (term) "
            "WHERE CAST(split_part(q.id, '-', 2) AS BIGINT) % 50 = 0 GROUP BY q.id, w.id",
            "id",
        )
    ),
}

#: Queries without SQL: a Newton step solves a linear system.
WITHOUT = ("train_logistic_regression",)

"""CSV and parquet in and out."""

import pytest
from conftest import RAW_ROW
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from creditmill.config import RAW_COLUMNS, FeatureConfig
from creditmill.operators.summary import summarise, summary_counts
from creditmill.plans.feature_table import build_feature_table, run_features
from creditmill.sources.files import (
    MissingColumnsError,
    load_raw,
    number_rows,
    read_csv,
    read_features,
    write_features,
)
from creditmill.sources.jdbc import jdbc_options


def write_csv(path, names, rows):
    lines = [",".join(names)] + [",".join(row[name] for name in names) for row in rows]
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_missing_file(spark, tmp_path):
    with pytest.raises(AnalysisException):
        load_raw(spark, tmp_path / "nothing.csv")


def test_missing_columns_are_named(spark, tmp_path):
    names = [n for n in RAW_ROW if n not in ("credit_score", "person_age")]
    with pytest.raises(MissingColumnsError, match="credit_score, person_age"):
        load_raw(spark, write_csv(tmp_path / "a.csv", names, [RAW_ROW]))


def test_header_order_and_extra_columns(spark, tmp_path):
    first = write_csv(tmp_path / "a.csv", list(RAW_ROW), [RAW_ROW])
    second = write_csv(tmp_path / "b.csv", ["extra", *reversed(RAW_ROW)], [{**RAW_ROW, "extra": "9"}])
    a, b = load_raw(spark, first), load_raw(spark, second)
    assert a.columns == b.columns == list(RAW_COLUMNS)
    assert a.collect() == b.collect()


def test_folder_with_a_differing_header_fails_instead_of_swapping(spark, tmp_path):
    write_csv(tmp_path / "a.csv", list(RAW_ROW), [RAW_ROW])
    write_csv(tmp_path / "b.csv", list(reversed(RAW_ROW)), [RAW_ROW])
    with pytest.raises(Exception, match="(?i)header"):
        load_raw(spark, tmp_path).collect()


def test_missing_tokens_and_quotes(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text('a,b\n"x, ""y""",NA\n"",None\n')
    assert [tuple(r) for r in read_csv(spark, path).collect()] == [('x, "y"', None), (None, None)]


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_feature_table_round_trip(spark, raw, tmp_path, fmt):
    config = FeatureConfig(version="1.10")
    table = build_feature_table(raw({}, {"credit_score": "500"}), config)
    path = tmp_path / "deep" / "er" / fmt
    write_features(table, path, fmt)
    write_features(table, path, fmt)  # overwrites
    back = read_features(spark, path, fmt)
    assert back.columns == table.columns and back.count() == 2
    assert {r["pipeline_version"] for r in back.collect()} == {"1.10"}


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_csv_to_features(spark, tmp_path, fmt):
    rows = [{**RAW_ROW, "credit_score": str(500 + i)} for i in range(20)]
    source = write_csv(tmp_path / "raw.csv", list(RAW_ROW), rows)
    table = run_features(spark, source, tmp_path / "out", fmt=fmt)
    assert table.count() == 20 and len(table.columns) == 36
    summary = summarise(table).first()
    assert (summary["row_count"], summary["column_count"], summary["high_risk_rows"]) == (20, 36, 20)
    assert summary["approved_share"] == 1.0
    assert summary_counts(table).agg(F.sum("count")).first()[0] == 60


def test_rows_are_numbered_in_file_order(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for part in range(3):
        text = "\n".join(f"{part * 4000 + i},{'x' * 50}" for i in range(4000))
        (folder / f"part-{part}.csv").write_text("n,pad\n" + text + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        numbered = number_rows(read_csv(spark, folder, with_order=True))
        assert numbered.where("row_no <> cast(n as bigint)").count() == 0
        assert numbered.count() == 12000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_jdbc_options():
    options = jdbc_options("jdbc:postgresql://host/db", "loan_applicants", "me", "secret")
    assert options["dbtable"] == "loan_applicants" and options["user"] == "me"
    assert "password" not in jdbc_options("jdbc:postgresql://host/db", "t")

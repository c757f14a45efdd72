import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

from creditmill.session import build_session  # noqa: E402

# Compiling the plans takes far longer than running them on a few rows, so the
# tests interpret them; TEST_CODEGEN=1 compiles as in production, and
# tools/check_oracles.py always does.
CODEGEN = (
    {}
    if os.environ.get("TEST_CODEGEN")
    else {
        "spark.sql.codegen.wholeStage": "false",
        "spark.sql.codegen.factoryMode": "NO_CODEGEN",
    }
)
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
            **CODEGEN,
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    if not session.conf.get("spark.checkpoint.dir", None):
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


RAW_ROW = {
    "person_age": "28",
    "person_gender": "male",
    "person_education": "Bachelor",
    "person_income": "45000",
    "person_emp_exp": "5",
    "person_home_ownership": "RENT",
    "loan_amnt": "12000",
    "loan_intent": "PERSONAL",
    "loan_int_rate": "12.5",
    "loan_percent_income": "0.26",
    "cb_person_cred_hist_length": "6",
    "credit_score": "690",
    "previous_loan_defaults_on_file": "No",
    "loan_status": "1",
}


@pytest.fixture
def raw(spark):
    """Build a raw frame from changes to a worked example row; adds row_no."""

    def build(*changes):
        names = list(RAW_ROW)
        rows = [
            (number, *[{**RAW_ROW, **change}[name] for name in names])
            for number, change in enumerate(changes)
        ]
        ddl = "row_no bigint, " + ", ".join(f"{name} string" for name in names)
        return spark.createDataFrame(rows, ddl)

    return build

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from nodeglass.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("nodeglass-tests", cores=8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make_logs(spark):
    """Logs from (log_id, node_id, code, ms, load_val, l_v1) tuples."""

    def make(rows):
        schema = (
            "log_id long, node_id long, http_response_code int, response_time_ms int, load_val double, l_v1 double"
        )
        return spark.createDataFrame(rows, schema).selectExpr(
            "log_id", "node_id", "'OPERATIONAL' AS json_status", "http_response_code", "response_time_ms",
            "load_val", "l_v1", "timestamp_seconds(log_id) AS ingested_at",
        )

    return make


@pytest.fixture
def make_nodes(spark):
    """Nodes from (node_uuid, serial, infected) tuples."""

    def make(rows):
        return spark.createDataFrame(rows, "node_uuid long, serial_number string, is_infected boolean").selectExpr(
            "node_uuid", "concat('Node/2.0 ', base64(cast(serial_number AS binary))) AS user_agent",
            "serial_number", "is_infected",
        )

    return make

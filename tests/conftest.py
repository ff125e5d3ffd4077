import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", f"file://{shared}/checkpoints")
        .config("spark.sql.warehouse.dir", f"file://{shared}/warehouse")
        .config("spark.ui.showConsoleProgress", "false")
        # Results must not depend on the session zone; one with clock changes is used on purpose.
        .config("spark.sql.session.timeZone", "America/New_York")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture
def make_events(spark):
    """Events from dicts; ts as text, anything left out is null."""
    from pyspark.sql import functions as F

    from sentrylake.schema import conform

    def build(*rows):
        fields = ["event_id", "ts", "source", "event_type", "user_name", "ip", "host", "dst_ip",
                  "action", "command"]
        numbers = ["dst_port", "bytes"]
        schema = ", ".join([f"{f} string" for f in fields] + [f"{n} bigint" for n in numbers])
        data = [
            tuple(
                r.get(f, f"e{i:04d}" if f == "event_id" else None) for f in [*fields, *numbers]
            )
            for i, r in enumerate(rows)
        ]
        df = spark.createDataFrame(data, schema)
        return conform(df.withColumn("ts", F.col("ts").cast("timestamp_ntz")))

    return build

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.dirname(os.path.abspath(__file__))]

from contactline.runtime import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = str(tmp_path_factory.mktemp("shared"))
    # Tiny inputs: compiling generated code would take longer than running the plans.
    session = local_session(
        4, 4, **{"spark.checkpoint.dir": shared, "spark.sql.codegen.wholeStage": "false"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Value of a column function for each of some texts."""
    from pyspark.sql import functions as F

    def run(fn, values):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
        return [r.out for r in df.select("i", fn(F.col("v")).alias("out")).orderBy("i").collect()]

    return run

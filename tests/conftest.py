from __future__ import annotations

import os
import tempfile

import pytest

from wickmill import build_session


def local_session():
    return build_session(
        "wickmill-tests",
        f"local[{os.environ.get('BENCH_CPUS', '8')}]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.sql.maxMetadataStringLength": "4000",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-", dir="/tmp"),
            "spark.ui.showConsoleProgress": "false",
        },
    )


@pytest.fixture(scope="session")
def spark():
    session = local_session()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def folder(tmp_path_factory):
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")

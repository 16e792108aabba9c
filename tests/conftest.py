"""Shared Spark session for the test suite (local mode, small shuffle count)."""

from __future__ import annotations

import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from gatemeter.session import get_spark

    # tests run on one machine, where no shared checkpoint folder is named
    ckpt = tempfile.mkdtemp(prefix="gatemeter-test-ckpt-")
    s = get_spark("local[*]", shuffle_partitions=8,
                  extra={"spark.checkpoint.dir": ckpt, "spark.driver.memory": "4g"})
    yield s


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="gatemeter-test-")

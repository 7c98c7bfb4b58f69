import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))


@pytest.fixture(scope="session")
def spark():
    from codeloom.session import local_session

    session = local_session(8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def blocks(spark):
    """Run an extraction job on {path: text}; returns rows as dicts without absent keys."""

    def run(job, texts, **options):
        frame = spark.createDataFrame(list(texts.items()), "file_path string, text string")
        rows = job(frame, **options).orderBy("file_path", "ordinal").collect()
        return [{k: v for k, v in r.asDict().items() if v is not None} for r in rows]

    return run

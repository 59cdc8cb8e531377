import pytest

TEXTS = "doc_id long, text string, h string, norm string, kept string, score string, fingerprint string, part string"


@pytest.fixture(scope="session")
def frame(spark):
    """A documents frame with extra columns that share internal names."""
    def make(rows):
        return spark.createDataFrame([(i, t, "x", "x", "x", "x", "x", "x") for i, t in rows], TEXTS)
    return make


@pytest.fixture(scope="session")
def sf001():
    return "/root/testdata/sf0.001"

import pytest

from linescan.config import SearchConfig
from linescan.streaming import stream


@pytest.fixture
def files(spark, tmp_path):
    at = str(tmp_path / "in")
    spark.createDataFrame([("a", "x TODO\ny"), ("b", "no")], "path string, text string").write.parquet(at)
    return spark.readStream.schema("path string, text string").parquet(at), at


def test_session(spark, files, tmp_path):
    df, at = files
    session, out = stream.SearchSession(spark), str(tmp_path / "out")
    sink = lambda rows, _: rows.select("path", "line_num", "text").write.mode("append").parquet(out)
    for round_, more in enumerate(([], [("c", "TODO")])):
        if more:
            spark.createDataFrame(more, "path string, text string").write.mode("append").parquet(at)
        session.start(df, SearchConfig("TODO"), sink, str(tmp_path / "state"))
        assert session.wait(60) and not session.is_running()
        assert sorted(r.path for r in spark.read.parquet(out).collect()) == ["a", "c"][: 1 + round_]
    session.cancel()


def test_callback(spark, files, tmp_path):
    seen = spark.sparkContext.accumulator(0)
    found = stream.search_stream(files[0], SearchConfig("TODO"))
    stream.for_each_match(found, lambda row: seen.add(row.line_num), str(tmp_path / "state")).awaitTermination(60)
    assert seen.value == 1


def test_batches_are_refused(spark):
    with pytest.raises(ValueError):
        stream.search_stream(spark.range(1), SearchConfig("x"))

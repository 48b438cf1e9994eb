"""A folder read as a stream gives the rows of a batch."""

from test_kernels import demo

from bytefold.plans import tables
from bytefold.sources.units import read_units
from bytefold.streaming.ingest import stream_units


def test_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for n in range(3):
        (folder / f"{n}.class").write_bytes(demo().build() if n else b"broken")
    parsed = tables.parse_classes(stream_units(spark, str(folder), 1)).select("unit_id", "name", "error")
    query = parsed.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(tmp_path / "out"))
    assert query.awaitTermination(120)
    batch = tables.parse_classes(read_units(spark, [str(folder)])).select("unit_id", "name", "error")
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=repr) == sorted(map(tuple, batch.collect()), key=repr)

"""New files become rows of streams."""

from tesserae.sources import tiff
from tesserae.streaming import arrivals


def test_windows_of_arrivals(spark, tmp_path):
    image = tiff.Image(20, 10, "UInt8", 1, 16, 16)
    (tmp_path / "in").mkdir()
    for n in "ab":
        (tmp_path / "in" / f"{n}.tif").write_bytes(tiff.write([image], [[b"\1" * 256] * 2]))
    rows = arrivals.arrivals_by_window(arrivals.new_images_anywhere(spark, str(tmp_path / "in")))
    query = rows.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    got = spark.table("windows").collect()
    assert sum(r.images for r in got) == 2 and sum(r.pixels for r in got) == 400 and {r.pixel_type for r in got} == {"UInt8"}

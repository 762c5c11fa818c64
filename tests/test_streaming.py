from mosaiq.codecs import png
from mosaiq.streaming.inbox import stream_thumbnails
from tests import test_codecs as made


def test_inbox(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.png").write_bytes(png.encode_png(made.picture()))
    run = lambda: stream_thumbnails(spark, f"file://{inbox}", f"file://{tmp_path}/out", f"file://{tmp_path}/state", 8, 8, once=True).awaitTermination(120)
    run()
    (inbox / "b.ppm").write_bytes(b"P6 1 1 255\nabc")
    (inbox / "c.txt").write_bytes(b"?")
    run()
    got = {r["path"].rsplit("/", 1)[1]: r for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert set(got) == {"a.png", "b.ppm", "c.txt"} and got["c.txt"]["error"] and png.decode_png(bytes(got["b.ppm"]["png"])).rgba.shape == (8, 8, 4)

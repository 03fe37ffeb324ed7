import hashlib
import struct
import zlib
from datetime import datetime

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from frondlake.functions import images as pixels
from frondlake.operators import dedup, history, integrity
from frondlake.session import checkpoint_folder, cut_lineage
from frondlake.sources import images
from frondlake.sources.history import read_history, with_partitions
from frondlake.sources.listing import list_entries
from frondlake.streaming import stats, uploads

LEAF = (50, 140, 55)


def png(width, height, colour=2, rows=None, extra=b""):
    """A PNG of colour type ``colour``; ``rows`` gives raw scan lines."""
    depth = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    if rows is None:
        rows = [bytes((LEAF + (255,))[:depth]) * width] * height

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    palette = chunk(b"PLTE", bytes(LEAF)) if colour == 3 else b""
    if colour == 3:
        rows = [bytes(width)] * height
    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0))
            + palette + extra + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + r for r in rows))) + chunk(b"IEND", b""))


def transparency():
    data = b"\x00"
    return struct.pack(">I", len(data)) + b"tRNS" + data + struct.pack(">I", zlib.crc32(b"tRNS" + data))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("dataset")
    files = {
        "corn/common_rust/leaf.png": png(320, 320), "corn/common_rust/deep/copy.PNG": png(320, 320),
        "corn/common_rust/gray.png": png(100, 500, 0), "corn/healthy/alpha.png": png(460, 460, 6),
        "corn/healthy/palette.png": png(300, 300, 3), "corn/healthy/clear.png": png(300, 300, 3, extra=transparency()),
        "corn/healthy/ga.png": png(20, 10, 4), "lemon/curl_virus/bad.jpg": b"not an image", "lemon/curl_virus/empty.png": b"",
        "lemon/curl_virus/notes.txt": b"text", "stray.png": png(5, 5),
    }
    for name, data in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return root, files


def test_listing(spark, catalog, folder):
    root, files = folder
    listed = images.list_images(spark, str(root))
    assert {r["relative_path"]: r["file_size"] for r in listed.collect()} == {
        n: len(d) for n, d in files.items() if not n.endswith(".txt")}
    classed = {r["relative_path"]: r["class_id"] for r in images.with_class(listed, catalog).collect()}
    assert classed["corn/common_rust/deep/copy.PNG"] == 1 and classed["lemon/curl_virus/bad.jpg"] == 3
    assert "stray.png" not in classed and len(classed) == 9


def test_inspection(spark, catalog, folder):
    root, files = folder
    records = cut_lineage(images.inspect_images(spark, str(root), catalog))
    rows = {r["relative_path"]: r for r in records.collect()}
    assert len(rows) == 9
    leaf = rows["corn/common_rust/leaf.png"]
    assert (leaf["valid"], leaf["width"], leaf["height"], leaf["pixels"]) == (True, 320, 320, 102400)
    assert (leaf["format"], leaf["mode"], leaf["channels"], leaf["dhash"]) == ("png", "RGB", 3, 0)
    assert leaf["sha256"] == hashlib.sha256(files["corn/common_rust/leaf.png"]).hexdigest()
    assert (leaf["small"], leaf["below_ideal_resolution"], leaf["tiny_file"], leaf["error"]) == (False, True, True, None)
    gray = rows["corn/common_rust/gray.png"]
    assert (gray["mode"], gray["grayscale"], gray["extreme_aspect"], gray["severely_undersized"]) == ("L", True, True, True)
    assert (rows["corn/healthy/alpha.png"]["mode"], rows["corn/healthy/alpha.png"]["has_alpha"]) == ("RGBA", True)
    assert (rows["corn/healthy/palette.png"]["mode"], rows["corn/healthy/palette.png"]["has_alpha"]) == ("P", False)
    assert rows["corn/healthy/clear.png"]["has_alpha"] is True
    assert (rows["corn/healthy/ga.png"]["mode"], rows["corn/healthy/ga.png"]["channels"]) == ("LA", 2)
    bad = rows["lemon/curl_virus/bad.jpg"]
    assert (bad["valid"], bad["width"], bad["format"], bad["mode"], bad["dhash"]) == (False, None, "jpg", None, None)
    assert bad["error"] and bad["file_size"] == 12 and bad["sha256"] and not bad["small"]
    assert rows["lemon/curl_virus/empty.png"]["valid"] is False
    plan = {r["relative_path"]: r["status"] for r in dedup.dedup_plan(records, "sha256").collect()}
    assert plan == {"corn/common_rust/deep/copy.PNG": "KEEP", "corn/common_rust/leaf.png": "DUPLICATE"}


def test_hash_of_gradients(spark, tmp_path):
    falling = [bytes(v for x in range(90) for v in (255 - 2 * x,) * 3)] * 80
    rising = [bytes(v for x in range(90) for v in (2 * x,) * 3)] * 80
    (tmp_path / "fall.png").write_bytes(png(90, 80, rows=falling))
    (tmp_path / "rise.png").write_bytes(png(90, 80, rows=rising))
    rows = {r["relative_path"]: r["dhash"] for r in images.inspect_images(spark, str(tmp_path)).collect()}
    assert rows == {"fall.png": -1, "rise.png": 0}


def test_resampling_rows_sum_to_one_and_keep_size():
    for kernel in ("lanczos", "bilinear"):
        for source, target in ((320, 9), (5, 9), (9, 9)):
            weights = pixels.resampling_matrix(source, target, kernel)
            assert weights.shape == (target, source) and np.allclose(weights.sum(axis=1), 1)
    plane = np.arange(81, dtype=float).reshape(9, 9)
    assert np.array_equal(pixels.resize(plane, 9, 9, "bilinear"), plane)


@pytest.mark.parametrize("kernel", ["lanczos", "bilinear"])
@pytest.mark.parametrize("source, target", [(640, 300), (3000, 300), (100, 300), (7, 9)])
def test_summed_taps_equal_the_matrix(kernel, source, target):
    plane = np.random.default_rng(source).integers(0, 256, (5, source)).astype(float)
    assert np.allclose(pixels._across(plane, target, kernel), plane @ pixels.resampling_matrix(source, target, kernel).T)


def test_roots_may_be_uris(spark, folder):
    root, _ = folder
    plain, uri = images.list_images(spark, str(root)), images.list_images(spark, f"file://{root}/")
    assert sorted(r["relative_path"] for r in plain.collect()) == sorted(r["relative_path"] for r in uri.collect())
    assert images.list_images(spark, str(root), include_empty=False).count() == plain.count() - 1


def test_listing_of_flat_and_huge_folders(spark, tmp_path):
    """Names stream in batches and are looked up by several tasks; empty directories and odd names are rows too."""
    names = [f"leaf {i:05d}.jpg" for i in range(12_000)]
    (tmp_path / "huge").mkdir()
    for name in names:
        (tmp_path / "huge" / name).touch()
    deep = tmp_path / "a" / "b" / "c" / "d"
    deep.mkdir(parents=True)
    (tmp_path / "a" / "empty").mkdir()
    (deep / "é#%20?.PNG").write_bytes(b"12345")
    (tmp_path / "flat.gif").write_bytes(b"1")
    (deep / "round").symlink_to(tmp_path)
    (deep / "gone.png").symlink_to(tmp_path / "nowhere")
    found = list_entries(spark, str(tmp_path)).collect()
    base = f"file:{tmp_path}"
    assert {r["path"].removeprefix(base) for r in found if r["directory"]} == {
        "/huge", "/a", "/a/b", "/a/b/c", "/a/b/c/d", "/a/empty"}
    files = {r["path"].removeprefix(base): r["file_size"] for r in found if not r["directory"]}
    assert len(files) == len(found) - 6 and files == {f"/huge/{n}": 0 for n in names} | {"/a/b/c/d/é#%20?.PNG": 5, "/flat.gif": 1}
    assert all(r["modified"] is not None for r in found if not r["directory"])
    assert images.empty_files(spark, str(tmp_path)).count() == len(names)


def test_listing_needs_no_list_in_a_task(monkeypatch, tmp_path):
    from frondlake.sources import listing

    for i in range(25):
        (tmp_path / f"{i}.png").touch()
    monkeypatch.setattr(listing, "NAMES_A_BATCH", 10)
    batches = listing._list(iter([pa.RecordBatch.from_pydict({"path": [f"file:{tmp_path}"]})]))
    assert [len(b) for b in batches] == [10, 10, 5]


def test_missing_directories(spark, catalog, tmp_path):
    (tmp_path / "corn" / "healthy").mkdir(parents=True)
    (tmp_path / "lemon").mkdir()
    directories = images.list_directories(spark, f"file://{tmp_path}")
    assert sorted(r["id"] for r in integrity.missing_directories(catalog, directories).collect()) == [1, 3]
    with pytest.raises(Exception, match="No such file|not exist"):
        list_entries(spark, str(tmp_path / "no"))


def test_model_input(spark, folder):
    root, _ = folder
    rows = {r["image"]: r["features"] for r in images.read_model_input(spark, str(root), size=4).collect()}
    want = [(c / 255 - m) / s for c, m, s in zip(LEAF, (0.485, 0.456, 0.406), (0.229, 0.224, 0.225))]
    assert np.allclose(np.array(rows["corn/common_rust/leaf.png"]).reshape(3, 16), np.array(want)[:, None], atol=1e-5)
    assert rows["lemon/curl_virus/bad.jpg"] is None and len(rows["corn/common_rust/gray.png"]) == 48


PNG = bytes.fromhex("89504e470d0a1a0a0000000d4948445200000001000000010806000000" "1f15c489" "0000000d49444154"
                    "789c6360f8cfc000000301010018dd8db00000000049454e44ae426082")


@pytest.mark.parametrize("content_type, payload, want", [
    ("text/plain", b"", "content_type_415"), (None, b"x", "content_type_415"), ("image/png", b"", "empty_400"),
    ("image/png", None, "empty_400"), ("image/png", b"x" * 201, "too_large_413"), ("image/png", b"not an image", "not_an_image_400"),
    ("image/png", b"GIF89a" + bytes(10) + b";", "image_format_415"), ("image/jpeg", b"\x89PNG\r\n\x1a\n", "not_an_image_400"),
    ("image/jpeg", b"\xff\xd8\xff\xe0" + bytes(9), "not_an_image_400"), ("image/jpeg", b"\xff\xd8\xff\xe0" + bytes(9) + b"\xff\xd9", None),
    ("image/png", PNG[:-4], "not_an_image_400"), ("image/png", PNG, None),
])
def test_triage_order(spark, content_type, payload, want):
    df = spark.createDataFrame([(content_type, payload)], "content_type string, payload binary")
    row = uploads.triage(df, images.complete_format(F.col("payload")), max_bytes=200).first()
    assert row["reject_reason"] == want


UPLOAD = "filename string, content_type string, payload binary, received_at timestamp"


def as_scans(accepted):
    text = [F.lit(v).alias(n) for n, v in (("class_key", "corn__common_rust"), ("crop", "corn"),
                                          ("disease", "common_rust"), ("display_name", "Corn Common Rust"))]
    number = [F.lit(v).alias(n) for n, v in (("confidence", 0.5), ("confidence_percent", 50.0), ("inference_ms", 1.0))]
    return accepted.select("filename", "content_type", F.col("payload").alias("image"), *text, *number,
                           F.col("received_at").alias("created_at"))


def test_upload_stream_stores_each_upload_once(spark, tmp_path):
    source = str(tmp_path / "in")
    base = str(tmp_path / "out")

    def upload(*names):
        rows = [(n, "image/png", b"x" if n.startswith("bad") else png(3, 3), datetime(2024, 5, 1 + i % 2, 3))
                for i, n in enumerate(names)]
        spark.createDataFrame(rows, UPLOAD).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(UPLOAD).parquet(source)
        triaged = uploads.triage(stream, images.container_format(F.col("payload")))
        query = uploads.store_scans(triaged, as_scans, f"{base}/history", f"{base}/rejects", f"{base}/checkpoint")
        query.awaitTermination()

    upload("a.png", "b.png", "bad.png")
    run()
    run()  # nothing new
    upload("c.png")
    run()
    stored = read_history(spark, f"{base}/history")
    assert sorted(r["filename"] for r in stored.collect()) == ["a.png", "b.png", "c.png"]
    assert stored.select("id").distinct().count() == 3
    newest = history.list_scans(stored, query="c.png").first()
    assert newest["id"] > uploads.BATCH_IDS
    assert [r["reject_reason"] for r in spark.read.parquet(f"{base}/rejects").collect()] == ["not_an_image_400"]


def test_repeated_batch_writes_the_same_rows(spark, tmp_path):
    path = str(tmp_path / "history")
    rows = spark.createDataFrame([(f"{i}.png", "image/png", b"%d" % i, datetime(2024, 5, 1 + i % 3)) for i in range(20)], UPLOAD)
    uploads.write_batch(as_scans(rows), 4, path)
    first = sorted(tuple(r) for r in with_partitions(spark, path).select("id", "filename", "batch_id").collect())
    uploads.write_batch(as_scans(rows.repartition(5)), 4, path)
    again = sorted(tuple(r) for r in with_partitions(spark, path).select("id", "filename", "batch_id").collect())
    assert first == again and len(first) == 20
    uploads.write_batch(as_scans(rows), 5, path)
    assert with_partitions(spark, path).count() == 40


def test_stream_statistics_equal_batch(spark, tmp_path):
    source, base = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "class_key string, display_name string, confidence_percent double"
    for key, percent in (("a__x", 10.0), ("b__healthy", 40.0), ("a__x", 30.0)):
        spark.createDataFrame([(key, key.upper(), percent)], schema).write.mode("append").parquet(source)
        stats.maintain_class_totals(
            spark.readStream.schema(schema).parquet(source), f"{base}/totals", f"{base}/checkpoint").awaitTermination()
    streamed = history.stats_from_classes(stats.latest_class_totals(spark, f"{base}/totals")).first()
    batch = history.history_stats(spark.read.parquet(source)).first()
    assert tuple(streamed) == tuple(batch) == (3, 1, 2, 26.7, "A__X")


def test_class_totals_keep_few_snapshots(spark, tmp_path):
    path = str(tmp_path / "totals")
    schema = "class_key string, display_name string, scans bigint, percent_sum double, percent_count bigint"

    def totals(n):
        return spark.createDataFrame([("a__x", "A", n, 10.0 * n, n), ("b__y", "B", 1, 2.0, 1)], schema)

    def stored():
        return {int(p.name.split("=")[1]) for p in (tmp_path / "totals").glob("batch_id=*")}

    with pytest.raises(FileNotFoundError):
        stats.latest_class_totals(spark, path)
    for batch in range(50):
        stats.store_class_totals(totals(batch), batch, path)
        assert len(stored()) <= 3
    stats.store_class_totals(totals(49), 49, path)
    assert stored() == {47, 48, 49}
    assert sorted(stats.latest_class_totals(spark, path).collect()) == sorted(totals(49).collect())
    # A folder without its mark was not finished: the one before it counts.
    stats.store_class_totals(totals(50), 50, path)
    (tmp_path / "totals" / "batch_id=50" / "_SUCCESS").unlink()
    assert {r["scans"] for r in stats.latest_class_totals(spark, path).collect()} == {49, 1}
    stats.store_class_totals(totals(50), 50, path, keep=1)
    assert stored() == {50}
    with pytest.raises(ValueError):
        stats.store_class_totals(totals(51), 51, path, keep=0)


def test_checkpoint_folder_is_stable(spark):
    assert checkpoint_folder(spark) == checkpoint_folder(spark)
    assert cut_lineage(spark.range(3)).count() == 3


def test_inspection_of_table_contents_matches_files(spark, catalog, folder):
    root, files = folder

    def decode(content):  # just enough of PNG for these files
        if content[:8] != b"\x89PNG\r\n\x1a\n":
            raise ValueError("not a PNG")
        width, height, _, colour = struct.unpack(">IIBB", content[16:26])
        depth, mode = {0: (1, "L"), 2: (3, "RGB"), 3: (1, "P"), 4: (2, "LA"), 6: (4, "RGBA")}[colour]
        at = content.index(b"IDAT")
        data = zlib.decompress(content[at + 4:at + 4 + struct.unpack(">I", content[at - 4:at])[0]])
        raw = np.frombuffer(data, np.uint8).reshape(height, 1 + width * depth)[:, 1:].reshape(height, width, depth)
        shown = raw[:, :, :3] if depth > 2 else raw[:, :, :1]
        return "PNG", mode, b"tRNS" in content, shown

    rows = spark.createDataFrame(
        [(f"file:{root}/{n}", n, d) for n, d in files.items() if not n.endswith(".txt")],
        "path string, relative_path string, content binary")
    compared = ["relative_path", "valid", "width", "height", "format", "mode", "channels", "file_size", "sha256",
                "small", "extreme_aspect", "grayscale", "has_alpha", "class_id"]
    table = images.inspect_contents(rows, decode, catalog=catalog).select(*compared)
    loose = images.inspect_images(spark, str(root), catalog).select(*compared)
    assert sorted(map(str, table.collect())) == sorted(map(str, loose.collect()))


def test_stored_history_reads_equal_the_whole_history(spark, tmp_path):
    from frondlake.plans.stored_history import find_scan_image, newest_scans, stored_days

    path = str(tmp_path / "history")
    for batch in (0, 3):
        rows = spark.createDataFrame(
            [(f"{batch}-{i}.png", "image/png", b"%d%d" % (batch, i), datetime(2024, 5, 1 + (i * 7 + batch) % 20, i % 24))
             for i in range(40)], UPLOAD)
        uploads.write_batch(as_scans(rows), batch, path)
    whole = read_history(spark, path)
    assert len(stored_days(spark, path)) == 20
    for options in ({"limit": 3}, {"limit": 30}, {"limit": 100}, {"limit": 5, "query": "0-3"}, {"query": "nothing"},
                    {"category": "healthy"}):
        want = history.list_scans(whole, **options).collect()
        assert newest_scans(spark, path, growth=2, **options).collect() == want
    plan = newest_scans(spark, path, limit=1)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(scan_date" in plan
    for row in whole.where("filename in ('0-5.png', '3-7.png')").collect():
        assert find_scan_image(spark, path, row["id"]).first()["image"] == row["image"]
    assert find_scan_image(spark, path, 12345678).count() == 0

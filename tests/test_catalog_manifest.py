import hashlib
import json

import pytest
from pyspark.sql import functions as F

from frondlake.operators import integrity, mutation
from frondlake.plans.dataset import dataset_summary, dataset_violations, summary_document
from frondlake.schemas import MANIFEST, MissingColumns
from frondlake.sources import sinks
from frondlake.sources.catalog import catalog_document, label_lines, read_catalog, read_labels
from frondlake.sources.manifest import manifest_digest, read_manifest

HEADER = ",".join(MANIFEST.fieldNames())


def line(split="train", cid="1", index="0", key="corn__common_rust", name="Corn Common Rust", crop="corn",
         disease="common_rust", family="f1", path="corn/common_rust/a.jpg"):
    return f"{split},{cid},{index},{key},{name},{crop},{disease},{family},none,{path}"


def healthy(split="train", family="g1", path="corn/healthy/h.png"):
    return line(split, "2", "1", "corn__healthy", "Corn Healthy", "corn", "healthy", family, path)


def virus(split="train", family="v1", path="lemon/curl_virus/v.png"):
    return line(split, "3", "2", "lemon__curl_virus", "Lemon Curl Virus", "lemon", "curl_virus", family, path)


@pytest.fixture
def manifest_of(spark, tmp_path):
    def make(*lines, **options):
        file = tmp_path / "manifest.csv"
        file.write_text("\n".join([HEADER, *lines]) + "\n")
        return read_manifest(spark, str(file), **options)

    return make


def test_catalog_round_trip(spark, catalog, tmp_path):
    document = json.loads(catalog_document(catalog).first()["value"])
    assert document["class_count"] == 3
    assert [c["id"] for c in document["classes"]] == [1, 2, 3]
    file = tmp_path / "labels.json"
    file.write_text(json.dumps(document, indent=2))
    again = read_catalog(spark, str(file))
    assert [tuple(r) for r in again.orderBy("position").collect()] == [
        (*tuple(r), r["index"]) for r in catalog.orderBy("id").collect()]
    lines = [r["value"] for r in label_lines(catalog).collect()]
    assert lines == ["1 Corn Common Rust", "2 Corn Healthy", "3 Lemon Curl Virus"]
    (tmp_path / "label.txt").write_text("\n".join(lines) + "\n")
    assert [tuple(r) for r in read_labels(spark, str(tmp_path / "label.txt")).collect()] == [
        (1, "Corn Common Rust"), (2, "Corn Healthy"), (3, "Lemon Curl Virus")]


@pytest.mark.parametrize("payload", ['{"classes": []}', '{"other": 1}'])
def test_catalog_without_classes_is_an_error(spark, tmp_path, payload):
    file = tmp_path / "labels.json"
    file.write_text(payload)
    with pytest.raises(Exception, match="no classes"):
        read_catalog(spark, str(file)).collect()


def _rules(spark, rows, preset="all"):
    df = spark.createDataFrame(rows, "id int, index int, key string, display_name string, crop string, "
                                     "disease string, relative_directory string, position int")
    return {(r["rule"], r["class_id"]) for r in integrity.catalog_violations(df, preset).collect()}


def _class(i, key=None, directory=None, index=None, position=None, name="N"):
    return (i, i - 1 if index is None else index, key or f"k{i}", name, "c", "d", directory or f"c/{i}",
            i - 1 if position is None else position)


def test_catalog_rules(spark):
    assert _rules(spark, [_class(1), _class(2)]) == set()
    assert _rules(spark, [_class(1), _class(3)], "manager") == {
        ("ids_not_contiguous", None), ("indices_not_contiguous", None)}
    assert _rules(spark, [_class(1, key="k"), _class(2, key="k")], "trainer") == {
        ("duplicate_key", 1), ("duplicate_key", 2)}
    assert _rules(spark, [_class(1, directory="a\\b"), _class(2, directory="a/b")], "manager") == {
        ("duplicate_directory", 1), ("duplicate_directory", 2)}
    assert _rules(spark, [_class(1, directory="a/b"), _class(2, directory="a/b")], "trainer") == set()
    swapped = [_class(1, index=1), _class(2, index=0)]
    assert _rules(spark, swapped, "manager") == set()
    assert _rules(spark, swapped, "auditor") == {("id_index_mismatch", 1), ("id_index_mismatch", 2)}
    reordered = [_class(1, position=1), _class(2, position=0)]
    assert _rules(spark, reordered, "auditor") == set()
    assert _rules(spark, reordered, "trainer") == {
        ("id_out_of_order", 1), ("id_out_of_order", 2), ("index_out_of_order", 1), ("index_out_of_order", 2)}
    assert ("empty_display_name", 1) in _rules(spark, [_class(1, name=" ")])
    gone = (1, 0, "k", None, "c", "d", "c/d", 0)
    assert ("missing_field", 1) in _rules(spark, [gone])


def test_manifest_header_and_extra_columns(spark, tmp_path):
    file = tmp_path / "m.csv"
    file.write_text("split,class_id\ntrain,1\n")
    with pytest.raises(MissingColumns, match="relative_path"):
        read_manifest(spark, str(file))
    file.write_text(HEADER + ",extra\n" + line() + ",kept\n")
    assert read_manifest(spark, str(file)).first()["extra"] == "kept"


def test_line_numbers_across_file_blocks(spark, manifest_of):
    paths = [f"corn/common_rust/{i:05d}.jpg" for i in range(3000)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        rows = manifest_of(*[line(path=p) for p in paths], number_lines=True)
        assert rows.rdd.getNumPartitions() > 3
        got = {r["relative_path"]: r["line"] for r in rows.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {p: i for i, p in enumerate(paths, start=2)}


def test_manifest_violations_in_order(spark, catalog, manifest_of):
    manifest = manifest_of(
        line(),
        line(split="dev"),
        line(cid="x"), line(index="1.5"),
        line(cid="99"),
        line(key="corn__healthy"), line(name="corn common rust"),
        line(path="corn/common_rust/a.gif"),
        line(path="corn/common_rust/gone.PNG"),
        number_lines=True)
    files = spark.createDataFrame([("corn/common_rust/a.jpg",), ("corn/common_rust/a.gif",)], "relative_path string")
    found = integrity.manifest_violations(manifest, catalog, files)
    assert sorted((r["line"], r["code"]) for r in found.collect()) == [
        (3, "bad_split"), (4, "bad_number"), (5, "bad_number"), (6, "unknown_class"), (7, "class_mismatch"),
        (8, "class_mismatch"), (9, "bad_extension"), (10, "missing_file")]
    assert integrity.first_violation(found).first()["code"] == "bad_split"
    trainer = integrity.manifest_violations(manifest, catalog, attributes=("class_index", "class_key"))
    assert (8, "class_mismatch") not in {(r["line"], r["code"]) for r in trainer.collect()}
    assert [r["class_id"] for r in integrity.unknown_classes(manifest, catalog).collect()] == ["x", "99"]


def test_counts_coverage_and_leakage(catalog, manifest_of):
    manifest = manifest_of(
        line("train", family="a", path="corn/common_rust/1.jpg"), line("val", family="a", path="corn/common_rust/2.jpg"),
        line("test", family="b", path="corn/common_rust/3.jpg"),
        healthy("train", path="corn/healthy/4.jpg"), healthy("train", family="a", path="corn/healthy/5.jpg"))
    assert {r["split"]: r["images"] for r in integrity.split_counts(manifest).collect()} == {
        "train": 3, "val": 1, "test": 1}
    matrix = {r["class_key"]: (r["train"], r["val"], r["test"])
              for r in integrity.class_split_matrix(catalog, manifest).collect()}
    assert matrix == {"corn__common_rust": (1, 1, 1), "corn__healthy": (2, 0, 0), "lemon__curl_virus": (0, 0, 0)}
    assert [(r["class_id"], r["family_id"], r["splits"]) for r in integrity.family_leakage(manifest).collect()] == [
        (1, "a", "train,val")]
    coverage = {(r["rule"], r["class_key"], r["split"]) for r in integrity.split_coverage(catalog, manifest).collect()}
    assert coverage == {("class_without_split", "corn__healthy", s) for s in ("val", "test")} | {
        ("class_without_split", "lemon__curl_virus", s) for s in ("train", "val", "test")}
    only = manifest.where("split = 'train'")
    assert {(r["rule"], r["split"]) for r in integrity.split_coverage(catalog, only).collect()} >= {
        ("empty_split", "val"), ("empty_split", "test")}
    counts = {r["class_id"]: r["manifest_images"] for r in integrity.manifest_class_counts(catalog, manifest).collect()}
    assert counts == {1: 3, 2: 2, 3: 0}
    families = {r["class_key"]: r["families"] for r in integrity.family_counts(catalog, manifest).collect()}
    assert families == {"corn__common_rust": 2, "corn__healthy": 2, "lemon__curl_virus": 0}
    summary = json.loads(summary_document(dataset_summary(catalog, manifest)).first()["value"])
    assert summary["class_count"] == 3 and summary["image_count"] == 5 and summary["family_count"] == 4
    assert summary["family_leakage_count"] == 1
    assert summary["split_class_counts"]["corn__healthy"] == {"train": 2, "val": 0, "test": 0}
    found = {(r["stage"], r["code"]) for r in dataset_violations(catalog, manifest).collect()}
    assert found == {(4, "family_leakage"), (5, "class_without_split")}


def test_classes_without_files(spark, catalog):
    files = spark.createDataFrame([("corn/healthy/deep/er/a.jpg",), ("lemon/x.jpg",)], "relative_path string")
    assert {r["key"] for r in integrity.classes_without_files(catalog, files).collect()} == {
        "corn__common_rust", "lemon__curl_virus"}


def test_manifest_digest(spark, manifest_of, tmp_path):
    manifest_of(line())
    row = manifest_digest(spark, str(tmp_path / "manifest.csv")).first()
    assert row["sha256"] == hashlib.sha256((tmp_path / "manifest.csv").read_bytes()).hexdigest()


def test_create_class(catalog):
    row = mutation.create_class(catalog, "Sweet Pea", "Rust-2nd").catalog.where("id = 4").first()
    assert tuple(row) == (4, 3, "sweet_pea__rust_2nd", "Sweet Pea Rust 2Nd", "sweet_pea", "rust_2nd",
                          "sweet_pea/rust_2nd")
    named = mutation.create_class(catalog, "a", "b", "  My Name ").catalog.where("id = 4").first()
    assert named["display_name"] == "My Name"
    with pytest.raises(Exception, match="already exists"):
        mutation.create_class(catalog, "CORN", "healthy").catalog.collect()
    with pytest.raises(Exception, match="disease must contain"):
        mutation.create_class(catalog, "corn", "??").catalog.collect()


def test_rename_class(catalog, manifest_of):
    manifest = manifest_of(line(), healthy())
    change = mutation.rename_class(catalog, manifest, 1, crop="Maize", display_name="Maize Rust")
    row = change.catalog.where("id = 1").first()
    assert tuple(row) == (1, 0, "maize__common_rust", "Maize Rust", "maize", "common_rust", "maize/common_rust")
    assert change.catalog.count() == 3
    rows = {r["class_id"]: r for r in change.manifest.collect()}
    assert rows["1"]["relative_path"] == "maize/common_rust/a.jpg" and rows["1"]["class_key"] == "maize__common_rust"
    assert rows["2"]["relative_path"] == "corn/healthy/h.png"
    assert [tuple(r) for r in change.moves.collect()] == [("corn/common_rust/a.jpg", "maize/common_rust/a.jpg")]
    assert change.details.first()["manifest_rows"] == 1
    with pytest.raises(Exception, match="another class already has this key"):
        mutation.rename_class(catalog, manifest, 1, disease="healthy").catalog.collect()
    with pytest.raises(Exception, match="unknown class id: 9"):
        mutation.rename_class(catalog, manifest, 9, crop="x").catalog.collect()
    stray = manifest_of(line(path="elsewhere/a.jpg"))
    with pytest.raises(Exception, match="does not match the class directory"):
        mutation.rename_class(catalog, stray, 1, crop="x").manifest.collect()


def test_delete_class(catalog, manifest_of):
    manifest = manifest_of(line(), healthy(), virus())
    change = mutation.delete_class(catalog, manifest, 1)
    assert [(r["id"], r["index"], r["key"]) for r in change.catalog.orderBy("id").collect()] == [
        (1, 0, "corn__healthy"), (2, 1, "lemon__curl_virus")]
    rows = sorted((r["class_id"], r["class_index"], r["class_key"]) for r in change.manifest.collect())
    assert rows == [("1", "0", "corn__healthy"), ("2", "1", "lemon__curl_virus")]
    assert change.moves.count() == 1 and change.details.first()["manifest_rows"] == 1
    with pytest.raises(Exception, match="only class"):
        mutation.delete_class(catalog.where("id = 1"), manifest, 1).catalog.collect()
    with pytest.raises(Exception, match="unknown class id"):
        mutation.delete_class(catalog, manifest, 8).catalog.collect()


def test_row_rewrites_agree(manifest_of):
    manifest = manifest_of(line(), healthy(), line("test"))
    by_column = mutation.rewrite_rows(
        manifest, {"family_id": F.upper("family_id")}, keep=F.col("split") == "train")

    def change(row):
        return {**row, "family_id": row["family_id"].upper()} if row["split"] == "train" else None

    by_row = mutation.rewrite_rows_with(manifest, change)
    assert sorted(by_column.collect()) == sorted(by_row.collect()) and by_row.count() == 2


def test_versions_switch_as_a_whole(spark, catalog, manifest_of, tmp_path):
    root = str(tmp_path / "store")
    first = sinks.write_version(root, catalog, manifest_of(line()))
    assert sinks.current_version(spark, root) == first
    change = mutation.create_class(catalog, "new", "one")
    second = sinks.write_version(root, change.catalog, tables={"moves": change.details})
    assert sinks.current_version(spark, root) == second != first
    assert read_catalog(spark, f"{root}/{second}/labels.json").count() == 4
    assert read_manifest(spark, f"{root}/{first}/manifest.csv").count() == 1
    sinks.log_operation(spark, f"{root}/log", "create", change.details)
    sinks.log_operation(spark, f"{root}/log", "create", change.details)
    assert spark.read.json(f"{root}/log").where("command = 'create'").count() == 2

"""Differences of catalog and manifest versions."""

import json
import random

from pyspark.sql import functions as F

from frondlake.operators import mutation, versions
from frondlake.schemas import MANIFEST
from frondlake.sources import sinks


def manifest_of(spark, rows):
    """Rows ``(class id, class key, path, family)`` as a manifest."""
    return spark.createDataFrame(rows, "class_id string, class_key string, relative_path string, family_id string").select(*[
        F.col(c) if c in ("class_id", "class_key", "relative_path", "family_id") else F.lit("x").alias(c)
        for c in MANIFEST.fieldNames()])


def found(frame):
    return {r["relative_path"]: (r["change"], r["old_rows"], r["new_rows"], tuple(r["fields"])) for r in frame.collect()}


def test_manifest_changes_count_rows_as_a_bag(spark):
    old = manifest_of(spark, [("1", "a", "p", "f"), ("1", "a", "p", "f"), ("1", "a", "q", None), ("1", "a", "r", "f"),
                              ("1", "a", None, None), ("1", "a", "same", None)])
    new = manifest_of(spark, [("1", "a", "p", "f"), ("1", "a", "q", "g"), ("2", "b", "s", "f"), ("1", "a", "same", None),
                              ("2", "a", None, None)])
    assert found(versions.manifest_changes(old, new)) == {
        "p": ("removed", 1, 0, ()), "q": ("changed", 1, 1, ("family_id",)), "r": ("removed", 1, 0, ()),
        "s": ("added", 0, 1, ()), None: ("changed", 1, 1, ("class_id",))}
    moves = spark.createDataFrame([("r", "s")], "old_path string, new_path string")
    moved = found(versions.manifest_changes(old, new, moves))
    assert moved["s"] == ("changed", 1, 1, ("class_id", "class_key", "relative_path")) and "r" not in moved
    assert versions.manifest_changes(old, old).count() == 0
    empty = old.where("class_id = 'none'")
    assert found(versions.manifest_changes(empty, new))["s"] == ("added", 0, 1, ())
    assert {c for c, *_ in found(versions.manifest_changes(old, empty)).values()} == {"removed"}
    assert versions.manifest_changes(empty, empty).count() == 0


def test_manifest_changes_equal_brute_force_with_a_hot_path(spark):
    rng = random.Random(3)

    def rows():
        return [(str(rng.randint(1, 2)), "k", rng.choice(["hot"] * 10 + [f"p{i}" for i in range(30)]), None) for _ in range(300)]

    a, b = rows(), rows()
    want = {}
    for row in set(a) | set(b):
        n = b.count(row) - a.count(row)
        if n:
            gone, come = want.get(row[2], (0, 0))
            want[row[2]] = (gone + max(-n, 0), come + max(n, 0))
    got = found(versions.manifest_changes(manifest_of(spark, a), manifest_of(spark, b)))
    assert {p: v[1:3] for p, v in got.items()} == want


def test_catalog_changes(spark, catalog):
    made = mutation.create_class(catalog, "new", "one").catalog
    named = mutation.rename_class(catalog, manifest_of(spark, []), 1, crop="Maize").catalog
    less = mutation.delete_class(catalog, manifest_of(spark, []), 1).catalog

    def kinds(new):
        return sorted((r["change"], r["old"] and r["old"]["id"], r["new"] and r["new"]["id"])
                      for r in versions.catalog_changes(catalog, new).collect())

    assert kinds(catalog) == [("same", i, i) for i in (1, 2, 3)]
    assert kinds(made) == [("added", None, 4)] + [("same", i, i) for i in (1, 2, 3)]
    assert kinds(named) == [("renamed", 1, 1), ("same", 2, 2), ("same", 3, 3)]
    assert kinds(less) == [("changed", 2, 1), ("changed", 3, 2), ("removed", 1, None)]


def test_records_of_changes_in_the_log(spark, catalog, tmp_path):
    manifest = manifest_of(spark, [("1", "corn__common_rust", f"corn/common_rust/{i}.jpg", None) for i in range(3)]
                           + [("2", "corn__healthy", "corn/healthy/h.png", "f")])
    log = str(tmp_path / "log")
    changes = {
        "create": (mutation.create_class(catalog, "new", "one"), None),
        "rename": (mutation.rename_class(catalog, manifest, 1, crop="Maize", display_name="Maize Rust"), manifest),
        "delete": (mutation.delete_class(catalog, manifest, 1), manifest),
    }
    for name, (change, rows) in changes.items():
        sinks.log_operation(spark, log, name, versions.change_record(change, catalog, rows, applied=name != "create"))
    stored = {r["command"]: json.loads(r["details"]) for r in spark.read.json(log).collect()}
    assert [c["key"] for c in stored["create"]["new_classes"]] == ["new__one"] and stored["create"]["old_classes"] == []
    assert stored["create"]["applied"] is False and "manifest_paths_changed" not in stored["create"]
    rename, delete = stored["rename"], stored["delete"]
    assert [c["key"] for c in rename["old_classes"]] == ["corn__common_rust"]
    assert [(c["key"], c["display_name"]) for c in rename["new_classes"]] == [("maize__common_rust", "Maize Rust")]
    assert rename["id_remap"] == {"1": 1, "2": 2, "3": 3} and rename["applied"] is True
    assert (rename["manifest_paths_changed"], rename["manifest_paths_removed"], rename["moved_files"]) == (3, 0, 3)
    assert [c["key"] for c in delete["old_classes"]] == ["corn__common_rust"] and delete["new_classes"] == []
    assert delete["id_remap"] == {"2": 1, "3": 2}
    assert (delete["manifest_paths_removed"], delete["manifest_paths_changed"], delete["moved_files"]) == (3, 1, 3)

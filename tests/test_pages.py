"""Pages by manifest: what is written is read, untouched pages stay, broken manifests are told."""

import json

import pytest
from pyspark.errors import SparkRuntimeException

from quillspark.sources import pages


def frame(spark, rows):
    return spark.createDataFrame(rows, pages.ITEMS)


def read(spark, root, **kw):
    return {(r.document_id, r.page_index, r.pos): json.loads(r.item) for r in pages.read(spark, root, **kw).collect()}


def test_only_touched_pages_change(spark, tmp_path):
    root = f"file:{tmp_path}/out"
    first = [("a b/ü%1", p, i, json.dumps({"x": f"{p}-{i}", "ü": "é\n"})) for p in range(3) for i in range(4)] + [("c", 7, 0, "[1]"), (None, 1, 0, "{}"), ("c", None, 0, "{}")]
    made = pages.write(frame(spark, first).repartition(3), root)
    assert {(r.document_id, r.page_index) for r in made.collect()} == {("a b/ü%1", 0), ("a b/ü%1", 1), ("a b/ü%1", 2), ("c", 7)}
    want = {(d, p, i): json.loads(x) for d, p, i, x in first if d is not None and p is not None}
    assert read(spark, root) == want
    was = {r.path for r in pages.entries(spark, root).collect()}
    pages.write(frame(spark, [("a b/ü%1", 1, 0, '{"x": "new"}'), ("a b/ü%1", 9, 0, "{}")]), root)
    want = {k: v for k, v in want.items() if k[:2] != ("a b/ü%1", 1)} | {("a b/ü%1", 1, 0): {"x": "new"}, ("a b/ü%1", 9, 0): {}}
    assert read(spark, root) == want
    now = {r.path for r in pages.entries(spark, root).collect()}
    assert len(was & now) == 3 and len(now - was) == 2
    manifest = json.loads(next((tmp_path / "out").glob("a*/" + pages.NAME)).read_text())
    assert (manifest["schema"], manifest["schema_version"]) == ("translation_manifest_v1", 1)
    assert [(p["page_index"], p["page_number"]) for p in manifest["pages"]] == [(0, 1), (1, 2), (2, 3), (9, 10)]
    assert not list((tmp_path / "out").rglob(".*[0-9a-f]")), "nothing staged is left"
    pages.write(frame(spark, []), root)
    assert read(spark, root) == want


BROKEN = {
    "Unsupported manifest schema: other": {"schema": "other", "pages": []}, "Unsupported manifest schema: <missing>": {"pages": []}, "Invalid manifest pages": {"schema": pages.SCHEMA}, "Invalid manifest page entry": {"schema": pages.SCHEMA, "pages": [{"path": "p.json"}]},
    "Manifest page is missing path": {"schema": pages.SCHEMA, "pages": [{"page_index": 1, "path": " "}]}, "Duplicate manifest page index": {"schema": pages.SCHEMA, "pages": [{"page_index": 1, "path": "p.json"}, {"page_index": 1, "path": "p.json"}]},
}


@pytest.mark.parametrize("why", BROKEN)
def test_broken_manifests(spark, tmp_path, why):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "p.json").write_text('[{"k": 1}]')
    (tmp_path / "d" / pages.NAME).write_text(json.dumps(BROKEN[why]))
    with pytest.raises(SparkRuntimeException, match=why):
        pages.read(spark, str(tmp_path)).collect()
    assert read(spark, str(tmp_path), strict=False) == ({("d", 1, 0): {"k": 1}} if why.startswith("Dup") else {})


def test_paths_beside_and_elsewhere(spark, tmp_path):
    (tmp_path / "in" / "d").mkdir(parents=True)
    (tmp_path / "far.json").write_text('[1, "two"]')
    (tmp_path / "in" / "d" / pages.NAME).write_text(json.dumps({"schema": pages.SCHEMA, "pages": [{"page_index": 0, "path": f"{tmp_path}/far.json"}]}))
    assert read(spark, str(tmp_path / "in")) == {("d", 0, 0): 1, ("d", 0, 1): "two"}
    (tmp_path / "far.json").write_text("{}")
    with pytest.raises(Exception, match="no list of items"):
        pages.read(spark, str(tmp_path / "in")).collect()

"""Presets: installed whole or not at all."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from slateflow.operators import jobs
from slateflow.sources import presets

ROLES = ("detector", "classifier", "recognizer", "dictionary")


def tree(home):
    return sorted((os.path.relpath(os.path.join(d, f), home), os.stat(os.path.join(d, f)).st_mtime_ns) for d, _, fs in os.walk(home) for f in fs)


@pytest.fixture
def shop(spark, tmp_path):
    """Two presets that share their detector, and a folder with all their files."""
    at, rows = tmp_path / "files", []
    at.mkdir()
    for preset in ("one", "two"):
        for role in ROLES:
            name = "detector.bin" if role == "detector" else f"{preset}-{role}.bin"
            body = name.encode() * 1000
            (at / name).write_bytes(body)
            rows.append((preset, role, name, hashlib.sha256(body).hexdigest(), f"u/{name}", f"s/{name}"))
    catalogue = spark.createDataFrame(rows, presets.FILE)
    return at, catalogue, lambda: spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(at)), str(tmp_path / "home")


def test_catalogue(spark):
    rows = presets.preset_files(spark).collect()
    assert len(rows) == 48 and {r.preset_id for r in rows} == set(jobs.PRESETS)
    assert all(len(r.sha256) == 64 and r.url.endswith(r.name) for r in rows)
    assert {tuple(r.role for r in rows if r.preset_id == p) for p in jobs.PRESETS} == {ROLES}
    assert len({r.name for r in rows}) == 26 and len({r.sha256 for r in rows}) == 26


def test_install_activates_and_is_idempotent(spark, shop):
    at, catalogue, files, home = shop
    assert presets.active(home) is None and presets.installed_files(spark, home).isEmpty()
    presets.install(spark, home, ["two", "one"], files(), catalogue)
    found = {(r.preset_id, r.name): r for r in presets.installed_files(spark, home).collect()}
    assert set(found) == {(r.preset_id, r.name) for r in catalogue.collect()}
    for r in catalogue.collect():
        assert hashlib.sha256(open(found[r.preset_id, r.name].path.removeprefix("file:"), "rb").read()).hexdigest() == r.sha256
    manifest = json.loads(open(f"{home}/presets/one/manifest.json").read())
    assert manifest["files"]["one-dictionary.bin"]["resolved_from"].endswith("files/one-dictionary.bin")
    assert presets.active(home) == "one" and not os.listdir(f"{home}/.staged")
    paths = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{home}/presets").select("path")
    assert {r.preset_id for r in jobs.installed_presets(paths).collect()} == {"one", "two"}
    before = tree(f"{home}/presets")
    presets.install(spark, home, ["one", "two"], files(), catalogue)
    assert tree(f"{home}/presets") == before and presets.active(home) == "two"
    presets.install(spark, home, ["one"], files(), catalogue, force=True, activate=False)
    after = tree(f"{home}/presets")
    assert len(after) == len(before) and after != before and presets.active(home) == "two"
    assert presets.missing_presets(spark, home, catalogue).isEmpty()


def test_a_failed_digest_leaves_nothing(spark, shop):
    at, catalogue, files, home = shop
    (at / "two-dictionary.bin").write_bytes(b"torn")
    with pytest.raises(Exception, match="checksum mismatch for two-dictionary.bin"):
        presets.install(spark, home, ["one", "two"], files().repartition(4), catalogue)
    assert not tree(home) and presets.active(home) is None
    (at / "two-dictionary.bin").unlink()
    with pytest.raises(Exception, match="no file for two-dictionary.bin"):
        presets.install(spark, home, ["two"], files(), catalogue)
    assert not tree(home)
    # what was installed stays as it was
    presets.install(spark, home, ["one"], files(), catalogue)
    before = tree(home)
    (at / "one-recognizer.bin").write_bytes(b"other")
    with pytest.raises(Exception, match="checksum mismatch"):
        presets.install(spark, home, ["one"], files(), catalogue, force=True)
    assert tree(home) == before
    with pytest.raises(FileNotFoundError):
        presets.set_active(spark, home, "two", catalogue)
    with pytest.raises(ValueError, match="unknown preset"):
        presets.install(spark, home, ["three"], files(), catalogue)


def test_a_right_file_wins_and_a_lost_one_comes_back(spark, shop):
    at, catalogue, files, home = shop
    (at / "a").mkdir()
    (at / "a" / "one-classifier.bin").write_bytes(b"wrong, but first")
    presets.install(spark, home, ["one"], files(), catalogue)
    (lost,) = presets.installed_files(spark, home).where(F.col("name") == "one-classifier.bin").collect()
    os.remove(lost.path.removeprefix("file:"))
    assert [r.preset_id for r in presets.missing_presets(spark, home, catalogue.where("preset_id = 'one'")).collect()] == ["one"]
    presets.install(spark, home, ["one"], files(), catalogue)
    assert presets.missing_presets(spark, home, catalogue.where("preset_id = 'one'")).isEmpty()


def test_an_abort_after_moves_keeps_the_old_one(spark, shop, monkeypatch):
    at, catalogue, files, home = shop
    presets.install(spark, home, ["one"], files(), catalogue)
    before = tree(home)
    os.makedirs(f"{home}/.staged/x")
    (at / "moved").write_bytes(b"m")
    writer = presets.PresetWriter(home)
    monkeypatch.setattr(presets, "replace_json", lambda *_: (_ for _ in ()).throw(OSError("disk is full")))
    messages = [presets.Staged([("one", "m", "0", "s", "p", str(at / "moved"))]), None]
    with pytest.raises(OSError):
        writer.commit(messages)
    writer.abort(messages)
    assert tree(home) == before

"""Model presets: the catalogue of their files, and a data source that installs them, all of a preset or nothing.

An installed preset is a folder of its own with one ``manifest.json``, which names the folder of its files. The manifest is written last, by one
replacement, so a preset is either as it was or whole. Nothing is downloaded: files come from a table of path and content, such as a ``binaryFile`` scan.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import uuid
from dataclasses import dataclass
from pathlib import Path

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..operators.jobs import PRESETS

# Where the files of the presets are published, and the digests of those that all presets share.
MODELS_AT = "https://www.modelscope.cn/models/RapidAI/RapidOCR/resolve/v3.8.0/onnx/PP-OCRv5"
CATALOG_AT = "https://raw.githubusercontent.com/RapidAI/RapidOCR/main/python/rapidocr/default_models.yaml"
DICTIONARIES_AT = "https://raw.githubusercontent.com/PaddlePaddle/PaddleOCR/main/ppocr/utils/dict"
LICENSE = "Apache-2.0"
DETECTOR = ("ch_PP-OCRv5_det_mobile.onnx", "4d97c44a20d30a81aad087d6a396b08f786c4635742afc391f6621f5c6ae78ae")
CLASSIFIER = ("ch_PP-LCNet_x0_25_textline_ori_cls_mobile.onnx", "54379ae5174d026780215fc748a7f31910dee36818e63d49e17dc598ecc82df7")
# Of each preset the recogniser and the dictionary, each with its digest.
RECOGNISERS = {
    "ko-en": ("korean_PP-OCRv5_rec_mobile.onnx", "cd6e2ea50f6943ca7271eb8c56a877a5a90720b7047fe9c41a2e541a25773c9b", "ppocrv5_korean_dict.txt", "a88071c68c01707489baa79ebe0405b7beb5cca229f4fc94cc3ef992328802d7"),
    "chinese": ("ch_PP-OCRv5_rec_mobile.onnx", "5825fc7ebf84ae7a412be049820b4d86d77620f204a041697b0494669b1742c5", "ppocrv5_dict.txt", "d1979e9f794c464c0d2e0b70a7fe14dd978e9dc644c0e71f14158cdf8342af1b"),
    "english": ("en_PP-OCRv5_rec_mobile.onnx", "c3461add59bb4323ecba96a492ab75e06dda42467c9e3d0c18db5d1d21924be8", "ppocrv5_en_dict.txt", "e025a66d31f327ba0c232e03f407ae8d105e1e709e7ccb3f408aa778c24e70d6"),
    "latin": ("latin_PP-OCRv5_rec_mobile.onnx", "b20bd37c168a570f583afbc8cd7925603890efbcdc000a59e22c269d160b5f5a", "ppocrv5_latin_dict.txt", "ccbcc45730b3fbbd9050c5bc74db6a99067141ef1035e3d14889a84a6b9b1aff"),
    "eslav": ("eslav_PP-OCRv5_rec_mobile.onnx", "08705d6721849b1347d26187f15a5e362c431963a2a62bfff4feac578c489aab", "ppocrv5_eslav_dict.txt", "3e95f1581557162870cacdba5af91a4c6be2890710d395b0c3c7578e7ee5e6eb"),
    "thai": ("th_PP-OCRv5_rec_mobile.onnx", "de541dd83161c241ff426f7ecfd602a0ba77d686cf3ab9a6c255ea82fd08006e", "ppocrv5_th_dict.txt", "57f5406f94bb6688fb7077f7be65f08bbd71cecf48c01ea26c522cb5c4836b7a"),
    "greek": ("el_PP-OCRv5_rec_mobile.onnx", "b4368bccd557123c702b7549fee6cd1e94b581337d1c9b65310f109131542b7f", "ppocrv5_el_dict.txt", "31defc62c0c3ad3674a82da6192226a2ba98ef4ff014a7045cb88d59f9c3de31"),
    "arabic": ("arabic_PP-OCRv5_rec_mobile.onnx", "c1192e632d0baa9146ae5b756a0e635e3dc63c1733737ebfd1629e87144e9295", "ppocrv5_arabic_dict.txt", "7f92f7dbb9b75a4787a83bfb4f6d14a8ab515525130c9d40a9036f61cf6999e9"),
    "cyrillic": ("cyrillic_PP-OCRv5_rec_mobile.onnx", "90f761b4bfcce0c8c561c0cb5c887b0971d3ec01c32164bdf7374a35b0982711", "ppocrv5_cyrillic_dict.txt", "db40aa52ceb112055be80c694afdf655d5d2c4f7873704524cc16a447ca913ba"),
    "devanagari": ("devanagari_PP-OCRv5_rec_mobile.onnx", "d6f0a906580e3fa6b324a318718f1f31f268b6ea8ef985f91c2012a37f52c91e", "ppocrv5_devanagari_dict.txt", "09c7440bfc5477e5c41052304b6b185aff8c4a5e8b2b4c23c1c706f6fe1ee9fc"),
    "tamil": ("ta_PP-OCRv5_rec_mobile.onnx", "a42448808b7dea87597336f12438935f40353f1949e8360acd9e06b4da21bfe1", "ppocrv5_ta_dict.txt", "85b541352ae18dc6ba6d47152d8bf8adff6b0266e605d2eef2990c1bf466117b"),
    "telugu": ("te_PP-OCRv5_rec_mobile.onnx", "a3690451b50028a09a3316a1274f7c05728151ea3f8fd392696397a7fefcbd92", "ppocrv5_te_dict.txt", "42f83f5d3fdb50778e4fa5b66c58d99a59ab7792151c5e74f34b8ffd7b61c9d6"),
}
FILE = "preset_id string, role string, name string, sha256 string, url string, source_url string"


def preset_files(spark: SparkSession) -> DataFrame:
    """The files of every preset, four each: preset_id, role, name, sha256, url (where it is published), source_url (what says so)."""
    rows = []
    for preset, (model, digest, words, words_digest) in RECOGNISERS.items():
        for role, folder, (name, sha) in (("detector", "det", DETECTOR), ("classifier", "cls", CLASSIFIER), ("recognizer", "rec", (model, digest))):
            rows.append((preset, role, name, sha, f"{MODELS_AT}/{folder}/{name}", CATALOG_AT))
        rows.append((preset, "dictionary", words, words_digest, f"{DICTIONARIES_AT}/{words}", f"{DICTIONARIES_AT}/{words}"))
    return spark.createDataFrame(rows, FILE)


@dataclass
class Staged(WriterCommitMessage):
    """What one task wrote: preset_id, name, sha256, source_url, resolved_from and the file."""

    files: list[tuple[str, str, str, str, str, str]]


class PresetWriter(DataSourceWriter):
    """Tasks write files beside the presets and check their digests; the commit moves them and writes the manifests, an abort removes them."""

    def __init__(self, home: str):
        self.home, self.run = home, uuid.uuid4().hex
        self.staged = os.path.join(home, ".staged", self.run)

    def write(self, iterator):
        task = TaskContext.get()
        # each attempt has a folder of its own, so that a task that runs twice never meets its other half
        folder = os.path.join(self.staged, f"{task.partitionId()}-{task.taskAttemptId()}")
        files = []
        for row in iterator:
            if row.content is None:
                raise FileNotFoundError(f"no file for {row.name} of preset {row.preset_id}")
            at = os.path.join(folder, row.preset_id, row.name)
            os.makedirs(os.path.dirname(at), exist_ok=True)
            with open(at, "wb") as out:
                out.write(row.content)
            digest = hashlib.sha256()
            with open(at, "rb") as back:
                while part := back.read(1 << 20):
                    digest.update(part)
            if digest.hexdigest() != row.sha256:
                raise ValueError(f"checksum mismatch for {row.name}: expected {row.sha256}, got {digest.hexdigest()}")
            files.append((row.preset_id, row.name, row.sha256, row.source_url, row.path, at))
        return Staged(files)

    def commit(self, messages):
        presets: dict[str, list] = {}
        for message in messages:
            for preset, *file in message.files if message else ():
                presets.setdefault(preset, []).append(file)
        for preset, files in presets.items():
            final = os.path.join(self.home, "presets", preset, self.run)
            os.makedirs(final)
            for name, *_, at in files:
                os.replace(at, os.path.join(final, name))
        for preset, files in sorted(presets.items()):
            facts = {n: {"sha256": sha, "source_url": source, "resolved_from": path} for n, sha, source, path, _ in sorted(files)}
            head = {"preset_id": preset, "display_name": PRESETS.get(preset, preset), "license": LICENSE, "catalog_source": CATALOG_AT}
            folder = os.path.join(self.home, "presets", preset)
            replace_json(os.path.join(folder, "manifest.json"), head | {"folder": self.run, "files": facts})
            for old in os.scandir(folder):
                if old.is_dir() and old.name != self.run:
                    shutil.rmtree(old.path, ignore_errors=True)
        shutil.rmtree(self.staged, ignore_errors=True)

    def abort(self, messages):
        shutil.rmtree(self.staged, ignore_errors=True)
        for preset in Path(self.home, "presets").glob(f"*/{self.run}"):
            manifest = preset.parent / "manifest.json"
            if not manifest.exists() or json.loads(manifest.read_text())["folder"] != self.run:
                shutil.rmtree(preset, ignore_errors=True)


class PresetSink(DataSource):
    """Writes rows of preset_id, name, sha256, source_url, path and content into the folder ``home``, which driver and executors share."""

    @classmethod
    def name(cls):
        return "model_presets"

    def writer(self, schema, overwrite):
        return PresetWriter(self.options["home"])


def replace_json(path: str, value: dict) -> None:
    beside = f"{path}.{uuid.uuid4().hex}"
    with open(beside, "w", encoding="utf-8") as out:
        json.dump(value, out, ensure_ascii=False, indent=2)
    os.replace(beside, path)


def installed_files(spark: SparkSession, home: str) -> DataFrame:
    """preset_id, name, sha256 and path of the files that manifests name and that are there."""
    os.makedirs(os.path.join(home, "presets"), exist_ok=True)
    kinds = "preset_id string, folder string, files map<string, struct<sha256: string>>"
    scan = lambda: spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{home}/presets")
    manifests = scan().where(F.col("path").endswith("/manifest.json")).select(F.from_json(F.col("content").cast("string"), kinds).alias("m"))
    named = manifests.select("m.preset_id", "m.folder", F.explode("m.files").alias("name", "f")).select("preset_id", "folder", "name", "f.sha256")
    part = lambda n: F.element_at(F.split("path", "/"), n)
    there = scan().select("path").withColumn("preset_id", part(-3)).withColumn("folder", part(-2)).withColumn("name", part(-1))
    return named.join(there, ["preset_id", "folder", "name"]).drop("folder")


def missing_presets(spark: SparkSession, home: str, wanted: DataFrame) -> DataFrame:
    """The presets of ``wanted`` (files as of ``preset_files``) of which not all files, with their digests, are installed."""
    lost = wanted.join(installed_files(spark, home), ["preset_id", "name", "sha256"], "left_anti")
    return lost.select("preset_id").distinct()


def install(spark: SparkSession, home: str, presets: list[str], files: DataFrame, catalogue: DataFrame | None = None, force: bool = False, activate: bool = True) -> None:
    """Install presets from ``files`` (path, content); those that are whole already stay untouched unless ``force`` is set. The last one becomes the active one.

    Of several files of a name one with the right digest is taken, else the first path. A file that is missing or has another digest is an error, and
    leaves what was installed as it was. ``files`` is read twice, so that digests alone, and never contents, are compared between rows.
    """
    catalogue = preset_files(spark) if catalogue is None else catalogue
    known = {r.preset_id for r in catalogue.where(F.col("preset_id").isin(presets)).select("preset_id").distinct().collect()}
    for preset in presets:
        if preset not in known:
            raise ValueError(f"unknown preset: {preset}")
    wanted = catalogue.where(F.col("preset_id").isin(presets))
    if not force:
        wanted = wanted.join(missing_presets(spark, home, wanted), "preset_id", "left_semi")
    at_hand = files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("_sha"))
    order = Window.partitionBy("preset_id", "name").orderBy((F.col("_sha") == F.col("sha256")).desc_nulls_last(), "path")
    picked = wanted.join(at_hand, "name", "left").withColumn("_k", F.row_number().over(order)).where("_k = 1")
    rows = picked.join(files.select("path", "content"), "path", "left").select("preset_id", "name", "sha256", "source_url", "path", "content")
    if not wanted.isEmpty():
        spark.dataSource.register(PresetSink)
        rows.write.format("model_presets").option("home", home).mode("append").save()
    if activate and presets:
        set_active(spark, home, presets[-1], catalogue)


def set_active(spark: SparkSession, home: str, preset: str, catalogue: DataFrame | None = None) -> None:
    """Make an installed preset the active one."""
    wanted = (preset_files(spark) if catalogue is None else catalogue).where(F.col("preset_id") == preset)
    if wanted.isEmpty():
        raise ValueError(f"unknown preset: {preset}")
    if not missing_presets(spark, home, wanted).isEmpty():
        raise FileNotFoundError(f"preset {preset} is not installed")
    replace_json(os.path.join(home, "active_preset.json"), {"preset_id": preset})


def active(home: str) -> str | None:
    path = Path(home, "active_preset.json")
    return (json.loads(path.read_text(encoding="utf-8")).get("preset_id") or None) if path.exists() else None

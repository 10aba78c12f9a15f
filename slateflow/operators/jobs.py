"""Jobs over decks: their states, their model presets, their settings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# What may follow each state, and the presets with their names.
TRANSITIONS = {
    "uploaded": ("prepared", "failed"),
    "prepared": ("processing", "failed"),
    "processing": ("awaiting_review", "completed", "failed"),
    "awaiting_review": ("rebuilding_slide", "building_deck", "failed"),
    "rebuilding_slide": ("awaiting_review", "failed"),
    "building_deck": ("completed", "failed"),
    "completed": (),
    "failed": (),
}
PRESETS = {
    "ko-en": "Korean + English",
    "chinese": "Chinese Simplified",
    "english": "English",
    "latin": "Latin",
    "eslav": "Eslav",
    "thai": "Thai",
    "greek": "Greek",
    "arabic": "Arabic",
    "cyrillic": "Cyrillic",
    "devanagari": "Devanagari",
    "tamil": "Tamil",
    "telugu": "Telugu",
}
# The names by which each kind of backend goes.
BACKENDS = {"detector": {"ocr": "full_slide", "full-slide": "full_slide", "full_slide": "full_slide"}, "ocr": {"portable": "portable", "rapidocr": "portable", "auto": "portable"}, "inpainter": {"cv2": "telea", "telea": "telea", "opencv": "telea", "opencv_telea": "telea"}}


@dataclass(frozen=True)
class Settings:
    """What a run of the layout operators is told."""

    korean_font: str = "Pretendard"
    latin_font: str = "Pretendard"
    text_color: tuple[int, int, int] = (0, 0, 0)
    min_font_size_pt: float = 10.0
    max_font_size_pt: float = 44.0
    dpi: int = 96
    pdf_dpi: int = 144
    detector: str = "ocr"
    ocr: str = "portable"
    inpainter: str = "telea"
    ocr_language: str = "ko+en"
    inpaint_radius: float = 3.0
    feather_px: int = 2

    def backend(self, kind: str) -> str:
        """The backend that a setting names; an unknown name is an error."""
        name = getattr(self, kind).strip().lower()
        if name not in BACKENDS[kind]:
            raise ValueError(f"unsupported {kind}: {name}")
        return BACKENDS[kind][name]


def allowed(before: Column, after: Column) -> Column:
    """Whether a state may follow another; a job begins uploaded."""
    table = F.create_map(*(x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)) if v else F.array().cast("array<string>"))))
    return F.when(before.isNull(), after == "uploaded").otherwise(F.coalesce(F.array_contains(table[before], after), F.lit(False)))


def transitions(events: DataFrame, job: str, order: str, state: str = "state") -> DataFrame:
    """Add before and allowed to the states that each job reports, in order."""
    before = F.lag(state).over(Window.partitionBy(job).orderBy(order))
    return events.withColumn("before", before).withColumn("allowed", allowed(F.col("before"), F.col(state)))


def latest_states(events: DataFrame, job: str, order: str, state: str = "state") -> DataFrame:
    return events.groupBy(job).agg(F.max_by(state, order).alias(state), F.count("*").alias("n_events"))


def preset_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(PRESETS.items())], "ord int, preset_id string, name string")


def installed_presets(manifests: DataFrame, path: str = "path") -> DataFrame:
    """preset_id of folders with a manifest, from the manifests' paths."""
    return manifests.select(F.regexp_extract(path, r"([^/]+)/manifest\.json$", 1).alias("preset_id")).where("preset_id <> ''").distinct()


def flag_presets(presets: DataFrame, installed: DataFrame, active: DataFrame, default: str = "ko-en") -> DataFrame:
    """Add installed, active and default."""
    mark = lambda df, name: df.select("preset_id").distinct().withColumn(name, F.lit(True))
    rows = presets.join(mark(installed, "installed"), "preset_id", "left").join(mark(active, "active"), "preset_id", "left")
    return rows.select(*presets.columns, F.coalesce("installed", F.lit(False)).alias("installed"), F.coalesce("active", F.lit(False)).alias("active"), (F.col("preset_id") == default).alias("default"))


def resolve_presets(requests: DataFrame, installed: DataFrame, bundled: Column | bool = False) -> DataFrame:
    """Add preset and source to ``requests`` (requested, active): what is asked for, else what is active, else what is bundled.

    A preset that isn't installed, or nothing at all, is an error: its message is in ``problem``.
    """
    there = installed.select(F.col("preset_id").alias("preset"), F.lit(True).alias("_there")).distinct()
    rows = requests.withColumn("preset", F.coalesce("requested", "active")).join(there, "preset", "left")
    bundled = bundled if isinstance(bundled, Column) else F.lit(bundled)
    source = F.when(F.col("_there"), "preset").when(F.col("preset").isNull() & bundled, "bundled")
    problem = F.when(source.isNotNull(), None).when(F.col("preset").isNotNull(), F.concat(F.lit("not installed: "), "preset")).otherwise("no models")
    return rows.select(*requests.columns, "preset", source.alias("source"), problem.alias("problem"))


def verified(files: DataFrame, expected: DataFrame, name: str = "name", content: str = "content") -> DataFrame:
    """Files with sha256 and whether it is the expected one; a file of which no digest is known isn't verified."""
    rows = files.withColumn("sha256", F.sha2(content, 256)).join(expected.select(name, F.lower("sha256").alias("_want")), name, "left")
    return rows.select(*files.columns, "sha256", F.coalesce(F.col("sha256") == F.col("_want"), F.lit(False)).alias("verified"))


def new_job_ids(rows: DataFrame) -> DataFrame:
    """Add job_id (12 hex digits) and created_at."""
    return rows.withColumn("job_id", F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 12)).withColumn("created_at", F.current_timestamp())


def save_records(records: DataFrame, path: str, job: str = "job_id") -> None:
    """Job records as one folder per job; a job that is saved again replaces its folder alone."""
    records.write.partitionBy(job).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def load_record(spark: SparkSession, path: str, job_id: str, job: str = "job_id") -> DataFrame:
    """The record of one job, read from its folder alone; a missing job is an error."""
    found = spark.read.parquet(path).where(F.col(job) == job_id)
    if found.isEmpty():
        raise FileNotFoundError(f"no job {job_id}")
    return found

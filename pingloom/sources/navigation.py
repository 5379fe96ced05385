"""Navigation tracks, missions and labels from text: everything is read as strings and judged by rules as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FIELDS = ("frame", "timestamp_utc", "latitude", "longitude", "heading_deg", "speed_mps", "altitude_m", "ping_start", "ping_end")
REQUIRED = FIELDS[:4]


def scan_navigation_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of navigation CSV files with a header, all strings, with their ``file`` and ``row`` in it (the header is row 1).

    Columns are found by name; optional ones may be absent, a missing required one fails. Rows are numbered by the place
    of their split in the file, then by their order in the split, whatever the tasks' order is.
    """
    raw = spark.read.csv(path, header=True, inferSchema=False)
    if lost := [f for f in REQUIRED if f not in raw.columns]:
        raise ValueError(f"missing required columns: {', '.join(lost)}")
    cols = [F.col(f) if f in raw.columns else F.lit(None).cast("string").alias(f) for f in FIELDS]
    rows = raw.select(*cols, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_m"))
    return rows.withColumn("row", F.row_number().over(W.partitionBy("file").orderBy("_b", "_m")) + 1).drop("_b", "_m")


def first_problems(rows: DataFrame) -> DataFrame:
    """``row, field, problem`` (and ``file`` if there is one): the first rule that each bad row breaks, in the order of the rules.

    A frame stands once in a file: later rows of the same (trimmed) frame are duplicates. Times, and all numbers but
    latitude and longitude, may be empty.
    """
    file = ["file"] if "file" in rows.columns else []

    def number(name: str, low: float | None = None, high: float | None = None, needed: bool = True) -> Column:
        x = F.col(name).try_cast("double")
        empty = F.trim(F.coalesce(F.col(name), F.lit(""))) == ""
        bad = x.isNull() | F.isnan(x)
        if low is not None:
            bad = bad | (x < low) | (x > high)
        return F.when(empty, F.lit("missing") if needed else F.lit(None)).when(bad, "invalid")

    frame = F.trim(F.coalesce("frame", F.lit("")))
    rules = [
        ("frame", F.when(frame == "", "missing").when(F.col("_nth") > 1, "duplicate")),
        ("latitude", number("latitude", -90, 90)),
        ("longitude", number("longitude", -180, 180)),
        ("timestamp_utc", F.when((F.trim(F.coalesce("timestamp_utc", F.lit(""))) != "") & F.try_to_timestamp(F.trim("timestamp_utc")).isNull(), "invalid")),
        *[(c, number(c, needed=False)) for c in ("heading_deg", "speed_mps", "altitude_m")],
        *[(c, F.when((F.trim(F.coalesce(c, F.lit(""))) != "") & ~F.trim(c).rlike("^[+-]?[0-9]+$"), "invalid")) for c in ("ping_start", "ping_end")],
    ]
    rows = rows.withColumn("_nth", F.row_number().over(W.partitionBy(*file, frame).orderBy("row")))
    first = F.coalesce(*[F.when(p.isNotNull(), F.struct(F.lit(n).alias("field"), p.alias("problem"))) for n, p in rules])
    return rows.select(*file, "row", first.alias("p")).filter("p is not null").select(*file, "row", "p.field", "p.problem")


def valid_fixes(rows: DataFrame) -> DataFrame:
    """Typed rows without a problem."""
    keys = [c for c in ("file", "row") if c in rows.columns]
    bad = first_problems(rows).select(*keys)
    d = lambda c: F.col(c).try_cast("double").alias(c)
    n = lambda c: F.trim(c).try_cast("bigint").alias(c)
    return rows.join(bad, keys, "left_anti").select(*keys, F.trim("frame").alias("frame"), F.try_to_timestamp(F.nullif(F.trim("timestamp_utc"), F.lit(""))).alias("ts"), d("latitude"), d("longitude"), d("heading_deg"), d("speed_mps"), d("altitude_m"), n("ping_start"), n("ping_end"))


MISSION = "mission_id string, survey_name string, sequential boolean, mode string, evidence boolean, provenance string"


def parse_missions(lines: DataFrame, column: str = "value") -> DataFrame:
    """Typed mission fields of JSON text; a provenance that only the system may set is refused."""
    m = lines.select(F.from_json(column, MISSION).alias("m")).select("m.*")
    provenance = F.upper(F.trim("provenance"))
    return m.select(
        "mission_id", "survey_name",
        (F.coalesce("sequential", F.lit(False)) | ((F.coalesce("mode", F.lit("")) == "SEQUENTIAL_PING") & F.coalesce("evidence", F.lit(False)))).alias("sequential_supported"),
        F.when(provenance.isin("MEASURED", "SYNTHETIC_DEMO"), provenance).alias("provenance"),
        F.when(provenance == "DERIVED_FROM_SOURCE", "SYSTEM_ONLY_PROVENANCE").when(provenance.isNotNull() & ~provenance.isin("MEASURED", "SYNTHETIC_DEMO"), "UNKNOWN_PROVENANCE").alias("problem"),
    )


def yolo_boxes(lines: DataFrame, width: int, height: int, predictions: bool = False) -> DataFrame:
    """``name, cls, x1, y1, x2, y2, confidence`` of ``cls cx cy w h`` lines; a sixth token is a confidence (else null).

    Lines of labels of fewer than five tokens are skipped. A line of ``predictions`` must have six, and fails otherwise.
    """
    t = lines.withColumn("t", F.split(F.trim("line"), "\\s+"))
    told = F.concat(F.lit("unsupported prediction line: "), F.col("name").cast("string"), F.lit(": "), F.col("line"))
    t = t.withColumn("t", F.when(F.size("t") == 6, F.col("t")).otherwise(F.raise_error(told).cast("array<string>"))) if predictions else t.filter(F.size("t") >= 5)
    n = lambda i: F.col("t")[i].cast("double")
    return t.select("name", n(0).cast("int").alias("cls"), ((n(1) - n(3) / 2) * width).alias("x1"), ((n(2) - n(4) / 2) * height).alias("y1"), ((n(1) + n(3) / 2) * width).alias("x2"), ((n(2) + n(4) / 2) * height).alias("y2"), F.when(F.size("t") > 5, F.get("t", F.lit(5)).try_cast("double")).alias("confidence"))


STATE = {"t": ("t", "time", "timestamp"), "lat": ("lat", "latitude"), "lon": ("lon", "longitude"), "heading": ("heading", "heading_deg"), "speed": ("speed", "speed_mps")}


def estimated_state(raw: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and t, lat, lon, heading, speed from headers of any case and of several names; empty or absent: null."""
    names = {c.lower(): c for c in raw.columns}

    def one(field: str, found: tuple[str, ...]) -> Column:
        texts = [F.nullif(F.trim(F.col(names[n])), F.lit("")) for n in found if n in names]
        return (F.coalesce(*texts) if texts else F.lit(None)).cast("bigint" if field == "t" else "double").alias(field)

    return raw.select(*keep, *[one(f, n) for f, n in STATE.items()])


def known_category(category: Column, known: tuple[str, ...]) -> Column:
    """The category; one that is not known fails."""
    return F.when(category.isin(*known), category).otherwise(F.raise_error(F.concat(F.lit("unknown category "), F.coalesce(category, F.lit("null")))).cast("string"))


def write_immutable(df: DataFrame, path: str) -> None:
    """Write JSON lines once; an existing target is refused."""
    df.write.mode("errorifexists").json(path)

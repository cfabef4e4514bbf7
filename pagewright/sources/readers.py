"""Files as DataFrames: page sessions, manifests, strict and tolerant JSON lines, blocks of tab-separated text, listings."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagewright.operators.pages import java_pattern, page_number

RECTANGLE = "struct<rect_id: string, draw_order: int, x: int, y: int, width: int, height: int>"
REGION = f"struct<rectangle: {RECTANGLE}, text: string, ocr_status: string, ocr_error: string, ocr_completed_at: timestamp>"
SESSION = f"image_name string, image_width int, image_height int, regions array<{REGION}>, schema_version int"
MANIFEST = (
    "schema_version int, book_id string, title string, input_glob string, page_pattern string, default_document_type string, default_audience string, "
    "audience_overrides array<struct<start_page: int, end_page: int, audience: string>>, document_type_overrides array<struct<start_page: int, end_page: int, document_type: string>>"
)
SEGMENT = (
    "schema_version int, segment_id string, parent_segment_id string, book_id string, document_type string, section_path array<string>, content_type string, audience string, inherited_audience string, "
    "source_spans array<struct<page: int, rect_id: string, start: int, end: int>>, raw_text string, normalized_text string, entities array<string>, "
    "normalization_ops array<struct<type: string, rule_id: string, details: map<string, string>>>, field_confidence map<string, string>, processing map<string, string>, review_status string"
)
DECISION = "review_id string, segment_id string, status string, input_hash string, processing_version string, decided_by string, comment string"
GOLD_QUERY = "query_id string, text string, relevant_ids array<string>, query_type string"
GOLD_SEGMENTS = "gold-segments.jsonl"
#: What recognition always gets wrong, and how it is spelled.
CORRECTIONS = {"NOVA": "N◎VA"}
IMAGE_ENDINGS = (".png", ".jpg", ".jpeg", ".webp", ".gif", ".tif", ".tiff", ".pdf")
#: Pages of one external text recognition request.
PAGES_PER_REQUEST = 15


def json_records(spark: SparkSession, path: str, schema: str | StructType, lines: bool = True) -> DataFrame:
    """JSON lines (or one document per file), failing on anything malformed; blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", not lines).json(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return json_records(spark, path, MANIFEST, lines=False)


def gold_segments(spark: SparkSession, path: str) -> DataFrame:
    """Gold segments from a file of lines, or from the file of that name in a folder."""
    return json_records(spark, path if path.rstrip("/").endswith(".jsonl") else f"{path.rstrip('/')}/{GOLD_SEGMENTS}", SEGMENT)


def tolerant_lines(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """JSON lines in file order: path, line_no and the parsed object; lines that are no object are left out, their numbers are kept."""
    kind = schema.simpleString() if isinstance(schema, StructType) else schema
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    lines = files.select("path", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line")).where(F.trim("line").startswith("{"))
    parsed = lines.withColumn("record", F.from_json("line", kind)).where("record is not null")
    # from_json gives a struct of nulls for a malformed line: such a line has no top-level keys
    return parsed.where(F.json_object_keys("line").isNotNull()).select("path", "line_no", "record")


def page_sessions(spark: SparkSession, folder: str, glob: str, pattern: str, book_id: str) -> DataFrame:
    """One row per session file: book_id, page, source_sha256 and the session's fields; a file name without page or two files of one page fail."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return parsed_sessions(files.select(F.lit(book_id).alias("book_id"), "path", "content"), pattern)


def parsed_sessions(files: DataFrame, pattern: str) -> DataFrame:
    """The same from files at hand: book_id, path, content."""
    java, group = java_pattern(pattern)
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.select("book_id", name.alias("file_name"), page_number(name, java, group).alias("page"), F.sha2("content", 256).alias("source_sha256"), F.from_json(F.col("content").cast("string"), SESSION, {"mode": "FAILFAST"}).alias("s"))
    count = F.count("*").over(Window.partitionBy("book_id", "page"))
    problem = F.when(F.col("page").isNull(), F.concat(F.lit("no page number in "), F.col("file_name"))).when(count > 1, F.concat(F.lit("several files for page "), F.col("page").cast("string")))
    rows = rows.withColumn("problem", problem)
    checked = rows.where(F.when(F.col("problem").isNotNull(), F.raise_error(F.col("problem")).cast("boolean")).otherwise(F.lit(True)))
    ordered = F.array_sort("s.regions", lambda a, b: a["rectangle"]["draw_order"] - b["rectangle"]["draw_order"])
    return checked.select("book_id", "file_name", "page", "source_sha256", "s.image_name", "s.image_width", "s.image_height", ordered.alias("regions"))


def tsv_blocks(spark: SparkSession, path: str, glob: str = "*.tsv") -> DataFrame:
    """Blocks `## type`, header and rows of tab-separated text: source, block_no, type_name, fields, rows (array of arrays)."""
    files = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("source"), "value")
    return parse_tsv_blocks(files, "source", "value")


def parse_tsv_blocks(df: DataFrame, source: str, text: str) -> DataFrame:
    blocks = df.select(F.col(source).alias("source"), F.posexplode(F.split(F.col(text), "\n\n")).alias("block_no", "b"))
    lines = F.filter(F.split("b", "\r\n|\r|\n"), lambda line: F.trim(line) != "")
    rows = blocks.withColumn("l", lines).where((F.size("l") >= 2) & F.get("l", F.lit(0)).startswith("## "))
    cells = F.transform(F.slice("l", 3, 1 << 30), lambda r: F.split(r, "\t"))
    return rows.select("source", "block_no", F.trim(F.substring(F.get("l", F.lit(0)), 4, 1 << 30)).alias("type_name"), F.split(F.get("l", F.lit(1)), "\t").alias("fields"), cells.alias("rows"))


def proposed_schema(blocks: DataFrame) -> DataFrame:
    """type_name, fields in order of first appearance over all blocks, and the source that named the type first."""
    seen = blocks.select("type_name", F.struct("source", "block_no").alias("at"), F.posexplode("fields").alias("pos", "field"))
    first = seen.groupBy("type_name", "field").agg(F.min(F.struct("at", "pos")).alias("p"))
    out = first.groupBy("type_name").agg(F.array_sort(F.collect_list(F.struct("p", "field"))).alias("f"), F.min("p.at")["source"].alias("source"))
    return out.select("type_name", F.transform("f", lambda x: x["field"]).alias("fields"), "source")


def images(spark: SparkSession, folder: str) -> DataFrame:
    """path, name and stem of the image files of a folder, by name; contents are not read."""
    return image_names(spark.read.format("binaryFile").option("pathGlobFilter", "*").load(folder).select("path")).orderBy("name")


def image_names(files: DataFrame) -> DataFrame:
    """The images among files (path): path, name and stem."""
    name = F.element_at(F.split("path", "/"), -1)
    named = files.select("path", name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"))
    return named.where(F.lower("name").rlike("(" + "|".join(e.replace(".", r"\.") for e in IMAGE_ENDINGS) + ")$"))


def safe_name(name: str) -> str:
    """A name below the folder it is looked up in, or a ValueError."""
    p = PurePosixPath(name)
    if p.is_absolute() or ".." in p.parts or not p.parts:
        raise ValueError(f"{name!r} leaves the folder")
    return str(p)


def request_chunks(pages: DataFrame, page: str, size: int = PAGES_PER_REQUEST) -> DataFrame:
    """Adds chunk: the request a page (from 1) is sent with."""
    return pages.withColumn("chunk", F.floor((F.col(page) - 1) / size).cast("int"))


def session_times(lines: DataFrame, path: str, line_no: str, timestamp: str) -> DataFrame:
    """path and the last timestamp in file order of each session log, newest first."""
    last = lines.groupBy(path).agg(F.max_by(timestamp, F.when(F.col(timestamp).isNotNull(), F.col(line_no))).alias("timestamp"))
    return last.orderBy(F.desc("timestamp"), path)


def select_session(lines: DataFrame, path: str, timestamp: str, session: str, wanted: str) -> DataFrame:
    """The newest log whose file name or any record's session is ``wanted``: path and timestamp, at most one row."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    hits = lines.groupBy(path).agg(F.bool_or((stem == wanted) | F.coalesce(F.col(session) == wanted, F.lit(False))).alias("hit"), F.max(timestamp).alias("timestamp"))
    return hits.where("hit").orderBy(F.desc("timestamp"), path).select(path, "timestamp").limit(1)


def newest_logs(lines: DataFrame, path: str, timestamp: str, session: str) -> DataFrame:
    """For every session the newest log whose records name it (of equally new ones the last by path): session, path, timestamp."""
    times = lines.groupBy(path).agg(F.max(timestamp).alias("timestamp"))
    named = lines.where(F.col(session).isNotNull()).select(session, path).distinct().join(times, path)
    best = named.groupBy(session).agg(F.max(F.struct(F.coalesce("timestamp", F.lit("")).alias("at"), path, "timestamp")).alias("b"))
    return best.select(session, f"b.{path}", "b.timestamp")


def sessions_or_empty(images_: DataFrame, sessions: DataFrame, name: str = "image_name") -> DataFrame:
    """Every image with its session's regions, none where it has no session yet."""
    return images_.join(sessions.select(name, "regions"), name, "left").withColumn("regions", F.coalesce("regions", F.array().cast(sessions.schema["regions"].dataType)))


def cached_blocks(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Stored detections that still fit: unreadable files and those of another image name count as missing. wanted: (stem, image_name)."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/.]+)[^/]*$", 1).alias("stem"), "value")
    return fitting_blocks(files, wanted)


def fitting_blocks(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """The same from files at hand: stem, value."""
    kind = "image_name string, image_width int, image_height int, blocks array<struct<x: int, y: int, width: int, height: int>>, detected_at timestamp"
    files = files.select("stem", F.from_json("value", kind, {"mode": "PERMISSIVE"}).alias("c"))
    return wanted.join(files.where("c.image_name is not null and c.blocks is not null"), "stem").where("c.image_name = image_name").select("stem", "image_name", "c.image_width", "c.image_height", "c.blocks")


def block_regions(df: DataFrame, *keys: str) -> DataFrame:
    """Recognised blocks as page regions: corners 1 and 3 of the normalised outline in whole pixels, the first 100 characters of their text.

    df: page_width, page_height, text, blocks array<struct<vertices: array<struct<x, y>>, segments: array<struct<start, end>>, confidence>>;
    blocks with under four corners are left out.
    """
    rows = df.select(*keys, "page_width", "page_height", "text", F.posexplode("blocks").alias("block_no", "b")).where("size(b.vertices) >= 4")
    at = lambda k, axis, size: (F.get("b.vertices", F.lit(k))[axis] * F.col(size)).cast("int")
    words = F.array_join(F.transform("b.segments", lambda s: F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"])), "")
    return rows.select(*keys, "block_no", at(0, "x", "page_width").alias("left"), at(0, "y", "page_height").alias("top"), at(2, "x", "page_width").alias("right"), at(2, "y", "page_height").alias("bottom"), F.col("b.confidence").alias("confidence"), F.substring(words, 1, 100).alias("snippet"))


def joined_recognition(chunks: DataFrame, keys: list[str], replacements: dict[str, str]) -> DataFrame:
    """Texts of a document's requests in order, one below the other, with fixed literal corrections."""
    texts = chunks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("chunk", "text"))).alias("c"))
    out = F.array_join(F.transform("c", lambda x: x["text"]), "\n")
    for old, new in replacements.items():
        out = F.replace(out, F.lit(old), F.lit(new))
    return texts.select(*keys, out.alias("text"))


def log_folder(path: str) -> str:
    """The name of a project's log folder: its path with hyphens."""
    return path.replace("/", "-")

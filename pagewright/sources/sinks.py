"""Results as files: JSON lines with nulls, texts per key, several outputs published together."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def as_json_lines(df: DataFrame) -> DataFrame:
    """One column: each row as a JSON object in which null fields stay."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_json_lines(df: DataFrame, path: str) -> None:
    as_json_lines(df).write.mode("overwrite").text(path)


def write_texts(df: DataFrame, key: str, text: str, path: str) -> None:
    """One folder per key (key=...), with its texts; written by the executors."""
    df.select(F.col(key), F.col(text).alias("value")).write.mode("overwrite").partitionBy(key).text(path)


def upsert_by_key(new: DataFrame, old: DataFrame | None, keys: list[str]) -> DataFrame:
    """A result table with the rows of ``new`` in place of those with their keys."""
    return new if old is None else old.join(new.select(*keys), keys, "left_anti").unionByName(new)


class _Folder:
    """A folder of any file system the cluster knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.root, self._jvm = root.rstrip("/"), spark.sparkContext._jvm
        self._fs = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self.path(name))

    def remove(self, name: str) -> None:
        self._fs.delete(self.path(name), True)

    def make(self, name: str) -> None:
        self._fs.mkdirs(self.path(name))

    def move(self, name: str, to: str) -> None:
        if not self.exists(name) or not self._fs.rename(self.path(name), self.path(to)):
            raise OSError(f"{name} can't be moved to {to}")

    def read(self, name: str) -> str | None:
        if not self.exists(name):
            return None
        stream = self._fs.open(self.path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self._fs.create(self.path(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()


def publish(spark: SparkSession, folder: str, writers: dict[str, Callable[[str], None]], manifest: str = "manifest.json") -> list[str]:
    """Writes several outputs beside the old ones and puts them in place together; after an error all old ones are back.

    ``writers`` maps an output's name to what writes it to a path. Outputs the last manifest names and
    this call does not are removed. Works on any file system Spark can write; returns the removed names.
    """
    at = _Folder(spark, folder)
    stage, backup = ".stage", ".backup"
    for d in (stage, backup):
        at.remove(d)
        at.make(d)
    stale = sorted(set(managed(at.read(manifest))) - set(writers))
    moved: list[str] = []
    fresh: list[str] = []
    try:
        for name, write in writers.items():
            write(f"{at.root}/{stage}/{name}")
        at.write(f"{stage}/{manifest}", json.dumps({"version": 1, "files": sorted(writers)}, ensure_ascii=False))
        for name in [*writers, *stale, manifest]:
            if at.exists(name):
                at.move(name, f"{backup}/{name}")
                moved.append(name)
        for name in [*writers, manifest]:
            at.move(f"{stage}/{name}", name)
            fresh.append(name)
    except BaseException:
        for name in fresh:
            at.remove(name)
        for name in moved:
            at.move(f"{backup}/{name}", name)
        raise
    finally:
        at.remove(stage)
        at.remove(backup)
    return stale


def managed(manifest: str | None) -> list[str]:
    """Names a manifest lists; none if it is missing, unreadable or names a path outside its folder."""
    try:
        names = json.loads(manifest or "")["files"]
    except (ValueError, KeyError, TypeError):
        return []
    return names if all(isinstance(n, str) and not PurePosixPath(n).is_absolute() and ".." not in PurePosixPath(n).parts for n in names) else []


#: Endings of the outputs of other modes, and folders of work in progress.
RESERVED_ENDINGS = (".docai.tsv", ".gamedata.tsv", ".structured.tsv", ".schema.tsv")
WORK_FOLDERS = (".stage", ".backup", ".cache")


def is_legacy_output(name: Column) -> Column:
    """Whether a file that no manifest names is taken for an output of an older version: tab-separated text of no other mode and of no work folder."""
    own = name.endswith(".tsv")
    for e in RESERVED_ENDINGS:
        own = own & ~name.endswith(e)
    return own & ~F.substring_index(name, "/", 1).isin(*WORK_FOLDERS)


#: The sections of a structured page and their fields, in order; lone dashes become hyphens in those marked.
SECTIONS = {
    "organizations": ("組織", ["name", "classification", "sub_organizations", "headquarters", "description"], False),
    "skills": ("技能", ["name", "ruby", "prerequisite", "max_level", "timing", "target", "range", "target_value", "opposed", "description"], True),
    "equipment": ("装備", ["name", "ruby", "category", "type", "purchase", "concealment", "defense_s", "defense_p", "defense_i", "restriction", "electric_restriction", "slot", "description"], True),
    "rules": ("ルール", ["depth", "title", "body"], False),
}


def _line(fields: list[str], lists: list[bool], finish: Callable) -> Callable:
    def line(row):
        cells = [F.array_join(row[f], ", ") if is_list else row[f].cast("string") for f, is_list in zip(fields, lists)]
        return F.concat_ws("\t", *[finish(F.coalesce(c, F.lit(""))) for c in cells])

    return line


def structured_tsv(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the tab-separated text of each page: a block per section that has rows. Null fields are empty, lists joined by commas.

    df has an array of structs per section; rules come as flat rows with their depth, parents first.
    """
    from pyspark.sql.types import ArrayType

    from pagewright.operators.typed import dash

    blocks = []
    for name, (title, fields, dashed) in SECTIONS.items():
        if name not in df.columns:
            continue
        kinds = df.schema[name].dataType.elementType

        lines = F.transform(name, _line(fields, [isinstance(kinds[f].dataType, ArrayType) for f in fields], dash if dashed else lambda v: v))
        head = "## " + title + "\n" + "\t".join(fields)
        blocks.append(F.when(F.size(name) > 0, F.concat(F.lit(head + "\n"), F.array_join(lines, "\n"))))
    text = F.concat_ws("\n\n", *blocks)
    return df.select(*keys, F.when(text == "", "").otherwise(F.concat(text, F.lit("\n"))).alias("tsv"))


def schema_lines(schema: DataFrame) -> DataFrame:
    """One line per type: its name and fields. schema: type_name, fields."""
    return schema.select(F.concat_ws("\t", "type_name", F.array_join("fields", "\t")).alias("value"))


def card_meta(cards: DataFrame, page: str, order: list[str]) -> DataFrame:
    """Cards with their file name (three digits, from 1 in order) and confidence to four places, halves to even."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(page).orderBy(*order))
    return cards.withColumn("card", n).withColumns({"file": F.concat(F.col(page).cast("string"), F.lit("_"), F.lpad(F.col("card").cast("string"), 3, "0"), F.lit(".png")), "confidence": F.bround("confidence", 4)})


def metric_lines(metrics: DataFrame) -> DataFrame:
    """A row of metrics as lines name=value, ratios to four places."""
    cells = [F.concat(F.lit(f"{f.name}="), F.format_string("%.4f", f.name) if f.dataType.simpleString() == "double" else F.col(f.name).cast("string")) for f in metrics.schema]
    return metrics.select(F.concat_ws("\n", *cells).alias("value"))


def handoff_markdown(sessions: DataFrame) -> DataFrame:
    """One page per session: title, tasks as a table, reports, next work. sessions: session, title, tasks (array of id, subject, status), reports, next_work."""
    from pagewright.operators.handoff import bullets, escape_cell

    rows = F.transform("tasks", lambda t: F.concat(F.lit("| "), t["id"], F.lit(" | "), escape_cell(t["subject"]), F.lit(" | "), t["status"], F.lit(" |")))
    table = F.concat_ws("\n", F.lit("| id | subject | status |"), F.lit("| --- | --- | --- |"), F.array_join(rows, "\n"))
    text = F.concat_ws("\n\n", F.concat(F.lit("# "), F.coalesce("title", "session")), F.lit("## Tasks"), table, F.lit("## Next"), bullets(F.col("next_work")), F.lit("## Reports"), F.array_join("reports", "\n\n"))
    return sessions.select("session", text.alias("markdown"))

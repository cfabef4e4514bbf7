"""Typed records of open shape: schemas found and checked, rows routed to types, results reused by fingerprint."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# A lone dash in any of these forms is written as a hyphen.
DASHES = ["一", "－", "ー", "−", "-", "–", "—", "―"]
#: Miss reasons in the order in which they are tested.
MISSES = [
    "missing", "corrupted", "cache_version_mismatch", "schema_mismatch", "prompt_mismatch", "model_mismatch", "extractor_mismatch",
    "result_schema_mismatch", "validator_mismatch", "source_mismatch", "invalid_shape",
]


def dash(value: Column) -> Column:
    return F.when(value.isin(DASHES), "-").otherwise(value)


def file_name(name: Column, limit: int = 200) -> Column:
    """A type's name as part of a file name: unsafe characters as _, no blanks or dots at the ends, at most ``limit`` bytes, never empty."""
    safe = F.regexp_replace(F.regexp_replace(name, r'[\\/:*?"<>|\x00-\x1f]', "_"), r"^[ .]+|[ .]+$", "")
    # the longest prefix of whole characters within the limit
    fits = F.aggregate(F.split(safe, ""), F.struct(F.lit("").alias("t"), F.lit(0).alias("n")), lambda a, c: F.when(a["n"] + F.octet_length(c) <= limit, F.struct(F.concat(a["t"], c).alias("t"), (a["n"] + F.octet_length(c)).alias("n"))).otherwise(F.struct(a["t"].alias("t"), F.lit(limit + 1).alias("n"))), lambda a: a["t"])
    cut = F.when(F.octet_length(safe) <= limit, safe).otherwise(fits)
    return F.when(F.coalesce(cut, F.lit("")) == "", "_").otherwise(cut)


def field_order(items: DataFrame) -> DataFrame:
    """type_name and its fields in the order in which they first occur. items: type_name, at (place of the item), item (map)."""
    seen = items.select("type_name", "at", F.posexplode(F.map_keys("item")).alias("pos", "field"))
    first = seen.groupBy("type_name", "field").agg(F.min(F.struct("at", "pos")).alias("p"))
    return first.groupBy("type_name").agg(F.array_sort(F.collect_list(F.struct("p", "field"))).alias("f")).select("type_name", F.transform("f", lambda x: x["field"]).alias("fields"))


def tsv_rows(items: DataFrame, fields: DataFrame) -> DataFrame:
    """type_name, at and the tab-separated line of each item over its type's fields; missing values are empty, lone dashes hyphens.

    Cells are not escaped. The fields of a type are joined to its items, never collected over them.
    """
    value = lambda f: F.coalesce(dash(F.col("item")[f]), F.lit(""))
    joined = items.join(fields, "type_name")
    return joined.select("type_name", "at", F.array_join(F.transform("fields", value), "\t").alias("line"))


def tsv_blocks(rows: DataFrame, fields: DataFrame) -> DataFrame:
    """One text per type: heading, field names, lines in order."""
    lines = rows.groupBy("type_name").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("l"))
    joined = lines.join(fields, "type_name")
    text = F.concat_ws("\n", F.concat(F.lit("## "), F.col("type_name")), F.array_join("fields", "\t"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
    return joined.select("type_name", text.alias("block"))


def route(items: DataFrame, schema: DataFrame) -> DataFrame:
    """Each item to the file of its type: known types over their declared fields, others to none_ files over the fields found.

    items: type_name, at, source, item; schema: type_name, fields. Result: file, type_name, at, line, matched.
    """
    known = schema.select("type_name", F.col("fields").alias("declared"))
    found = field_order(items.join(known, "type_name", "left_anti")).select("type_name", F.col("fields").alias("found"))
    joined = items.join(known, "type_name", "left").join(found, "type_name", "left")
    matched = F.col("declared").isNotNull()
    cells = F.transform(F.coalesce("declared", "found"), lambda f: F.coalesce(dash(F.col("item")[f]), F.lit("")))
    line = F.array_join(F.concat(cells, F.array("source")), "\t")
    name = F.concat(F.when(matched, "").otherwise("none_"), file_name(F.col("type_name")), F.lit(".tsv"))
    return joined.select(name.alias("file"), "type_name", "at", line.alias("line"), matched.alias("matched"))


def schema_problem(name: str, seen: set[str], reserved: tuple[str, ...] = (".docai.tsv", ".gamedata.tsv", ".structured.tsv", ".schema.tsv")) -> str | None:
    """Why a declared type name can't name a file; None if it can."""
    rules = [
        (not name.strip(), "empty"), (".." in name, "two dots"), ("\\" in name, "backslash"), (re.search(r"[\x00-\x1f]", name), "control character"),
        (name.startswith("/"), "leading slash"), (name.startswith("."), "leading dot"), (name.endswith((".", " ")), "trailing dot or blank"),
        (len(name.encode()) > 200, "longer than 200 bytes"), (any(f"{name}.tsv".endswith(s) for s in reserved), "reserved ending"), (name.startswith("none_"), "reserved prefix"), (name in seen, "repeated"),
    ]
    return next((why for wrong, why in rules if wrong), None)


def checked_schema(types: list[dict]) -> list[dict]:
    """The declared types, or a ValueError naming the first that is not usable."""
    if not types:
        raise ValueError("at least one type must be declared")
    names: set[str] = set()
    for t in types:
        if why := schema_problem(t["type_name"], names):
            raise ValueError(f"type name {t['type_name']!r}: {why}")
        names.add(t["type_name"])
        fields = t.get("fields") or []
        if not fields:
            raise ValueError(f"type {t['type_name']!r} declares no fields")
        for i, f in enumerate(fields):
            if not isinstance(f, str) or not f.strip() or re.search(r"[\x00-\x1f]", f) or f == "source" or f in fields[:i]:
                raise ValueError(f"field {f!r} of type {t['type_name']!r} can't be used")
    return types


def outcome(tests: list[tuple[str, Column]]) -> Column:
    """`hit`, or the first reason whose test holds; a null test counts as holding."""
    c = F.lit("hit")
    for reason, wrong in reversed(tests):
        c = F.when(F.coalesce(wrong, F.lit(True)), reason).otherwise(c)
    return c


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """Reasons that occur with their counts and their place in the fixed order."""
    place = F.array_position(F.array(*map(F.lit, ["hit", *MISSES])), F.col("outcome"))
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n")).withColumn("place", place.cast("int"))


def collisions(names: DataFrame, stem: str, member: str) -> DataFrame:
    """Stems shared by several members, with the members in order."""
    groups = names.select(stem, member).distinct().groupBy(stem).agg(F.array_sort(F.collect_list(member)).alias("members"))
    return groups.where(F.size("members") > 1)


def flatten_tree(nodes: DataFrame) -> DataFrame:
    """Rows in reading order: (id, depth, place) from (id, path of ids from the root), parents before children, siblings by id."""
    w = Window.partitionBy("root").orderBy("path")
    return nodes.withColumn("root", F.get("path", F.lit(0))).select("id", "root", (F.size("path") - 1).alias("depth"), F.row_number().over(w).alias("place"))


def result_problem(result: object, schema: list[dict] | None = None) -> str | None:
    """The first thing wrong with a typed result, with its path; None if it is well formed.

    Without ``schema`` a result is {types: [{type_name, items}]} with items of strings; with one it has
    matched_types, of declared types with exactly their fields, and open unmatched_types.
    """
    if not isinstance(result, dict):
        return "result: not an object"
    declared = {t["type_name"]: set(t["fields"]) for t in schema or []}
    for part in ["types"] if schema is None else ["matched_types", "unmatched_types"]:
        if not isinstance(result.get(part), list):
            return f"{part}: not a list"
        for i, t in enumerate(result[part]):
            at = f"{part}[{i}]"
            if not isinstance(t, dict) or not isinstance(t.get("type_name"), str):
                return f"{at}.type_name: not a string"
            if part == "matched_types" and t["type_name"] not in declared:
                return f"{at}.type_name: not declared"
            if not isinstance(t.get("items"), list):
                return f"{at}.items: not a list"
            for j, item in enumerate(t["items"]):
                if not isinstance(item, dict) or not all(isinstance(k, str) and isinstance(v, str) for k, v in item.items()):
                    return f"{at}.items[{j}]: not an object of strings"
                if part == "matched_types" and set(item) != declared[t["type_name"]]:
                    return f"{at}.items[{j}]: other fields than declared"
    return None


def checked_results(df: DataFrame, result: str, schema: list[dict] | None = None) -> DataFrame:
    """``df`` with problem: the first thing wrong with the JSON text of ``result``, `not JSON` if it is none, `none` if nothing is."""
    import json
    from collections.abc import Iterator

    import pyarrow as pa

    names, at = df.columns, df.columns.index(result)

    def verdict(text: str | None) -> str:
        try:
            return result_problem(json.loads(text or ""), schema) or "none"
        except ValueError:
            return "not JSON"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = {t: verdict(t) for t in set(b.column(at).to_pylist())}
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([seen[t] for t in b.column(at).to_pylist()], pa.string())], names=[*names, "problem"])

    if "problem" in names:
        return checked_results(df.drop("problem"), result, schema)
    return df.mapInArrow(run, StructType([*df.schema, StructField("problem", StringType())]))


def schema_sections(schema: DataFrame) -> DataFrame:
    """type_name and its section of a request: a heading and a list of its fields."""
    listed = F.array_join(F.transform("fields", lambda f: F.concat(F.lit("- "), f)), "\n")
    return schema.select("type_name", F.concat(F.lit("### "), F.col("type_name"), F.lit("\n"), listed).alias("section"))


def _canonical() -> Column:
    """A type's declaration as JSON with its keys in order."""
    return F.to_json(F.struct("fields", "type_name"))


def schema_fingerprint() -> Column:
    return F.sha2(_canonical(), 256)


def prompt_fingerprint(prompt: Column) -> Column:
    """Digest of a request over a type: its wording and the type's declaration."""
    return F.sha2(F.concat_ws("\n", prompt, _canonical()), 256)


def result_schema(schema: list[dict] | None = None) -> dict:
    """The JSON Schema of a typed result, open or over declared types."""
    text = {"type": "string"}
    item = {"type": "object", "additionalProperties": text}
    group = lambda name, of: {"type": "object", "properties": {"type_name": name, "items": {"type": "array", "items": of}}, "required": ["type_name", "items"], "additionalProperties": False}
    if schema is None:
        return {"type": "object", "properties": {"types": {"type": "array", "items": group(text, item)}}, "required": ["types"]}
    closed = [group({"const": t["type_name"]}, {"type": "object", "properties": {f: text for f in t["fields"]}, "required": t["fields"], "additionalProperties": False}) for t in schema]
    parts = {"matched_types": {"type": "array", "items": {"anyOf": closed}}, "unmatched_types": {"type": "array", "items": group(text, item)}}
    return {"type": "object", "properties": parts, "required": list(parts), "additionalProperties": False}


def fingerprint(value: object) -> str:
    """Digest of a value's canonical JSON."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()

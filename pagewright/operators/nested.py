"""Deeply nested JSON records to flat tables of children that keep their parent (problem 1)."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pagewright.functions.jsonindex import ARR, OBJ, JsonIndex, decoded
from pagewright.runtime import spread

#: child kind -> the key its containers stand under, the keys that tell a single child from a map of children.
CHILDREN = {
    "region": ("regions", ("rectangle", "rect_id", "draw_order", "ocr_status")),
    "span": ("source_spans", ("page", "rect_id", "start", "end")),
    "entity": ("entities", ("name",)),
}
FLAT_SCHEMA = "child string, child_no int, parent_no int, parent_key string, child_key string, fields map<string,string>"
TABLE_SCHEMA = "path string, row_no int, parent_no int, place int, fields map<string,string>"
#: Bytes of JSON indexed at once; an index takes some forty times its text.
_INDEX_BYTES = 2_000_000


def _members(ix: JsonIndex) -> dict[int, list[int]]:
    """Values directly inside each container, in order."""
    inside: dict[int, list[int]] = {}
    v = np.flatnonzero(ix.value & (ix.cont >= 0) & ix.ok[ix.rec])
    for c, t in zip(ix.cont[v].tolist(), v.tolist()):
        inside.setdefault(c, []).append(t)
    return inside


def _children(ix: JsonIndex) -> Iterator[tuple]:
    """(record, kind, token, name token or -1) of every child, with nested lists taken apart."""
    inside = np.flatnonzero(ix.value & (ix.cont >= 0))
    marks = {}
    for kind, (_, keys) in CHILDREN.items():
        has = np.zeros(ix.pos.size, bool)
        for k in keys:
            t = ix.named(k)
            has[ix.cont[t]] = True
        marks[kind] = has
    for kind, (under, _) in CHILDREN.items():
        todo = ix.named(under)
        name = np.full(todo.size, -1)
        while todo.size:
            k = ix.kind[todo]
            single = (k == OBJ) & marks[kind][todo]
            if kind == "entity":
                single |= k == ix.S
            for t, nm in zip(todo[single].tolist(), name[single].tolist()):
                yield int(ix.rec[t]), kind, t, nm
            opened = todo[((k == ARR) | (k == OBJ)) & ~single]
            is_open = np.zeros(ix.pos.size, bool)
            is_open[opened] = True
            inner = inside[is_open[ix.cont[inside]]]
            if kind == "entity":  # a map from names to anything: its keys are the names
                mapped = ix.kind[ix.cont[inner]] == OBJ
                for t in inner[mapped].tolist():
                    yield int(ix.rec[t]), kind, int(ix.key_of[t]), -1
                inner = inner[~mapped]
            todo, name = inner, ix.key_of[inner]


def flatten_batch(payloads: list[str | None], fields: bool = True) -> Iterator[tuple]:
    """(row, kind, child_no, parent_no, parent_key, child_key, fields) for each child of each complete payload."""
    return _indexed(payloads, lambda ix, rows: _flatten(ix, rows, fields))


def _indexed(payloads: list[str | None], use: Callable[[JsonIndex, list[int]], Iterator[tuple]]) -> Iterator[tuple]:
    """What ``use`` makes of the index of each slice of bounded size, and of what is encoded in it."""
    rows, texts, size = [], [], 0
    for i, p in enumerate(payloads):
        if p is not None:
            t = decoded(p)
            if rows and size + len(t) > _INDEX_BYTES:
                yield from _slice(rows, texts, use)
                rows, texts, size = [], [], 0
            rows.append(i)
            texts.append(t)
            size += len(t)
    yield from _slice(rows, texts, use)


def _slice(rows: list[int], texts: list[bytes], use: Callable) -> Iterator[tuple]:
    while rows:  # each encoding taken off leaves a shorter text
        ix = JsonIndex(texts)
        yield from use(ix, rows)
        again = np.flatnonzero(ix.only_string).tolist()
        rows, texts = [rows[i] for i in again], [decoded(json.loads(texts[i])) for i in again]


def _flatten(ix: JsonIndex, rows: list[int], fields: bool) -> Iterator[tuple]:
    found = list(_children(ix))
    if not found:
        return
    region = np.zeros(ix.pos.size, bool)
    region[[t for _, kind, t, _ in found if kind == "region"]] = True
    up = ix.cont[[t for _, _, t, _ in found]]
    while True:  # to the nearest region around each child
        go = (up >= 0) & ~region[np.maximum(up, 0)]
        if not go.any():
            break
        up[go] = ix.cont[up[go]]
    inside = _members(ix)
    named = lambda t: {ix.text(int(ix.key_of[v])): v for v in inside.get(t, ()) if ix.key_of[v] >= 0}

    def scalar(v: int | None) -> str | None:
        return None if v is None or ix.kind[v] in (OBJ, ARR) else ix.text(v)

    def rectangle(own: dict) -> dict:
        box = own.get("rectangle")
        while box is not None and ix.kind[box] == ARR:
            box = next((v for v in inside.get(box, ()) if ix.kind[v] in (OBJ, ARR)), None)
        return named(box) if box is not None and ix.kind[box] == OBJ else {}

    number: dict[int, int] = {}
    label: dict[int, str | None] = {}
    shown: dict[int, dict] = {}
    count: dict[tuple, int] = {}
    for rec, kind, t, nm in found:
        if kind == "entity":
            own = {} if ix.kind[t] == ix.S else named(t)
            key = ix.text(t) if ix.kind[t] == ix.S else scalar(own.get("name"))
            if key is None:
                continue
        else:
            own = named(t)
            if kind == "region":
                own = own | rectangle(own)
                key = scalar(own.get("rect_id"))
                if key is None and nm >= 0:
                    key = ix.text(nm)
            else:
                key = ":".join(scalar(own.get(k)) or "" for k in ("page", "rect_id", "start"))
        number[t] = count[rec, kind] = count.get((rec, kind), -1) + 1
        label[t] = key
        if fields:
            shown[t] = {k: scalar(v) for k, v in own.items() if ix.kind[v] not in (OBJ, ARR)}
    for (rec, kind, t, _), p in zip(found, up.tolist()):
        if t in label:
            yield rows[rec], kind, number[t], number[p] if p >= 0 else None, (label[p] or "") if p >= 0 else "", label[t] or "", shown.get(t)


def flatten_records(df: DataFrame, payload: str = "payload", fields: bool = True) -> DataFrame:
    """One row for each region, span and entity inside the JSON text of ``payload``, linked to its parent.

    Adds child, child_no (place among the record's children of that kind), parent_no (child_no of the
    region around it, null below the record itself), parent_key, child_key and, unless ``fields`` is
    off, the child's scalar members. Other columns are repeated; a column that has the name of an
    added one is dropped. Null, empty, cut-off or otherwise invalid payloads give no row; a leading
    byte-order mark and any number of encodings are seen through; null entries are no children. Equal
    rows each give their own children.
    """
    schema = FLAT_SCHEMA if fields else FLAT_SCHEMA.split(", fields")[0]
    return _with_rows(df, payload, schema, lambda p: flatten_batch(p, fields))


def _with_rows(df: DataFrame, payload: str, schema: str, make: Callable[[list[str | None]], Iterator[tuple]]) -> DataFrame:
    """The other columns of ``df`` with each row (number of the payload, columns of ``schema``) that is made of its payload."""
    kinds = StructType.fromDDL(schema)
    keep = [c for c in df.columns if c not in kinds.names and c != payload]
    df = spread(df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{payload}`").cast("string").alias("__payload")), "__payload")
    out = StructType([*df.select(*[F.col(f"`{c}`") for c in keep]).schema, *kinds])
    arrow = [f.type for f in to_arrow_schema(kinds)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = list(make(b.column(b.num_columns - 1).to_pylist()))
            if not got:
                continue
            row, *cols = zip(*got)
            take = pa.array(row, pa.int32())
            arrays = [b.column(i).take(take) for i in range(len(keep))]
            for c, t in zip(cols, arrow):
                arrays.append(pa.array([None if x is None else list(x.items()) for x in c], t) if pa.types.is_map(t) else pa.array(c, t))
            yield pa.RecordBatch.from_arrays(arrays, names=keep + kinds.names)

    return df.mapInArrow(run, out)


def _tables(ix: JsonIndex, rows: list[int]) -> Iterator[tuple]:
    """(row, path, row_no, parent_no, place, fields) of every object that is a record or stands in an array, and of every scalar in an array."""
    v = np.flatnonzero(ix.value & ix.ok[ix.rec])
    up, kind = ix.cont, ix.kind
    listed = (up >= 0) & (kind[np.maximum(up, 0)] == ARR)
    is_row = ((listed & (kind != ARR)) | ((up < 0) & (kind == OBJ))) & ix.value
    near = up.copy()
    while True:  # to the nearest row around each value
        go = (near >= 0) & ~is_row[np.maximum(near, 0)]
        if not go.any():
            break
        near[go] = up[near[go]]
    path: dict[int, str] = {-1: ""}
    made: dict[int, tuple] = {}
    numbers = dict.fromkeys(range(len(rows)), 0)
    places: dict[int, int] = {}
    for t, c, k, row, own, r in zip(*(x[v].tolist() for x in (np.arange(kind.size), up, kind, is_row, near, ix.rec))):
        name = ix.key_of[t]
        path[t] = path[c] if name < 0 else (f"{path[c]}." if path[c] else "") + ix.text(int(name))
        if listed[t]:
            places[c] = places.get(c, -1) + 1
        scalar = k not in (OBJ, ARR)
        text = ix.text(t) if scalar else None
        if row:
            if scalar and text is None:  # a null entry
                continue
            made[t] = (rows[r], path[t], numbers[r], made[own][2] if own in made else None, places.get(c) if listed[t] else None, {"value": text} if scalar else {})
            numbers[r] += 1
        elif scalar and own in made:
            skip = len(path[own]) + (path[own] != "")
            made[own][5][path[t][skip:]] = text
    yield from made.values()


def flatten_tables(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Records of any shape as related flat tables: one row for each record, each object in an array and each scalar in an array.

    Adds path (the keys that lead there, arrays passed over; it names the table and is empty for the
    record itself), row_no (number of the row in its payload), parent_no (that of the row around it),
    place (its place in its array) and fields (scalar members, those of inner objects under dotted names;
    ``value`` for a scalar). Lists of lists are one list; null entries are no rows; a repeated key has
    its last value. Otherwise as ``flatten_records``.
    """
    return _with_rows(df, payload, TABLE_SCHEMA, lambda p: _indexed(p, _tables))

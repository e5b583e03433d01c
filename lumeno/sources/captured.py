"""Captured snapshots as a data source of Spark's own (S6): JSON lines in files by range of pages, a list of them, and a contract for every row.

    register(spark)
    elements.write.format("captured").mode("append").save(folder)
    spark.read.format("captured").load(folder).where("page_id = 7")

Every task writes one file for its rows and reports the range of pages in it; the ranges go to a list that only the commit of the
whole write makes, so files of lost or repeated tasks don't count. A read has a task a file. With
spark.sql.python.filterPushdown.enabled filters on page_id leave out the files whose range they rule out. Rows that break the contract are
left out, or with option mode=fail an error, or with option rows=rejected the only ones that are read, with their reasons.
"""

from __future__ import annotations

import json
import math
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = """page_id long, el_id int, parent_id int, tag string, pre int, post int, depth int, own_text array<string>, attrs map<string,string>, display string, position string, visibility string,
    opacity double, overflow string, transform string, l double, t double, r double, b double, font_size double, font_weight int, color array<double>, bg_color array<double>, bg_image string, border_widths array<double>, border_colors array<array<double>>,
    paddings array<double>, borders array<double>, margins array<double>, before_content string, after_content string, cursor string, hover_styled boolean, z_index int, frame_id int, visible boolean, doc_width double, doc_height double"""
REJECTED = "file string, line long, reason string"
NEEDED = ("page_id", "el_id", "tag", "pre", "post", "depth", "l", "t", "r", "b", "doc_width", "doc_height")
SIDES = ("paddings", "borders", "margins", "border_widths", "border_colors")
POSITIONS = ("static", "relative", "absolute", "fixed", "sticky")
NAMES = [c.split()[0] for c in SCHEMA.replace("map<string,string>", "map").split(",")]
LIST = "_files"


def _whole(x: object) -> bool:
    return isinstance(x, int) and not isinstance(x, bool)


def _number(x: object) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x)


def _numbers(x: object) -> bool:
    return isinstance(x, list) and all(map(_number, x))


_TESTS = {
    "int": _whole, "long": _whole, "double": _number, "string": lambda x: isinstance(x, str), "boolean": lambda x: isinstance(x, bool), "array<double>": _numbers,
    "array<string>": lambda x: isinstance(x, list) and all(isinstance(y, str) for y in x), "array<array<double>>": lambda x: isinstance(x, list) and all(map(_numbers, x)),
    "map": lambda x: isinstance(x, dict) and all(isinstance(y, str) for y in x.values()),
}
KINDS = dict(c.split() for c in SCHEMA.replace("map<string,string>", "map").replace("\n", " ").split(","))


def fault(row: object) -> str | None:
    """Why a row breaks the contract, or None."""
    if not isinstance(row, dict):
        return "no record"
    for c in NEEDED:
        if row.get(c) is None:
            return f"{c} is missing"
    for c, v in row.items():
        if c in KINDS and v is not None and not _TESTS[KINDS[c]](v):
            return f"{c} is no {KINDS[c]}"
    if row["l"] > row["r"] or row["t"] > row["b"]:
        return "the box is inside out"
    if row["pre"] > row["post"] or row.get("parent_id") == row["el_id"]:
        return "the tree is broken"
    if not 0 <= (1 if row.get("opacity") is None else row["opacity"]) <= 1:
        return "opacity is out of range"
    if (row.get("position") or "static") not in POSITIONS:
        return "position is unknown"
    if any(row.get(c) is not None and len(row[c]) != 4 for c in SIDES):
        return "a box has four sides"
    if any(row.get(c) is not None and len(row[c]) not in (3, 4) for c in ("color", "bg_color")):
        return "a color has three or four parts"
    return None


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


@dataclass
class File(InputPartition):
    name: str
    first: int
    last: int


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    first: int
    last: int
    n: int


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.mode, self.rejected = options["path"], options.get("mode", "drop"), options.get("rows") == "rejected"
        self.low, self.high, self.some = -math.inf, math.inf, None
        if self.mode not in ("drop", "fail"):
            raise ValueError("mode is drop or fail")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Narrows the range of pages; all filters are still applied to the rows."""
        for f in filters:
            if getattr(f, "attribute", None) == ("page_id",) and not self.rejected:
                if isinstance(f, EqualTo):
                    self.low, self.high = max(self.low, f.value), min(self.high, f.value)
                elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value)
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    self.high = min(self.high, f.value)
                elif isinstance(f, In):
                    own = {v for v in f.value if v is not None}
                    self.some = own if self.some is None else self.some & own
            yield f

    def partitions(self) -> list[File]:
        store, folder = _store(self.folder)
        found = []
        for info in store.get_file_info(fs.FileSelector(posixpath.join(folder, LIST))):
            with store.open_input_stream(info.path) as f:
                found += [File(**x) for x in json.loads(f.readall())]
        fits = lambda x: x.first <= self.high and x.last >= self.low and (self.some is None or any(x.first <= v <= x.last for v in self.some))
        return sorted((x for x in found if fits(x)), key=lambda x: (x.first, x.name))

    def read(self, partition: File | None) -> Iterator[tuple]:
        if partition is None:
            return
        store, folder = _store(self.folder)
        with store.open_input_stream(posixpath.join(folder, partition.name)) as f:
            rest, n = b"", 0
            while rest or n == 0 or chunk:
                chunk = f.read(1 << 20)
                lines = (rest + chunk).split(b"\n")
                rest = lines.pop() if chunk else b""
                for line in lines:
                    n += 1
                    if line:
                        yield from self._row(line, partition.name, n)
                if not chunk:
                    break

    def _row(self, line: bytes, name: str, n: int) -> Iterator[tuple]:
        try:
            row = json.loads(line)
            reason = fault(row)
        except ValueError:
            row, reason = None, "no JSON"
        if self.rejected:
            if reason is not None:
                yield (name, n, reason)
        elif reason is None:
            yield tuple(float(v) if KINDS[c] == "double" and v is not None else v for c in NAMES for v in [row.get(c)])
        elif self.mode == "fail":
            raise ValueError(f"{name}, line {n}: {reason}")


class Writer(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        if overwrite:
            raise ValueError("captured snapshots are only appended to")
        self.folder = options["path"]

    def write(self, iterator: Iterator[Row]) -> Written:
        store, folder = _store(self.folder)
        store.create_dir(folder)
        name, first, last, n = f"{uuid.uuid4().hex}.jsonl", math.inf, -math.inf, 0
        with store.open_output_stream(posixpath.join(folder, name)) as f:
            for row in iterator:
                record = {k: v for k, v in row.asDict(recursive=True).items() if v is not None and k in KINDS}
                first, last, n = min(first, record["page_id"]), max(last, record["page_id"]), n + 1
                f.write(json.dumps(record, ensure_ascii=False, separators=(",", ":")).encode() + b"\n")
        if n == 0:
            store.delete_file(posixpath.join(folder, name))
            return Written(None, 0, 0, 0)
        return Written(name, first, last, n)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = _store(self.folder)
        store.create_dir(posixpath.join(folder, LIST))
        rows = [{"name": m.name, "first": m.first, "last": m.last} for m in messages if m is not None and m.name is not None]
        with store.open_output_stream(posixpath.join(folder, LIST, f"{uuid.uuid4().hex}.json")) as f:
            f.write(json.dumps(rows).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = _store(self.folder)
        for m in messages:
            if m is not None and m.name is not None:
                store.delete_file(posixpath.join(folder, m.name))


class Captured(DataSource):
    @classmethod
    def name(cls) -> str:
        return "captured"

    def schema(self) -> str:
        return REJECTED if self.options.get("rows") == "rejected" else SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with pages as filters that reach its files."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Captured)

"""A Spark data source for folders of cell files: partitions are whole files, columns are found by each file's own header.

    spark.dataSource.register(CellFiles)
    spark.read.format("cellfiles").option("glob", "*dox*.csv").load(folder)

Options: ``glob`` (file name, or path below the folder if it holds a slash),
``recursive`` (true), ``skip`` (paths that hold it are left out, ``_archive``),
``discover`` (only files that lie directly in a directory whose name fits this
pattern), ``files`` (JSON map of path to dose: these files only, none is looked for), ``content``
(``cells``; ``headers``: one row for each file, of which only the first line is
read; ``listing``: one row for each file, none is opened), ``packed`` (bytes of
files that one task reads at least).

Every file is opened once and read once.  A file that cannot be used gives one row
with ``problem`` and no cells, and the others are read.  Files are named by URI or
path; pyarrow's file systems (local, HDFS, S3, GCS) are what they may lie on.
"""
from __future__ import annotations

import io
import json
import posixpath
from dataclasses import dataclass
from fnmatch import fnmatchcase

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv
import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Names that columns go by (fixed values of the file format); the first that a header holds counts.
AXES = {"x": ("X", "Global X", "Position X"), "y": ("Y", "Global Y", "Position Y"), "z": ("Z", "Global Z", "Position Z")}
TYPE_NAMES = ("cell_type_dapi_adjusted", "cell_type_dapi_adusted")
CHANNELS = {"ch_546": "log1p_normed_546", "ch_647": "log1p_normed_647"}
VALUES = [*AXES, "cell_type", *CHANNELS]

SCHEMA = "path string, relative string, dose int, row long, " + ", ".join(f"{c} double" for c in VALUES) + ", header string, problem string"
ARROW = pa.schema([("path", pa.string()), ("relative", pa.string()), ("dose", pa.int32()), ("row", pa.int64()), *((c, pa.float64()) for c in VALUES), ("header", pa.string()), ("problem", pa.string())])


def opened(uri: str) -> tuple[pa.fs.FileSystem, str, str]:
    """(file system, path on it, prefix that makes such a path a URI again)."""
    if "://" not in uri and not uri.startswith("file:"):
        return pa.fs.LocalFileSystem(), posixpath.abspath(uri), ""
    if uri.startswith("file:"):
        return pa.fs.LocalFileSystem(), "/" + uri[5:].lstrip("/"), ""
    fs, path = pa.fs.FileSystem.from_uri(uri)
    return fs, path, uri[:uri.index(path)] if path in uri else uri.split("://")[0] + "://"


def named(header: str) -> list[str]:
    return [n.strip().strip('"') for n in header.split(",")]


def columns(names: list[str]) -> tuple[dict[str, int], str | None]:
    """Place of each value among a file's columns, and what is missing."""
    def place(options, contains=None):
        for n in options:
            if n in names:
                return names.index(n)
        return next((i for i, n in enumerate(names) if contains and contains in n.lower()), None)

    found = {a: place(options) for a, options in AXES.items()}
    found["cell_type"] = place(TYPE_NAMES, "cell_type")
    missing = "no coordinates" if None in [found[a] for a in AXES] else "no cell type" if found["cell_type"] is None else None
    found |= {c: place((n,)) for c, n in CHANNELS.items()}
    return {c: i for c, i in found.items() if i is not None}, missing


def numbers(column: pa.ChunkedArray) -> pa.Array:
    """Finite numbers; other texts, NaN and infinities are NULL."""
    text = pc.utf8_trim_whitespace(column.combine_chunks())
    try:
        value = text.cast(pa.float64())
    except pa.ArrowInvalid:
        import pandas as pd

        value = pa.array(pd.to_numeric(text.to_pandas(), errors="coerce").to_numpy(float), from_pandas=True)
    return pc.if_else(pc.is_finite(value), value, pa.scalar(None, pa.float64()))


@dataclass
class Files(InputPartition):
    """(path, relative path, dose) of the files of one task."""
    held: list[tuple[str, str, int | None]]


class CellFilesReader(DataSourceReader):
    def __init__(self, options):
        self.o = {k.lower(): v for k, v in dict(options).items()}
        self.content = self.o.get("content", "cells")
        if self.content not in ("cells", "headers", "listing"):
            raise ValueError(f"unknown content {self.content}")

    def listed(self) -> list[tuple[str, str, int | None, int]]:
        """(path, relative path, dose, bytes) of the files that the options choose, by path."""
        if "files" in self.o:
            chosen = json.loads(self.o["files"])
            base = self.o.get("path") or posixpath.dirname(posixpath.commonpath([posixpath.dirname(p) for p in chosen])) if chosen else ""
            out = []
            for path, dose in sorted(chosen.items()):
                fs, at, _ = opened(path)
                out.append((path, posixpath.relpath(opened(path)[1], opened(base)[1]), dose, fs.get_file_info(at).size or 0))
            return out
        fs, folder, prefix = opened(self.o["path"])
        found = fs.get_file_info(pa.fs.FileSelector(folder, recursive=self.o.get("recursive", "true").lower() == "true"))
        glob, skip, discover = self.o.get("glob", "*.csv"), self.o.get("skip", "_archive"), self.o.get("discover")
        out = []
        for f in found:
            relative = posixpath.relpath(f.path, folder)
            if f.type != pa.fs.FileType.File or not fnmatchcase(relative if "/" in glob else f.base_name, glob) or skip and skip in relative:
                continue
            if discover and not fnmatchcase(posixpath.basename(posixpath.dirname(f.path)), discover):
                continue
            out.append((prefix + f.path, relative, None, f.size or 0))
        return sorted(out)

    def partitions(self):
        room = int(self.o.get("packed", 4 << 20))
        out, held, size = [], [], 0
        for path, relative, dose, n in self.listed():
            held.append((path, relative, dose))
            size += n
            if size >= room:
                out.append(Files(held))
                held, size = [], 0
        return out + [Files(held)] * bool(held) or [Files([])]

    def read(self, partition):
        for path, relative, dose in partition.held:
            try:
                yield from self.one(path, relative, dose)
            except Exception as e:  # one unreadable file must not cost the others; what was wrong is in its row
                yield self.row(path, relative, dose, "", f"{type(e).__name__}: {e}"[:500])

    def row(self, path, relative, dose, header, problem):
        values = {"path": path, "relative": relative, "dose": dose, "header": header, "problem": problem}
        return pa.RecordBatch.from_arrays([pa.array([values.get(f.name)], f.type) for f in ARROW], schema=ARROW)

    def one(self, path, relative, dose):
        if self.content == "listing":
            yield self.row(path, relative, dose, None, None)
            return
        fs, at, _ = opened(path)
        with io.BufferedReader(fs.open_input_file(at), 1 << 16) as f:
            header = f.readline().decode("utf-8", "replace").lstrip("﻿").rstrip("\r\n")
            places, missing = columns(named(header))
            if self.content == "headers" or missing:
                yield self.row(path, relative, dose, header, missing)
                return
            width = len(named(header))
            wanted = {i: f"c{i}" for i in places.values()}
            # a sample is complete or not there at all, so its table is made before a row leaves
            table = pa.csv.read_csv(
                pa.PythonFile(f, mode="r"), read_options=pa.csv.ReadOptions(column_names=[f"c{i}" for i in range(width)], use_threads=False),
                convert_options=pa.csv.ConvertOptions(include_columns=list(wanted.values()), column_types={c: pa.string() for c in wanted.values()})) if f.peek(1) else None
        n = table.num_rows if table is not None else 0
        value = {c: numbers(table[wanted[i]]) if n else pa.array([], pa.float64()) for c, i in places.items()}
        value |= {"path": pa.repeat(path, n), "relative": pa.repeat(relative, n), "dose": pa.repeat(pa.scalar(dose, pa.int32()), n), "row": pa.array(np.arange(n))}
        batch = pa.RecordBatch.from_arrays([value.get(x.name, pa.nulls(n, x.type)).cast(x.type) for x in ARROW], schema=ARROW)
        for i in range(0, n, 1 << 16):
            yield batch.slice(i, 1 << 16)


class CellFiles(DataSource):
    @classmethod
    def name(cls):
        return "cellfiles"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return CellFilesReader(self.options)

"""FITS images and cubes as a data source: blocks of rows are read side by side, pixels are written to their places.

`spark.read.format("fits")` takes a path (a file in a folder that all executors see) and gives (z, y, x, value), z 0 in
an image.  The driver reads the header alone; a partition reads the rows of its block, and with the options
y0, y1, x0, x1, z0, z1 (first and behind the last) nothing but a cutout's rows and columns.  Numbers of all
kinds are read, with BZERO and BSCALE.

Writing takes nx, ny, nz and a header (JSON): the driver lays out a file beside the path, tasks put runs of
pixels, as 32-bit floats, at their places in it, and the commit renames it.  So a task that is run again writes the
same bytes, a job that fails leaves no file, and readers never see half of one.  Every pixel must come once:
the commit counts them.
"""

from __future__ import annotations

import json
import math
import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

BLOCK = 2880  # fixed values of the format: the length of its blocks and cards, numbers by BITPIX
CARD = 80
KINDS = {8: "u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
SCHEMA = "z long, y long, x long, value double"


def local_path(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")


def card(key: str, value) -> str:
    if isinstance(value, bool):
        text = f"{'T' if value else 'F':>20}"
    elif isinstance(value, int):
        text = f"{value:>20}"
    elif isinstance(value, float):
        text = f"{value!r:>20}".upper()
    else:
        quoted = str(value).replace("'", "''")
        text = f"'{quoted:<8}'"
    return f"{key:<8}= {text}"[:CARD].ljust(CARD)


def header_bytes(shape: list[int], words: dict) -> bytes:
    """shape: nx, ny and, of a cube, nz."""
    own = {"SIMPLE": True, "BITPIX": -32, "NAXIS": len(shape)} | {f"NAXIS{k}": n for k, n in enumerate(shape, 1)}
    cards = "".join(card(k, v) for k, v in (own | {k: v for k, v in words.items() if k not in own}).items()) + "END".ljust(CARD)
    return cards.ljust(-(-len(cards) // BLOCK) * BLOCK).encode("ascii")


def parsed_value(text: str):
    text = text.strip()
    if text.startswith("'"):
        return text[1:].replace("''", "\0").split("'")[0].replace("\0", "'").rstrip()
    text = text.split("/")[0].strip()
    if text in ("T", "F"):
        return text == "T"
    try:
        return int(text)
    except ValueError:
        return float(text.upper().replace("D", "E")) if text else None


def read_header(path: str) -> tuple[dict, int]:
    """(keywords of the first unit, where its data begin)."""
    words: dict = {}
    with open(local_path(path), "rb") as f:
        while True:
            block = f.read(BLOCK)
            if len(block) < BLOCK or not words and not block.startswith(b"SIMPLE  ="):
                raise ValueError(f"no FITS header: {path}")
            for k in range(0, BLOCK, CARD):
                line = block[k : k + CARD].decode("ascii", "replace")
                if line[:8].rstrip() == "END":
                    return words, f.tell()
                if line[8:10] == "= ":
                    words[line[:8].rstrip()] = parsed_value(line[10:])


@dataclass
class Rows(InputPartition):
    z: int
    first: int
    behind: int


class FitsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.words, self.start = read_header(self.path)
        axes = [self.words.get(f"NAXIS{k}", 1) for k in range(1, 4)]
        if any(self.words.get(f"NAXIS{k}", 1) != 1 for k in range(4, self.words.get("NAXIS", 0) + 1)):
            raise ValueError(f"more than three axes: {self.path}")
        self.nx, self.ny, self.nz = axes if self.words.get("NAXIS", 0) else (0, 0, 0)
        held = lambda c, n: (max(0, int(options.get(f"{c}0", 0))), min(n, int(options.get(f"{c}1", n))))
        self.x, self.y, self.z = held("x", self.nx), held("y", self.ny), held("z", self.nz)
        self.block = max(1, int(options.get("blockpixels", 1 << 20)) // max(1, self.x[1] - self.x[0]))

    def partitions(self) -> list[Rows]:
        if self.x[0] >= self.x[1]:
            return []
        return [Rows(z, y, min(y + self.block, self.y[1])) for z in range(*self.z) for y in range(self.y[0], self.y[1], self.block)]

    def read(self, part: Rows):
        import numpy as np
        import pyarrow as pa

        kind = np.dtype(KINDS[self.words["BITPIX"]])
        wide, x = self.x[1] - self.x[0], pa.array(np.arange(*self.x))
        with open(local_path(self.path), "rb") as f:
            for y in range(part.first, part.behind):
                f.seek(self.start + ((part.z * self.ny + y) * self.nx + self.x[0]) * kind.itemsize)
                raw = f.read(wide * kind.itemsize)
                if len(raw) < wide * kind.itemsize:
                    raise ValueError(f"the data of {self.path} are cut off")
                value = np.frombuffer(raw, kind).astype(np.float64) * float(self.words.get("BSCALE", 1)) + float(self.words.get("BZERO", 0))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(wide, part.z)), pa.array(np.full(wide, y)), x, pa.array(value)], names=["z", "y", "x", "value"])


@dataclass
class Written(WriterCommitMessage):
    pixels: int


class FitsWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.path = local_path(options["path"])
        self.nx, self.ny, self.nz = (int(options[c]) if c in options else 1 for c in ("nx", "ny", "nz"))
        head = header_bytes([self.nx, self.ny, *([self.nz] if "nz" in options else [])], json.loads(options.get("header", "{}")))
        self.start, self.pixels = len(head), self.nx * self.ny * self.nz
        self.open_path = f"{self.path}.{uuid.uuid4().hex}.part"
        with open(self.open_path, "wb") as f:
            f.write(head)
            f.truncate(self.start + -(-self.pixels * 4 // BLOCK) * BLOCK)

    def write(self, rows) -> Written:
        import numpy as np

        def put(f, held):
            at = np.array([(z * self.ny + y) * self.nx + x for z, y, x, _ in held], np.int64)
            if any(not (0 <= x < self.nx and 0 <= y < self.ny and 0 <= z < self.nz) for z, y, x, _ in held):
                raise ValueError(f"a pixel outside {self.nx} x {self.ny} x {self.nz}")
            order = np.argsort(at, kind="stable")
            value = np.array([math.nan if v is None else v for *_, v in held], np.float64)[order].astype(">f4")
            for run in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at[order]) != 1) + 1):
                f.seek(self.start + int(at[order[run[0]]]) * 4)
                f.write(value[run].tobytes())

        many, held = 0, []
        with open(self.open_path, "r+b") as f:
            for row in rows:
                held.append((row["z"] or 0, row["y"], row["x"], row["value"]))
                if len(held) == 1 << 16:
                    put(f, held)
                    many, held = many + len(held), []
            if held:
                put(f, held)
        return Written(many + len(held))

    def commit(self, messages) -> None:
        came = sum(m.pixels for m in messages if m)
        if came != self.pixels:
            self.abort(messages)
            raise ValueError(f"{came} pixels of {self.pixels}")
        os.replace(self.open_path, self.path)

    def abort(self, messages) -> None:
        if os.path.exists(self.open_path):
            os.remove(self.open_path)


class FitsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fits"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FitsReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return FitsWriter(dict(self.options))


def read_fits(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(FitsSource)
    return spark.read.format("fits").options(**options).load(path)


def write_fits(df: DataFrame, path: str, nx: int, ny: int, nz: int | None = None, header: dict | None = None, fill: float | None = None) -> None:
    """(z, y, x, value), without z an image, as one file; header: keywords beside those of the layout; fill: the value of pixels that have no row."""
    spark = df.sparkSession
    spark.dataSource.register(FitsSource)
    if "z" not in df.columns:
        df = df.selectExpr("0L as z", "y", "x", "value")
    rows = df.selectExpr("cast(z as long) as z", "cast(y as long) as y", "cast(x as long) as x", "cast(value as double) as value")
    if fill is not None:
        grid = spark.range(nx * ny * (nz or 1)).selectExpr(f"id div {nx * ny} as z", f"id div {nx} % {ny} as y", f"id % {nx} as x")
        rows = grid.join(rows, ["z", "y", "x"], "left").fillna(fill, ["value"])
    rows = rows.repartitionByRange("z", "y").sortWithinPartitions("z", "y", "x")
    sizes = {"nx": nx, "ny": ny} | ({"nz": nz} if nz else {})
    rows.write.format("fits").options(path=path, header=json.dumps(header or {}), **sizes).mode("append").save()

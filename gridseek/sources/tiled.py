"""Slides in tiled TIFF files as Spark sources (SRC1-SRC3, SRC5).

``format("slide_tiles")`` gives a file's tiles as a chunk table, ``format("slide_levels")`` its levels and
properties; :func:`register` makes both known to a session. The driver lists files and their sizes only. A file
is cut into parts by its size; the task of a part reads the file's header and, of each level that is wanted, the
part's share of the tiles. Comparisons of ``slide_id``, ``level``, ``ty`` and ``tx`` with numbers are pushed into
the source: tiles that they exclude are never read.
"""

from __future__ import annotations

import operator
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import types as T

from gridseek.functions.image import IMAGE, as_rgb

#: Bytes of a file that a part reads, and of pixels that are handed over at once.
PART_BYTES, BATCH_BYTES = 64 << 20, 16 << 20
TILES = T.StructType([T.StructField("slide_id", T.LongType()), T.StructField("path", T.StringType()), *(T.StructField(n, T.IntegerType()) for n in ("level", "ty", "tx")), T.StructField("image", IMAGE)])
LEVELS = "slide_id long, path string, level int, width int, height int, tile int, ds double, props map<string,string>"
#: Tags, numbers of bytes of value types and codes of TIFF files. Fixed values.
_WIDTH, _HEIGHT, _BITS, _PACKED, _PHOTO, _TEXT = 256, 257, 258, 259, 262, 270
_SAMPLES, _X_RES, _Y_RES, _PLANES, _UNIT, _PREDICTOR = 277, 282, 283, 284, 296, 317
_TILE_W, _TILE_H, _OFFSETS, _COUNTS = 322, 323, 324, 325
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
_NUMBERS = {1: "B", 3: "H", 4: "I", 13: "I", 16: "Q"}
_WHITE_IS_ZERO = 0


def _stored(data: bytes) -> bytes:
    return data


#: How tiles of a compression code are unpacked; further codes, such as those of codecs, can be added.
UNPACKERS = {1: _stored, 8: zlib.decompress, 32946: zlib.decompress}


@dataclass(frozen=True)
class _Entry:
    kind: int
    count: int
    place: int  # of the first value in the file


class TiledImage:
    """Levels and tiles of one file. Only what is asked for is read; ``reads`` counts tiles."""

    def __init__(self, file):
        self.file, self.reads = file, 0
        head = self._at(0, 16)
        self.order = {b"II": "<", b"MM": ">"}.get(head[:2], "")
        magic = struct.unpack(f"{self.order}H", head[2:4])[0] if self.order else 0
        if magic not in (42, 43):
            raise ValueError("no TIFF file")
        self.big = magic == 43
        first = struct.unpack(f"{self.order}{'Q' if self.big else 'I'}", head[8:16] if self.big else head[4:8])[0]
        tables = []
        while first:
            table, first = self._table(first)
            tables.append(table)
        tiled = [t for t in tables if _TILE_W in t]  # labels and thumbnails have no tiles
        if not tiled:
            raise ValueError("a TIFF file without tiles")
        self.levels = sorted(tiled, key=lambda t: -self.one(t, _WIDTH))

    def _at(self, place: int, size: int) -> bytes:
        self.file.seek(place)
        return self.file.read(size)

    def _table(self, place: int) -> tuple[dict[int, _Entry], int]:
        wide, count, word = (20, "Q", "Q") if self.big else (12, "H", "I")
        first = struct.calcsize(f"<{count}")
        n = struct.unpack(f"{self.order}{count}", self._at(place, first))[0]
        raw = self._at(place + first, n * wide + struct.calcsize(f"<{word}"))
        table = {}
        for k in range(n):
            tag, kind, number = struct.unpack_from(f"{self.order}HH{word}", raw, k * wide)
            held = wide - struct.calcsize(f"<{word}")  # where an entry's values are, or where they start
            inside = _SIZES.get(kind, 1) * number <= wide - held
            where = place + first + k * wide + held if inside else struct.unpack_from(f"{self.order}{word}", raw, k * wide + held)[0]
            table[tag] = _Entry(kind, number, where)
        return table, struct.unpack_from(f"{self.order}{word}", raw, n * wide)[0]

    def some(self, table: dict[int, _Entry], tag: int, at: int, n: int) -> np.ndarray:
        """``n`` numbers of an entry from ``at``."""
        entry = table[tag]
        size = _SIZES[entry.kind]
        return np.frombuffer(self._at(entry.place + at * size, n * size), np.dtype(_NUMBERS[entry.kind]).newbyteorder(self.order)).astype(np.int64)

    def one(self, table: dict[int, _Entry], tag: int, default: int = 0) -> int:
        return int(self.some(table, tag, 0, 1)[0]) if tag in table else default

    def size(self, level: int) -> tuple[int, int, int, int]:
        """Height, width, tile height and tile width."""
        return tuple(self.one(self.levels[level], tag) for tag in (_HEIGHT, _WIDTH, _TILE_H, _TILE_W))  # type: ignore[return-value]

    def downsample(self, level: int) -> float:
        """The mean of both sides' ratios to the first level."""
        (h, w, *_), (height, width, *_) = self.size(level), self.size(0)
        return (height / h + width / w) / 2

    @cached_property
    def properties(self) -> dict[str, str]:
        table, out = self.levels[0], {}
        for tag, name in ((_X_RES, "tiff.XResolution"), (_Y_RES, "tiff.YResolution")):
            if tag in table:
                above, below = struct.unpack(f"{self.order}II", self._at(table[tag].place, 8))
                if below:
                    out[name] = repr(above / below)
        if _UNIT in table:
            out["tiff.ResolutionUnit"] = str(self.one(table, _UNIT))
        if _TEXT in table:
            text = self._at(table[_TEXT].place, table[_TEXT].count).split(b"\0")[0].decode("utf-8", "replace")
            out["tiff.ImageDescription"] = text
            fields = (part.split("=", 1) for part in text.split("|")[1:] if "=" in part)
            out |= {f"aperio.{k.strip()}": v.strip() for k, v in fields}
        return out

    def tiles(self, level: int, ty: int, tx: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """``(tx, pixels)`` of some tiles of a row, cut to the level's size."""
        table = self.levels[level]
        h, w, th, tw = self.size(level)
        across = -(-w // tw)
        low, high = int(tx.min()), int(tx.max()) + 1
        starts, counts = (self.some(table, tag, ty * across + low, high - low) for tag in (_OFFSETS, _COUNTS))
        n, packed, bits = self.one(table, _SAMPLES, 1), self.one(table, _PACKED, 1), self.one(table, _BITS, 1)
        if packed not in UNPACKERS or bits != 8 or self.one(table, _PLANES, 1) != 1:
            raise ValueError(f"tiles of compression {packed} and {bits} bits are not supported")
        for x in tx.tolist():
            self.reads += 1
            data = UNPACKERS[packed](self._at(int(starts[x - low]), int(counts[x - low])))
            pixels = np.frombuffer(data, np.uint8)[: th * tw * n].reshape(th, tw, n)
            if self.one(table, _PREDICTOR, 1) == 2:
                pixels = np.cumsum(pixels, axis=1, dtype=np.uint8)
            if self.one(table, _PHOTO, 1) == _WHITE_IS_ZERO:
                pixels = 255 - pixels
            pixels = pixels[: h - ty * th, : w - x * tw]
            yield x, as_rgb(pixels[:, :, 0] if n < 3 else pixels)


@dataclass
class _Part(D.InputPartition):
    slide_id: int
    path: str
    part: int
    parts: int


_COMPARED = {
    D.EqualTo: operator.eq, D.EqualNullSafe: operator.eq, D.GreaterThan: operator.gt, D.GreaterThanOrEqual: operator.ge,
    D.LessThan: operator.lt, D.LessThanOrEqual: operator.le, D.In: lambda a, b: a in b,
}


def _opened(path: str):
    system, where = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system, where


class _Reader(D.DataSourceReader):
    """What both sources share: the listing, and filters on whole numbers."""

    pushed = ("slide_id", "level", "ty", "tx")

    def __init__(self, options: dict[str, str]):
        self.paths = [p for p in options.get("path", "").split(",") if p]
        self.suffixes = tuple(options.get("suffixes", ".tif,.tiff,.svs").lower().split(","))
        self.part_bytes = int(options.get("partBytes", PART_BYTES))
        self.filters: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) else None
            values = list(f.value) if isinstance(f, D.In) else [getattr(f, "value", None)]
            if isinstance(f, D.IsNotNull) and name in self.pushed:
                continue  # none of them is ever null
            if type(f) in _COMPARED and name in self.pushed and len(f.attribute) == 1 and all(type(v) is int for v in values):
                self.filters.append((name, type(f), tuple(values) if isinstance(f, D.In) else values[0]))
            else:
                yield f

    def keeps(self, name: str, value) -> np.ndarray | bool:
        """Whether a value, or each of an array, passes the filters on a column."""
        values = np.asarray(value)
        ok = np.ones(values.shape, dtype=bool)
        for column, kind, bound in self.filters:
            if column == name:
                ok &= np.isin(values, bound) if kind is D.In else _COMPARED[kind](values, bound)
        return ok

    def files(self) -> list[tuple[int, str, int]]:
        """``(slide_id, path, bytes)``: files by name, numbered from 0."""
        found = []
        for path in self.paths:
            system, where = _opened(path)
            info = system.get_file_info(where)
            inner = system.get_file_info(fs.FileSelector(where, recursive=True)) if info.type == fs.FileType.Directory else [info]
            start = path[: path.index("://") + 3] if "://" in path else ""
            found += [(start + i.path, i.size) for i in inner if i.type == fs.FileType.File and (len(inner) == 1 or i.path.lower().endswith(self.suffixes))]
        if not found:
            raise FileNotFoundError(f"no slides at {self.paths}")
        return [(k, path, size) for k, (path, size) in enumerate(sorted(found)) if self.keeps("slide_id", k)]


class TileReader(_Reader):
    def partitions(self) -> list[_Part]:
        out = []
        for slide, path, size in self.files():
            parts = max(1, -(-size // self.part_bytes))
            out += [_Part(slide, path, k, parts) for k in range(parts)]
        return out

    def wanted(self, image: TiledImage, part: _Part) -> Iterator[tuple[int, int, np.ndarray]]:
        """``(level, ty, tx)`` of the part's share of the tiles that filters leave."""
        for level in range(len(image.levels)):
            if not self.keeps("level", level):
                continue
            h, w, th, tw = image.size(level)
            down, across = -(-h // th), -(-w // tw)
            first, last = (down * across * k // part.parts for k in (part.part, part.part + 1))
            rows = np.arange(first // across, -(-last // across))
            for ty in rows[self.keeps("ty", rows)].tolist():
                tx = np.arange(max(first - ty * across, 0), min(last - ty * across, across))
                tx = tx[self.keeps("tx", tx)]
                if len(tx):
                    yield level, ty, tx

    def rows(self, image: TiledImage, part: _Part) -> Iterator[tuple]:
        for level, ty, columns in self.wanted(image, part):
            for tx, pixels in image.tiles(level, ty, columns):
                yield part.slide_id, part.path, level, ty, tx, {"height": pixels.shape[0], "width": pixels.shape[1], "data": pixels.tobytes()}

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("slide_id", pa.int64()), ("path", pa.string()), ("level", pa.int32()), ("ty", pa.int32()), ("tx", pa.int32()),
                            ("image", pa.struct([("height", pa.int32()), ("width", pa.int32()), ("data", pa.binary())]))])
        made = lambda held: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
        system, where = _opened(part.path)
        with system.open_input_file(where) as file:
            held, size = [], 0
            for row in self.rows(TiledImage(file), part):
                held.append(row)
                size += len(row[-1]["data"])
                if size >= BATCH_BYTES:
                    yield made(held)
                    held, size = [], 0
            if held:
                yield made(held)


class LevelReader(_Reader):
    pushed = ("slide_id", "level")

    def partitions(self) -> list[_Part]:
        return [_Part(slide, path, 0, 1) for slide, path, _ in self.files()]

    def read(self, part: _Part) -> Iterator[tuple]:
        system, where = _opened(part.path)
        with system.open_input_file(where) as file:
            image = TiledImage(file)
            for level in range(len(image.levels)):
                if self.keeps("level", level):
                    h, w, th, tw = image.size(level)
                    if th != tw:
                        raise ValueError("tiles that are not squares are not supported")
                    yield part.slide_id, part.path, level, w, h, tw, image.downsample(level), image.properties


class SlideTiles(D.DataSource):
    """``spark.read.format("slide_tiles").load(folder)``: ``(slide_id, path, level, ty, tx, image)``.

    Files of a folder, or those named with commas between, are numbered by name from 0. ``suffixes`` are those of a
    folder's files that count, ``partBytes`` the bytes of a file that one task reads.
    """

    @classmethod
    def name(cls) -> str:
        return "slide_tiles"

    def schema(self) -> T.StructType:
        return TILES

    def reader(self, schema: T.StructType) -> TileReader:
        return TileReader(dict(self.options))


class SlideLevels(D.DataSource):
    """``spark.read.format("slide_levels").load(folder)``: the levels of the same files, with properties as a map."""

    @classmethod
    def name(cls) -> str:
        return "slide_levels"

    def schema(self) -> str:
        return LEVELS

    def reader(self, schema: T.StructType) -> LevelReader:
        return LevelReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make both formats known to a session, and let filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SlideTiles)
    spark.dataSource.register(SlideLevels)


def open_slides(spark: SparkSession, path: str, **options: str) -> tuple[DataFrame, DataFrame]:
    """The chunk table and the levels of all slides at a path (SRC1).

    The first is what :func:`gridseek.sources.slides.read_regions` reads from, with a tile's side as ``chunk``.
    """
    register(spark)
    return tuple(spark.read.format(name).options(**options).load(path) for name in ("slide_tiles", "slide_levels"))  # type: ignore[return-value]

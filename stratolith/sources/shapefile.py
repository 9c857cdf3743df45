"""Zipped shapefiles as tables: attributes, and geometry as multi-part arrays of rings."""

from __future__ import annotations

import io
import struct
import uuid
import zipfile
from collections.abc import Iterator
from itertools import accumulate, islice
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratolith.functions.geometry import EARTH_RADIUS  # noqa: F401 (also known from here)
from stratolith.functions.projections import ARRAYS, MERCATOR, Srs, inverse, parse
from stratolith.storage import cut, new_path, spread

#: Geometry as read: parts of rings of points. A line's parts have one ring each.
GEOMETRY = "array<array<array<struct<x:double,y:double>>>>"
#: Fixed values of the format: shape kinds with rings or lines, plain and with Z or M; the main file's code; the end of a field list.
_LINES, _POLYGONS = (3, 13, 23), (5, 15, 25)
_CODE, _LIST_END = 9994, 0x0D
_HEADER = 100
#: Bytes of a text attribute that is written, and rows of a package that are read together.
_TEXT, _TOGETHER = 254, 4096
#: Bytes of shapes, and rows, of a split; bytes of shapes for each task that reads splits; bytes copied or listed at a time.
SPLIT, _SPLIT_ROWS, _TASK, _CHUNK = 8 << 20, 1 << 16, 64 << 20, 1 << 20
#: A split: rows and shapes of a package that lie one after another, and what is needed to read them. Offsets are those of the files named.
_SPLITS = """path string, member string, prj string, fields array<struct<name:string,kind:string,bytes:int,decimals:int>>,
    shapes string, shapes_at long, shapes_bytes long, rows string, rows_at long, width long, n long"""
_ARROW = {"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}
#: Coordinate systems that a .prj names, as packages are written, and words that tell spherical mercator in others.
SYSTEMS = {
    4326: 'GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]]',
    3857: 'PROJCS["WGS_1984_Web_Mercator_Auxiliary_Sphere",GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]],PROJECTION["Mercator_Auxiliary_Sphere"],UNIT["Meter",1.0]]',
}
_MERCATOR = ("mercator_auxiliary_sphere", "pseudo-mercator")


def _signed_area(ring: list[tuple[float, float]]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False)) / 2


def _inside(ring: list[tuple[float, float]], x: float, y: float) -> bool:
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            odd = not odd
    return odd


def _parts(kind: int, body: bytes) -> list[list[list[tuple[float, float]]]] | None:
    """The parts of one shape; holes (counter-clockwise rings) go to the shell that holds them."""
    if kind not in (*_LINES, *_POLYGONS):
        return None
    n_parts, n_points = struct.unpack_from("<2i", body, 36)
    begins = [*struct.unpack_from(f"<{n_parts}i", body, 44), n_points]
    flat = struct.unpack_from(f"<{2 * n_points}d", body, 44 + 4 * n_parts)
    points = list(zip(flat[::2], flat[1::2], strict=True))
    rings = [points[a:b] for a, b in zip(begins, begins[1:], strict=False)]
    if kind in _LINES:
        return [[r] for r in rings]
    shells = [[r] for r in rings if _signed_area(r) <= 0]
    for hole in (r for r in rings if _signed_area(r) > 0):
        home = next((s for s in shells if _inside(s[0], *hole[0])), None)
        if home is None:
            shells.append([hole])  # A shell that winds the wrong way.
        else:
            home.append(hole)
    return shells


def _shapes(data: bytes) -> Iterator[list | None]:
    """The parts of each of the records that ``data`` consists of."""
    at = 0
    while at + 12 <= len(data):
        words = struct.unpack_from(">i", data, at + 4)[0]
        yield _parts(struct.unpack_from("<i", data, at + 8)[0], data[at + 8 : at + 8 + 2 * words])
        at += 8 + 2 * words


def _fields(data: bytes) -> list[tuple[str, str, int, int]]:
    """(name, kind, bytes, decimals) of each attribute."""
    found, at = [], 32
    while data[at] != _LIST_END:
        found.append((data[at : at + 11].split(b"\0")[0].decode("latin-1").lower(), chr(data[at + 11]), data[at + 16], data[at + 17]))
        at += 32
    return found


def _type(kind: str, decimals: int) -> str:
    if kind in "NF":
        return "double" if decimals or kind == "F" else "bigint"
    return "boolean" if kind == "L" else "string"


def _value(raw: bytes, kind: str, decimals: int):
    """An attribute; blank numbers and flags, and numbers that can't be read, are null."""
    text = raw.decode("utf-8", "replace").rstrip("\0 ")
    if kind in "NF":
        try:
            return float(text) if _type(kind, decimals) == "double" else int(text)
        except ValueError:
            return None
    if kind == "L":
        return {"t": True, "y": True, "f": False, "n": False}.get(text.lower())
    return text


def _system(text: str) -> Srs | None:
    """The system that a package's .prj names; None for one that isn't known, whose shapes stay as they are."""
    if not text:
        return None
    if any(word in text.lower() for word in _MERCATOR):
        return MERCATOR
    try:
        return parse(text)
    except ValueError:
        return None


def _degrees(parts: list | None, system: Srs) -> list | None:
    """Shapes of a system as longitude and latitude."""

    def turned(ring: list) -> list:
        lon, lat = inverse(*np.array(ring, float).reshape(-1, 2).T, system, ARRAYS)
        return list(zip(lon.tolist(), lat.tolist(), strict=True))

    return parts and [[turned(ring) for ring in part] for part in parts]


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path as Spark names it, and the path there."""
    scheme, colon, rest = path.partition(":")
    return fs.FileSystem.from_uri(quote({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + colon + rest, safe="/:@"))


def _range(path: str, at: int, size: int) -> bytes:
    store, place = _store(path)
    with store.open_input_file(place) as source:
        return source.read_at(size, at)


def _placed(path: str, source, package: zipfile.ZipFile, name: str, folder: str) -> tuple[str, int]:
    """Where the bytes of a member can be read by ranges: in the package if it is stored, else in a new file under ``folder``."""
    info = package.getinfo(name)
    if info.compress_type == zipfile.ZIP_STORED and not info.flag_bits & 1:
        source.seek(info.header_offset)
        return path, info.header_offset + 30 + sum(struct.unpack_from("<2H", source.read(30), 26))
    copy = f"{folder}/{uuid.uuid4().hex}"
    store, place = _store(copy)
    store.create_dir(_store(folder)[1], recursive=True)
    with package.open(name) as packed, store.open_output_stream(place) as out:
        while data := packed.read(_CHUNK):
            out.write(data)
    return copy, 0


def _indexed(index) -> Iterator[tuple[int, int]]:
    """(first byte, bytes) of each record, its header included, from the index."""
    index.read(_HEADER)
    while data := index.read(_CHUNK):
        for at, words in struct.iter_unpack(">2i", data[: len(data) // 8 * 8]):
            yield 2 * at, 8 + 2 * words


def _walked(shapes, size: int) -> Iterator[tuple[int, int]]:
    """The same from the records' headers, for a package without an index."""
    at = _HEADER
    while at + 12 <= size:
        shapes.seek(at)
        length = 8 + 2 * struct.unpack(">4xi", shapes.read(8))[0]
        yield at, length
        at += length


def _cut_up(records: Iterator[tuple[int, int]], size: int, split: int) -> Iterator[tuple[int, int, int, int]]:
    """(first row, rows, first byte, bytes) of runs of records that lie one after another; one without rows where there are none."""
    first = n = at = length = 0
    for i, (begin, more) in enumerate(records):
        if begin + more > size:
            raise ValueError(f"record {i} ends at byte {begin + more} of {size}")
        if n and (begin != at + length or length + more > split or n == _SPLIT_ROWS):
            yield first, n, at, length
            n = 0
        if not n:
            first, at, length = i, begin, 0
        n, length = n + 1, length + more
    yield first, n, at, length


def _plan(path: str, folder: str, split: int) -> Iterator[dict]:
    """The splits of every shapefile of a package."""
    store, place = _store(path)
    with store.open_input_file(place) as source, zipfile.ZipFile(source) as package:
        names = {n.lower(): n for n in package.namelist()}
        for low, name in sorted(names.items()):
            if not low.endswith(".shp"):
                continue
            table, index, prj = (names.get(low[:-4] + end) for end in (".dbf", ".shx", ".prj"))
            with package.open(table) as opened:
                head = opened.read(32)
                n_rows, begin, width = struct.unpack_from("<IHH", head, 4)
                fields = [dict(zip(("name", "kind", "bytes", "decimals"), f, strict=True)) for f in _fields(head + opened.read(begin - 32))]
            size = package.getinfo(name).file_size
            shapes, shapes_from = _placed(path, source, package, name, folder)
            rows, rows_from = _placed(path, source, package, table, folder)
            whole = {"path": path, "member": low, "prj": package.read(prj).decode("latin-1") if prj else "", "fields": fields, "shapes": shapes, "rows": rows, "width": width}
            with package.open(index or name) as opened:
                records = islice(_indexed(opened) if index else _walked(opened, size), n_rows)
                for first, n, at, length in _cut_up(records, size, split):
                    yield whole | {"shapes_at": shapes_from + at, "shapes_bytes": length, "rows_at": rows_from + begin + first * width, "n": n}


def _rows(split: dict) -> Iterator[tuple[dict, list | None]]:
    """(attributes, parts) of each row of a split; deleted rows are left out.

    Shapes in web or transverse mercator (by the package's .prj) come in degrees, all others as they are.
    """
    system, width = _system(split["prj"]), split["width"]
    table = _range(split["rows"], split["rows_at"], split["n"] * width)
    for i, shape in enumerate(_shapes(_range(split["shapes"], split["shapes_at"], split["shapes_bytes"]))):
        row, at, out = table[i * width : (i + 1) * width], 1, {}
        for field in split["fields"]:
            out[field["name"]] = _value(row[at : at + field["bytes"]], field["kind"], field["decimals"])
            at += field["bytes"]
        if row[:1] != b"*":
            yield out, _degrees(shape, system) if system and system.kind != "degrees" else shape


def _cast(value, kind: str):
    if value is None or kind == "string":
        return None if value is None else str(value)
    return value if isinstance(value, bool) == (kind == "boolean") and not isinstance(value, str) else None


def _geometry(shapes: list) -> pa.Array:
    """Shapes as an array of GEOMETRY, from flat coordinates and offsets."""
    points, rings, parts, whole = [], [], [], []
    for shape in shapes:
        whole.append(None if shape is None else len(parts))
        for part in shape or ():
            parts.append(len(rings))
            for ring in part:
                rings.append(len(points))
                points += ring
    flat = np.array(points, float).reshape(-1, 2)
    found = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["x", "y"])
    for starts, end in ((rings, len(points)), (parts, len(rings)), (whole, len(parts))):
        found = pa.ListArray.from_arrays(pa.array([*starts, end], pa.int32()), found)
    return found


def splits_of(spark: SparkSession, folder: str, pattern: str = r"\.zip$", split: int = SPLIT) -> DataFrame:
    """The splits of the zipped shapefiles under ``folder``, written to the shared folder.

    A task opens a package by its directory and its index (.shx; without one
    by the records' headers), never as a whole. Stored members are read where
    they are. Packed ones can't be read from their middle: they are unpacked
    once, as streams, into the shared folder, where they stay until it is
    cleared. A split has ``split`` bytes of shapes at most, or one larger shape.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    files = files.where(F.element_at(F.split("path", "/"), -1).rlike(pattern)).select("path")
    copies = new_path(spark, "unpacked")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                left = _plan(path, copies, split)
                while found := list(islice(left, _TOGETHER)):
                    columns = ("path", "member", "prj", "fields", "shapes", "shapes_at", "shapes_bytes", "rows", "rows_at", "width", "n")
                    yield pa.RecordBatch.from_arrays([pa.array([s[c] for s in found], kinds[c]) for c in columns], list(columns))

    field = pa.struct([("name", pa.string()), ("kind", pa.string()), ("bytes", pa.int32()), ("decimals", pa.int32())])
    kinds = {"fields": pa.list_(field), **dict.fromkeys(("path", "member", "prj", "shapes", "rows"), pa.string()), **dict.fromkeys(("shapes_at", "shapes_bytes", "rows_at", "width", "n"), pa.int64())}
    return cut(files.mapInArrow(each, _SPLITS), "splits")


def read_zipped(spark: SparkSession, folder: str, pattern: str = r"\.zip$", split: int = SPLIT) -> DataFrame:
    """All rows of the zipped shapefiles under ``folder`` whose file name has a match of ``pattern``.

    The first shapefile by path fixes the columns, as a table that it creates
    would; those that lack one give null, and more than those are left
    out. Geometry comes as ``geom``, always in parts (lines too), in the
    packages' own coordinates but for web and transverse mercator (UTM), which become degrees;
    shapes of other kinds are null. An attribute
    of that name is called ``geom_`` instead. Packages are cut into ranges of
    records (see ``splits_of``), so many tasks read a large one; only a header
    comes to the driver. Without a package there are no rows, and ``geom`` is
    the one column.
    """
    splits = splits_of(spark, folder, pattern, split)
    first = splits.orderBy("path", "member").select("fields").first()
    columns = [(f["name"], _type(f["kind"], f["decimals"])) for f in first["fields"]] if first else []
    shown = {name: "geom_" if name == "geom" else name for name, _ in columns}
    schema = ", ".join([*[f"`{shown[n]}` {t}" for n, t in columns], f"geom {GEOMETRY}"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in batch.to_pylist():
                left = _rows(one)
                while rows := list(islice(left, _TOGETHER)):
                    values = [pa.array([_cast(r.get(n), t) for r, _ in rows], _ARROW[t]) for n, t in columns]
                    yield pa.RecordBatch.from_arrays([*values, _geometry([p for _, p in rows])], [*[shown[n] for n, _ in columns], "geom"])

    size = splits.agg(F.count("*").alias("n"), F.coalesce(F.sum("shapes_bytes"), F.lit(0)).alias("bytes")).first()
    tasks = max(1, min(size["n"], max(spread(splits), size["bytes"] // _TASK)))
    return splits.repartition(tasks).mapInArrow(each, schema)


def _shape(parts: list | None) -> bytes:
    """A polygon record's body; shells are turned clockwise, holes the other way."""
    if not parts:
        return struct.pack("<i", 0)
    rings = []
    for part in parts:
        for i, ring in enumerate(part):
            points = [(p["x"], p["y"]) for p in ring]
            rings.append(points[::-1] if (_signed_area(points) > 0) == (i == 0) else points)
    flat = [p for r in rings for p in r]
    xs, ys = [p[0] for p in flat], [p[1] for p in flat]
    begins = list(accumulate((len(r) for r in rings[:-1]), initial=0))
    head = struct.pack("<i4d2i", 5, min(xs), min(ys), max(xs), max(ys), len(rings), len(flat))
    return head + struct.pack(f"<{len(rings)}i", *begins) + struct.pack(f"<{2 * len(flat)}d", *[v for p in flat for v in p])


def _package(names: list[str], columns: list[pa.Array], shapes: list, system: int) -> bytes:
    """One shapefile as a package. Integers are numbers without decimals, floats with ten; all else is text."""
    kinds = [("N", 20, 0) if pa.types.is_integer(t) else ("N", 32, 10) if pa.types.is_floating(t) else ("C", _TEXT, 0) for t in (c.type for c in columns)]
    bodies = [_shape(s) for s in shapes]
    boxes = [struct.unpack_from("<4d", b, 4) for b in bodies if len(b) > 4]
    box = [f(b[i] for b in boxes) if boxes else 0.0 for i, f in enumerate((min, min, max, max))]
    size = (_HEADER + sum(8 + len(b) for b in bodies)) // 2
    kind_and_box = struct.pack("<2i8d", 1000, 5, *box, 0, 0, 0, 0)
    shx = struct.pack(">i20xi", _CODE, (_HEADER + 8 * len(bodies)) // 2) + kind_and_box
    places = accumulate((8 + len(b) for b in bodies), initial=_HEADER)
    shx += b"".join(struct.pack(">2i", at // 2, len(b) // 2) for at, b in zip(places, bodies, strict=False))
    shp = struct.pack(">i20xi", _CODE, size) + kind_and_box
    shp += b"".join(struct.pack(">2i", i, len(b) // 2) + b for i, b in enumerate(bodies, 1))
    width = 1 + sum(k[1] for k in kinds)
    dbf = struct.pack("<4BIHH20x", 3, 100, 1, 1, len(shapes), 33 + 32 * len(kinds), width)
    dbf = bytearray(dbf)
    dbf += b"".join(struct.pack("<11sc4xBB14x", n.encode()[:10], k.encode(), s, d) for n, (k, s, d) in zip(names, kinds, strict=True)) + bytes([_LIST_END])
    for row in zip(*[c.to_pylist() for c in columns], strict=True) if columns else ([] for _ in shapes):
        dbf += b" "
        for value, (kind, s, d) in zip(row, kinds, strict=True):
            text = "" if value is None else f"{value:.{d}f}" if kind == "N" else str(value)
            data = text.encode()
            if len(data) > s:
                raise ValueError(f"attribute of {len(data)} bytes; the format holds {s}")
            dbf += data.rjust(s) if kind == "N" else data.ljust(s)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as package:
        package.writestr("shapes.shp", shp)
        package.writestr("shapes.shx", shx)
        package.writestr("shapes.dbf", bytes(dbf))
        package.writestr("shapes.prj", SYSTEMS[system])
    return out.getvalue()


def write_zipped(df: DataFrame, folder: str, geometry: str = "geom", system: int = 4326, named: str | None = None) -> DataFrame:
    """Write the rows as zipped shapefiles, one for each batch; (path, rows) of each. ``system`` (4326 or 3857) is that of the coordinates.

    ``geometry`` is an array of polygons, as read_zipped gives it; null or
    empty ones are null shapes. Names of attributes are cut to ten bytes by
    the format. ``named`` is a column (no attribute) whose texts are the packages':
    a batch becomes one for each text, called ``text_<32 hex digits>.zip``, so
    no text's rows have to meet in one task; rows with a null go to packages
    without a text. A package that a lost task leaves behind is in no row of
    the result.
    """
    names = [c for c in df.columns if c not in (geometry, named)]
    if len({n[:10].lower() for n in names}) < len(names):
        raise ValueError("attribute names must differ in their first ten letters")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            places: dict[str | None, list[int]] = {}
            for i, text in enumerate(batch.column(len(names) + 1).to_pylist() if named else [None] * batch.num_rows):
                places.setdefault(text, []).append(i)
            for text, rows in places.items():
                path = f"{base}/{'' if text is None else text + '_'}{uuid.uuid4().hex}.zip"
                part = batch.take(pa.array(rows, pa.int64())) if named else batch
                data = _package(names, [part.column(i) for i in range(len(names))], part.column(len(names)).to_pylist(), system)
                with store.open_output_stream(path) as out:
                    out.write(data)
                yield pa.RecordBatch.from_pydict({"path": [path], "rows": pa.array([len(rows)], pa.int64())})

    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    chosen = df.select(*names, geometry, *([named] if named else []))
    return (chosen.sortWithinPartitions(named) if named else chosen).mapInArrow(each, "path string, rows long")

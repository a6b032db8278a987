"""Files as bytes: what a picture's header declares, the meshes of a glTF binary, and which files may be read at all.

One row always comes out for a file, with the reason where it can't be read.
"""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The colour space that a raster's mode stands for, the plausible resolutions, and the most pixels.
SPACES = {"CMYK": "DeviceCMYK", "RGB": "DeviceRGB", "RGBA": "DeviceRGB", "L": "DeviceGray", "LA": "DeviceGray", "1": "DeviceGray", "P": "Indexed", "PA": "Indexed", "I;16": "DeviceGray", "I": "DeviceGray", "F": "DeviceGray", "YCbCr": "DeviceRGB", "LAB": "Lab", "HSV": "DeviceRGB"}
LEAST_DPI, MOST_DPI, MOST_PIXELS = 30.0, 2400.0, 400_000_000
#: Fixed values of PNG: the mode of each colour type.
_PNG = {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}
HEADER = "path string, width int, height int, mode string, alpha boolean, dpi_x double, dpi_y double, reason string"


def _png(data: bytes) -> dict:
    out, at = {}, 8
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            w, h, depth, colour = struct.unpack(">IIBB", body[:10])
            out |= {"width": w, "height": h, "mode": "1" if (depth, colour) == (1, 0) else "I;16" if (depth, colour) == (16, 0) else _PNG[colour], "alpha": colour in (4, 6)}
        elif kind == b"tRNS":
            out["alpha"] = True
        elif kind == b"pHYs" and body[8:9] == b"\x01":
            out["dpi_x"], out["dpi_y"] = (n * 0.0254 for n in struct.unpack(">II", body[:8]))
        elif kind == b"IDAT":
            break
        at += 12 + size
    return out


def _jpeg(data: bytes) -> dict:
    out, at = {"alpha": False}, 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        mark, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        if mark == 0xE0 and body[:5] == b"JFIF\x00" and body[7] in (1, 2):
            times = 1.0 if body[7] == 1 else 2.54
            out["dpi_x"], out["dpi_y"] = (n * times for n in struct.unpack(">HH", body[8:12]))
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            h, w, parts = struct.unpack(">HHB", body[1:6])
            return out | {"width": w, "height": h, "mode": {1: "L", 3: "RGB", 4: "CMYK"}[parts]}
        at += 2 + size
    raise ValueError("no frame")


def _header(data: bytes) -> dict:
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            out = _png(data)
        elif data[:2] == b"\xff\xd8":
            out = _jpeg(data)
        else:
            return {"reason": "no known picture"}
        return out | ({"reason": "too many pixels"} if out["width"] * out["height"] > MOST_PIXELS else {})
    except (KeyError, IndexError, struct.error, ValueError) as e:
        return {"reason": f"damaged: {type(e).__name__}"}


def raster_headers(files: DataFrame) -> DataFrame:
    """HEADER of files (path, content) and colour_space, width_mm, height_mm: what PNG and JPEG pictures declare; the size only by a plausible resolution."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [{"path": p} | _header(c or b"") for p, c in zip(*(x.to_pylist() for x in batch.columns), strict=True)]
            names = [x.split()[0] for x in HEADER.split(", ")]
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.float64(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in found], k) for n, k in zip(names, kinds, strict=True)], names)

    out = files.select("path", "content").mapInArrow(run, HEADER)
    return out.withColumns({"colour_space": colour_space(F.col("mode")), "width_mm": tagged_mm(F.col("width"), F.col("dpi_x"), F.col("dpi_y")), "height_mm": tagged_mm(F.col("height"), F.col("dpi_y"), F.col("dpi_x"))})


def colour_space(mode: Column) -> Column:
    """The colour space a mode stands for; an unknown mode stands for itself."""
    table = F.create_map(*[F.lit(x) for pair in SPACES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, mode), mode)


def tagged_mm(px: Column, dpi: Column, other: Column) -> Column:
    """The size that a resolution implies; null if either axis has an absurd one."""
    fine = lambda d: d.between(LEAST_DPI, MOST_DPI)
    return F.when(fine(dpi) & fine(other), px / dpi * 25.4)


#: Fixed values of glTF: the magic number and the chunks' kinds, the component types, the numbers in an element.
_GLB, _JSON, _BIN = 0x46546C67, 0x4E4F534A, 0x004E4942
_KINDS, _WIDTHS = {5120: "b", 5121: "B", 5122: "h", 5123: "H", 5125: "I", 5126: "f"}, {"SCALAR": 1, "VEC2": 2, "VEC3": 3, "VEC4": 4}
_FULL = {"b": 127, "B": 255, "h": 32767, "H": 65535}
VERTICES = "path string, mesh int, primitive int, v long, x double, y double, z double, tu double, tv double, reason string"


def _accessor(doc: dict, blob: bytes, index: int) -> list[tuple]:
    a = doc["accessors"][index]
    view = doc["bufferViews"][a["bufferView"]]
    kind, width = _KINDS[a["componentType"]], _WIDTHS[a["type"]]
    size = struct.calcsize(f"<{width}{kind}")
    stride, at = view.get("byteStride") or size, view.get("byteOffset", 0) + a.get("byteOffset", 0)
    rows = [struct.unpack_from(f"<{width}{kind}", blob, at + i * stride) for i in range(a["count"])]
    return [tuple(max(-1.0, n / _FULL[kind]) for n in r) for r in rows] if a.get("normalized") and kind in _FULL else rows


def _glb(data: bytes) -> tuple[dict, bytes]:
    magic, version, total = struct.unpack_from("<III", data)
    if magic != _GLB or version != 2 or total > len(data):
        raise ValueError("no glTF 2 binary")
    at, doc, blob = 12, {}, b""
    while at + 8 <= total:
        size, kind = struct.unpack_from("<II", data, at)
        body = data[at + 8 : at + 8 + size]
        doc, blob = (json.loads(body), blob) if kind == _JSON else (doc, body) if kind == _BIN else (doc, blob)
        at += 8 + size
    return doc, blob


def _read_glb(path: str, data: bytes) -> tuple[list[dict], list[dict]]:
    vertices, triangles = [], []
    try:
        doc, blob = _glb(data)
        for m, mesh in enumerate(doc.get("meshes", [])):
            for p, part in enumerate(mesh["primitives"]):
                own = {"path": path, "mesh": m, "primitive": p}
                places = _accessor(doc, blob, part["attributes"]["POSITION"])
                at = part["attributes"].get("TEXCOORD_0")
                texture = _accessor(doc, blob, at) if at is not None else [(None, None)] * len(places)
                vertices += [own | {"v": i, "x": float(a[0]), "y": float(a[1]), "z": float(a[2]), "tu": b[0], "tv": b[1]} for i, (a, b) in enumerate(zip(places, texture, strict=True))]
                index = [r[0] for r in _accessor(doc, blob, part["indices"])] if "indices" in part else list(range(len(places)))
                triangles += [own | {"t": t // 3, "v0": index[t], "v1": index[t + 1], "v2": index[t + 2]} for t in range(0, len(index) - 2, 3)]
    except (KeyError, IndexError, TypeError, struct.error, ValueError) as e:
        return [{"path": path, "reason": str(e) or type(e).__name__}], []
    return vertices, triangles


def glb_vertices(files: DataFrame) -> DataFrame:
    """VERTICES of glTF binaries (path, content), with their texture coordinates; a file that can't be read is a row with the reason."""
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), *[pa.float64()] * 5, pa.string()]
    return _glb_rows(files, 0, VERTICES, kinds)


def glb_triangles(files: DataFrame) -> DataFrame:
    """path, mesh, primitive, t, v0, v1, v2 of glTF binaries (path, content)."""
    return _glb_rows(files, 1, "path string, mesh int, primitive int, t long, v0 long, v1 long, v2 long", [pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * 4])


def _glb_rows(files: DataFrame, part: int, schema: str, kinds: list[pa.DataType]) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                rows = _read_glb(path, content or b"")[part]
                yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)

    return files.select("path", "content").mapInArrow(run, schema)


#: Fixed value: what a token that names a file consists of.
TOKEN = "[A-Za-z0-9_-]{4,64}"


def side_files(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """token, path, content of the files <token>.<suffix> in a folder; others are not read."""
    files = spark.read.format("binaryFile").load(folder)
    token = F.regexp_extract("path", rf"/({TOKEN})\.{suffix}$", 1)
    return files.select(token.alias("token"), "path", "content").filter("token <> ''")


def allowed(path: str, roots: list[str]) -> str:
    """The real path, if it lies under one of the roots; links are followed first."""
    real = os.path.realpath(path)
    for root in map(os.path.realpath, roots):
        if real == root or real.startswith(root.rstrip("/") + "/"):
            return real
    raise PermissionError(f"{path} lies under no shared folder")


#: A line of an access log: who, address, method, path, status, milliseconds.
_LINE = r'^(\S+) (\S+) "?([A-Z]+) (\S+?)"? (\d{3}) (\d+)\s*m?s?$'


def access_log(lines: Column) -> Column:
    """struct(who, address, method, path, status, ms) of a line, or null for any other line, static files and traces."""
    part = lambda i: F.regexp_extract(lines, _LINE, i)
    own = F.struct(part(1).alias("who"), part(2).alias("address"), part(3).alias("method"), part(4).alias("path"), part(5).try_cast("int").alias("status"), part(6).try_cast("long").alias("ms"))
    return F.when(lines.rlike(_LINE) & ~part(4).rlike("^/(static/|api/trace)"), own)


def logged(who: Column, address: Column, method: Column, path: Column, status: Column, ms: Column) -> Column:
    """The line that access_log reads."""
    return F.concat_ws(" ", who, address, method, path, status.cast("string"), F.concat(ms.cast("long").cast("string"), F.lit("ms")))


def rewritten(spark: SparkSession, path: str, blocks: dict[str, object]) -> None:
    """Writes a JSON document anew with some of its blocks replaced: first beside it, then in its place. For one small document.

    The new document takes the old one's name in one step of the file system, so at every moment one of them can be read
    whole; a write that fails before leaves the old one, and what lies beside it is written over the next time.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at, beside = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, path + ".tmp"))
    store = at.getFileSystem(conf)
    old = json.loads(spark.read.text(path, wholetext=True).first()[0]) if store.exists(at) else {}
    out = store.create(beside, True)
    out.write(bytearray(json.dumps(old | blocks, ensure_ascii=False, indent=2).encode()))
    out.close()
    over = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    over[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    at, beside = store.makeQualified(at), store.makeQualified(beside)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), conf).rename(beside, at, over)

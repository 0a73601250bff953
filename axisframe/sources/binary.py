"""Binary sources: NumPy archives, density maps and trajectory records, from frames (path, content) of whole files."""

from __future__ import annotations

import gzip
import io
import re
import struct
import zipfile

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the formats.
VOXELS = {0: "<i1", 1: "<i2", 2: "<f4", 6: "<u2"}
XTC_MAGIC = 1995
#: Values that a task holds before it passes them on.
_VALUES = 1 << 17


def contents(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def npz_arrays(archives: DataFrame, members: list[str]) -> DataFrame:
    """(path, name, shape, values in row order): exactly these arrays of each archive, each once; all else is an error."""

    def run(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = [n.removesuffix(".npy") for n in z.namelist()]
                if sorted(names) != sorted(members):
                    raise ValueError(f"{path} holds {sorted(names)}, not {sorted(members)}")
                arrays = np.load(io.BytesIO(content), allow_pickle=False)
                yield pd.DataFrame({"path": path, "name": members, "shape": [list(arrays[m].shape) for m in members], "values": [arrays[m].astype(float).ravel() for m in members]})

    return archives.select("path", "content").mapInPandas(run, "path string, name string, shape array<int>, values array<double>")


def _zip_members(path: str, content: bytes, members: list[str], folder: str) -> list[bytes]:
    """These members of a ZIP, read where its directory says they lie."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        found = [i for i in z.infolist() if not i.is_dir()]
        out = []
        for member in members:
            own = [i for i in found if i.filename == folder + member]
            if len(own) != 1:
                raise ValueError(f"{path} holds {folder}{member} {len(own)} times")
            if own[0].flag_bits & 1:
                raise ValueError(f"{path}: {folder}{member} is encrypted")
            out.append(z.read(own[0]))
    return out


def bundle_arrays(files: DataFrame, members: list[str], *, folder: str = "data/") -> DataFrame:
    """(bundle, member, name, shape, values in row order) of the arrays of bundles, whichever way each is laid out.

    ``files`` has (path, content). A bundle is a directory ``<bundle>/data/...`` or a ZIP ``<bundle>.zip`` of the same
    files. Of each,
    exactly the named ``members`` are read, from the archive in place; a member that is missing or there twice, an
    encrypted one, or one bundle in both layouts is an error, other files are passed over. A member is one array
    (``.npy``, whose name is the member's) or several (``.npz``).
    """
    inside = "|".join(re.escape(m) for m in members)
    zipped = F.regexp_extract("path", r"([^/]+)\.zip$", 1)
    plain = F.regexp_extract("path", rf"([^/]+)/{re.escape(folder)}(?:{inside})$", 1)
    member = F.regexp_extract("path", rf"[^/]+/{re.escape(folder)}({inside})$", 1)
    files = files.select("path", zipped.alias("zip"), plain.alias("plain"), member.alias("member"), "content").where("zip <> '' or plain <> ''")
    named = files.select(F.when(F.col("zip") != "", F.col("zip")).otherwise(F.col("plain")).alias("bundle"), (F.col("zip") != "").alias("is_zip"), "path", "member", "content")
    whole = F.count_if(F.col("is_zip")) * len(members) + F.count_if(~F.col("is_zip"))
    said = F.concat(F.lit("bundle "), F.col("bundle"), F.lit(" has "), whole.cast("string"), F.lit(f" of {len(members)} members"))
    checked = named.groupBy("bundle").agg(F.when((whole == len(members)) & (F.count_distinct("member", "is_zip") <= len(members)), F.lit(True)).otherwise(F.raise_error(said).cast("boolean")).alias("whole"))

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for at in range(batch.num_rows):  # a file's bytes are taken out of the batch in turn
                bundle, is_zip, where, member, content = (c[at].as_py() for c in batch.columns)
                parts = zip(members, _zip_members(where, content, members, folder), strict=True) if is_zip else [(member, content)]
                for name, raw in parts:
                    loaded = np.load(io.BytesIO(raw), allow_pickle=False)
                    arrays = {name.removesuffix(".npy"): loaded} if isinstance(loaded, np.ndarray) else {n: loaded[n] for n in loaded.files}
                    for n, array in arrays.items():
                        rows.append((bundle, name, n, list(array.shape), array.astype(float).ravel()))
                        size += array.size
                if size >= _VALUES:
                    yield _arrays(rows)
                    rows, size = [], 0
        if rows:
            yield _arrays(rows)

    rows = named.join(checked, "bundle").where("whole").select("bundle", "is_zip", "path", "member", "content")
    return rows.mapInArrow(run, "bundle string, member string, name string, shape array<int>, values array<double>")


def _arrays(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of (bundle, member, name, shape, values) as one batch."""
    bundle, member, name, shape, values = zip(*rows, strict=True)
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values)))
    return pa.RecordBatch.from_arrays([pa.array(bundle), pa.array(member), pa.array(name), pa.array(shape, pa.list_(pa.int32())), lists], names=["bundle", "member", "name", "shape", "values"])


def map_header(raw: bytes) -> dict:
    """The header of a density map."""
    if len(raw) < 1024:
        raise ValueError("a density map has a header of 1024 bytes")
    nx, ny, nz, mode = struct.unpack_from("<4i", raw, 0)
    if mode not in VOXELS:
        raise ValueError(f"voxel mode {mode} is not supported")
    grid, cell = struct.unpack_from("<3i", raw, 28), struct.unpack_from("<3f", raw, 40)
    low, high, mean = struct.unpack_from("<3f", raw, 76)
    (extra,) = struct.unpack_from("<i", raw, 92)
    spacing = [c / g if g else None for c, g in zip(cell, grid, strict=True)]
    return {"dimensions": [nx, ny, nz], "mode": mode, "spacing": spacing, "low": low, "high": high, "mean": mean, "rms": struct.unpack_from("<f", raw, 216)[0], "origin": list(struct.unpack_from("<3f", raw, 196)), "extra": extra}


def _plain(content: bytes) -> bytes:
    return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content


def density_headers(maps: DataFrame) -> DataFrame:
    """(path, dimensions, mode, spacing, low, high, mean, rms, origin) of plain or gzipped maps."""

    def run(batches):
        for pdf in batches:
            heads = [map_header(_plain(c)) for c in pdf["content"]]
            yield pd.DataFrame({"path": pdf["path"], **{k: [h[k] for h in heads] for k in ("dimensions", "mode", "spacing", "low", "high", "mean", "rms", "origin")}})

    return maps.select("path", "content").mapInPandas(run, "path string, dimensions array<int>, mode int, spacing array<double>, low double, high double, mean double, rms double, origin array<double>")


def density_voxels(maps: DataFrame, stride: int = 1) -> DataFrame:
    """(path, voxel, value): every ``stride``-th voxel, numbered in file order; a short file is an error."""

    def run(batches):
        rows, held = [], 0

        def passed() -> pa.RecordBatch:
            path = pa.DictionaryArray.from_arrays(np.repeat(np.arange(len(rows), dtype=np.int32), [len(at) for _, at, _ in rows]), pa.array([p for p, _, _ in rows], pa.string()))
            return pa.RecordBatch.from_arrays([path.dictionary_decode(), *[pa.array(np.concatenate([r[k] for r in rows])) for k in (1, 2)]], names=["path", "voxel", "value"])

        for batch in batches:
            for of in range(batch.num_rows):  # a file's bytes are taken out of the batch in turn
                path, content = (c[of].as_py() for c in batch.columns)
                raw = _plain(content)
                head = map_header(raw)
                kind, n = np.dtype(VOXELS[head["mode"]]), int(np.prod(head["dimensions"]))
                start = 1024 + head["extra"]
                if len(raw) < start + n * kind.itemsize:
                    raise ValueError(f"{path} has fewer voxels than its header says")
                values = np.frombuffer(raw, kind, n, start)
                for low in range(0, n, _VALUES):
                    at = np.arange(low + -low % stride, min(n, low + _VALUES), stride)
                    rows.append((path, at, values[at].astype(float)))
                    held += len(at)
                    if held >= _VALUES:
                        yield passed()
                        rows, held = [], 0
        if rows:
            yield passed()

    return maps.select("path", "content").mapInArrow(run, "path string, voxel long, value double")


def xtc_records(content: bytes):
    """(offset, bytes, atoms, step, time, box, coordinates or None) of each record; damaged records are errors."""
    at = 0
    while at < len(content):
        if len(content) < at + 56:
            raise ValueError("truncated record header")
        magic, atoms, step, time = struct.unpack_from(">iiif", content, at)
        box = struct.unpack_from(">9f", content, at + 16)
        (again,) = struct.unpack_from(">i", content, at + 52)
        if magic != XTC_MAGIC or atoms != again or not 0 < atoms < 10_000_000:
            raise ValueError("not a trajectory record")
        points = None
        if atoms <= 9:  # so few are stored as they are
            size = 56 + 12 * atoms
        else:
            if len(content) < at + 92:
                raise ValueError("truncated record header")
            (packed,) = struct.unpack_from(">i", content, at + 88)
            if packed <= 0:
                raise ValueError("a record without coordinates")
            size = 92 + -(-packed // 4) * 4
        if len(content) < at + size:
            raise ValueError("truncated record")
        if atoms <= 9:
            points = np.frombuffer(content, ">f4", 3 * atoms, at + 56).astype(float)
        yield at, size, atoms, step, time, box, points
        at += size


def trajectory_records(trajectories: DataFrame, batch_bytes: int = 8 << 20) -> DataFrame:
    """(path, frame, batch, offset, n_bytes, n_atoms, step, time_ps, box, coordinates): frames by record boundaries.

    A batch ends with the record that fills ``batch_bytes``. Coordinates of more than nine atoms stay packed (null).
    """

    def run(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                rows, batch, held = [], 0, 0
                for frame, (at, size, atoms, step, time, box, points) in enumerate(xtc_records(content)):
                    rows.append((path, frame, batch, at, size, atoms, step, time, list(box), points))
                    held += size
                    if held >= batch_bytes:
                        yield pd.DataFrame(rows, columns=names)
                        rows, batch, held = [], batch + 1, 0
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    schema = "path string, frame int, batch int, offset long, n_bytes int, n_atoms int, step int, time_ps double, box array<double>, coordinates array<double>"
    names = [c.strip().split(" ")[0] for c in schema.split(", ")]
    return trajectories.select("path", "content").mapInPandas(run, schema)

"""Readers, sinks, integrity checks and the frame stream: round trips and damaged inputs."""

import gzip
import struct

import numpy as np
import pytest
from pyspark.errors import PythonException, SparkRuntimeException
from pyspark.sql import functions as F

from axisframe.operators import integrity
from axisframe.operators.gates import GateError
from axisframe.sources import binary, sinks, text
from axisframe.streaming import frames as S


def texts(spark, *pairs):
    return spark.createDataFrame(list(pairs), "path string, text string")


def contents(spark, *pairs):
    return spark.createDataFrame([(p, bytearray(c)) for p, c in pairs], "path string, content binary")


def test_csv_plain_and_gzipped(spark, tmp_path):
    (tmp_path / "a.csv").write_text("pdb,score\n 4tz4 ,1.5\n4CI1,\n")
    with gzip.open(tmp_path / "b.csv.gz", "wt") as f:
        f.write("pdb,score\nx,\n")
    plain = text.read_csv(spark, str(tmp_path / "a.csv"))
    assert [tuple(r) for r in plain.collect()] == [(" 4tz4 ", "1.5"), ("4CI1", "")]
    assert text.read_csv(spark, str(tmp_path / "b.csv.gz")).first().score == ""
    assert [r.pdb for r in text.read_keyed(spark, str(tmp_path / "a.csv"), "pdb").collect()] == ["4TZ4", "4CI1"]
    with pytest.raises(GateError):
        text.read_csv(spark, str(tmp_path / "a.csv"), required=["missing"])
    with pytest.raises(GateError):
        text.read_csv(spark, str(tmp_path / "a.csv"), "pdb string, score double", finite=["score"])
    (tmp_path / "c.csv").write_text("pdb\na\nA \n")
    with pytest.raises(GateError):
        text.read_keyed(spark, str(tmp_path / "c.csv"), "pdb")


CIF = """data_x
loop_
_struct_ref_seq.align_id
_struct_ref_seq.pdbx_db_accession
_struct_ref_seq.pdbx_strand_id
_struct_ref_seq.db_align_beg
_struct_ref_seq.db_align_end
1 Q1 B,A 10 20
2 q1 'A, B' 5 8
3 Q1 ? 1 3
4 Q2 A 1
9
#
loop_
_atom_site.group_PDB
_atom_site.label_atom_id
_atom_site.label_alt_id
_atom_site.auth_asym_id
_atom_site.auth_seq_id
_atom_site.Cartn_x
_atom_site.Cartn_y
_atom_site.Cartn_z
_atom_site.occupancy
ATOM CA A A 7 1.0 2.0 3.0 0.5
ATOM CA B A 7 99 99 99 0.5
ATOM "C A" . A 8 1 1 1 1
HETATM CA . A 9 1 1 1 1
"""


def test_mmcif_loops(spark):
    frame = texts(spark, ("one", CIF), ("none", "data_y\n"))
    rows = text.mmcif_loop(frame, "struct_ref_seq").collect()
    assert len(rows) == 4 and rows[1].fields["pdbx_strand_id"] == "A, B" and rows[3].fields["db_align_end"] == "9"
    atoms = text.alpha_carbons(frame).collect()
    assert [tuple(r) for r in atoms] == [("one", "A", 7, 1.0, 2.0, 3.0, 0.5, 2)]
    groups = {r.strands: [tuple(x) for x in r.ranges] for r in text.range_groups(frame, "q1", 442).collect()}
    assert groups == {"A,B": [(5, 8), (10, 20)], "row 2": [(1, 3)]}
    for beg, end in ((0, 442), (-5, 100), (50, 49), (1, 443)):
        with pytest.raises(GateError):
            text.range_groups(texts(spark, ("x", CIF.replace("10 20", f"{beg} {end}"))), "Q1", 442)
    with pytest.raises(PythonException):
        text.mmcif_loop(texts(spark, ("x", CIF.replace("3 Q1 ? 1 3\n4 Q2 A 1\n9", "3 Q1 ? 1"))), "struct_ref_seq").count()
    with pytest.raises(PythonException):
        text.mmcif_loop(texts(spark, ("x", CIF.replace("1 Q1 B,A", ";long\n1 Q1 B,A"))), "struct_ref_seq").count()


def test_pdb_frames_and_files(spark, tmp_path):
    atom = "ATOM  {:5d}  {:3s} ALA {}{:4d}    {:8.3f}{:8.3f}{:8.3f}\n"
    body = "".join("MODEL     {}\n".format(m) + atom.format(1, "CA", "A", 5, m, 2, 3) + atom.format(2, "CB", "B", 5, m, 2, 3) + "ENDMDL\n" for m in (1, 2))
    (tmp_path / "m.pdb").write_text("HEADER\n" + body)
    (tmp_path / "n.pdb").write_text(atom.format(1, "CA", "A", 1, -1.5, 0, 0))
    rows = text.pdb_atoms(text.files(spark, str(tmp_path)), atom="CA", chain="A").orderBy("path", "frame").collect()
    assert [(r.frame, r.resnum, r.x) for r in rows] == [(1, 5, 1.0), (2, 5, 2.0), (0, 1, -1.5)]


def test_scattering_curves(spark):
    q = np.linspace(0.004, 0.12, 80)
    rows = "\n".join(f"{x} {0.42 * np.exp(-(x**2) * 2.35**2 / 3)} 0.001" for x in q)
    frame = texts(spark, ("a", 'Sample, q in 1/nm {"c": 2}\n' + rows + "\ninf 1 1\n"), ("b", "q [1/A] or 1/nm\n1 2 3"), ("c", "1 2 3\n"))
    points = text.scattering_points(frame)
    assert points.where("path = 'a'").count() == 80 and points.count() == 82
    heads = text.scattering_headers(frame)
    assert {r.path: r.unit for r in text.unit_evidence(heads).collect()} == {"a": "1/nm", "b": "conflicting"}
    assert text.header_json(heads, "c int").first().value.c == 2
    with pytest.raises(SparkRuntimeException):
        text.scattering_points(texts(spark, ("x", "1 2 0\n"))).collect()
    assert text.mutations(texts(spark, ("a", "W386A and Y384A, W386A; not B12C"))).first().mutations == ["W386A", "Y384A"]


def test_archives(spark, tmp_path):
    np.savez(tmp_path / "a.npz", x=np.arange(6).reshape(2, 3), y=np.array([1.5]))
    frame = binary.contents(spark, str(tmp_path))
    got = {r.name: (r["shape"], r["values"]) for r in binary.npz_arrays(frame, ["x", "y"]).collect()}
    assert got == {"x": ([2, 3], [0.0, 1, 2, 3, 4, 5]), "y": ([1], [1.5])}
    with pytest.raises(PythonException):
        binary.npz_arrays(frame, ["x"]).count()


def test_density_maps(spark):
    head = bytearray(1024)
    struct.pack_into("<4i", head, 0, 4, 3, 2, 2)
    struct.pack_into("<3i", head, 28, 4, 3, 0)
    struct.pack_into("<3f", head, 40, 8, 3, 2)
    raw = bytes(head) + np.arange(24, dtype="<f4").tobytes()
    frame = contents(spark, ("plain", raw), ("packed", gzip.compress(raw)))
    assert [r.spacing for r in binary.density_headers(frame).collect()] == [[2.0, 1.0, None]] * 2
    assert [r.value for r in binary.density_voxels(frame.where("path = 'packed'"), 5).collect()] == [0.0, 5.0, 10.0, 15.0, 20.0]
    for bad in (raw[:100], raw[:-1], raw[:12] + struct.pack("<i", 9) + raw[16:]):
        with pytest.raises(PythonException):
            binary.density_voxels(contents(spark, ("x", bad))).count()


def _record(atoms, step, packed=b""):
    head = struct.pack(">iiif", 1995, atoms, step, step * 0.5) + struct.pack(">9f", *range(9)) + struct.pack(">i", atoms)
    return head + (np.arange(3 * atoms).astype(">f4").tobytes() if atoms <= 9 else b"\0" * 32 + struct.pack(">i", len(packed)) + packed + b"\0" * (-len(packed) % 4))


def test_trajectory_records(spark):
    raw = _record(3, 0) + _record(12, 1, b"12345") + _record(3, 2)
    rows = binary.trajectory_records(contents(spark, ("t", raw)), batch_bytes=150).orderBy("frame").collect()
    assert [(r.step, r.n_atoms, r.batch) for r in rows] == [(0, 3, 0), (1, 12, 0), (2, 3, 1)]
    assert rows[0].coordinates == [float(x) for x in range(9)] and rows[1].coordinates is None and rows[1].offset == 92
    for bad in (raw[:-3], raw[:30], b"\0\0\0\1" + raw[4:], raw + b"\0"):
        with pytest.raises(PythonException):
            binary.trajectory_records(contents(spark, ("t", bad))).count()


def test_kept_results_follow_their_inputs(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "i int, t string")
    build = lambda: rows.withColumn("n", F.lit(1))
    say = lambda frame, **more: sinks.kept(spark, str(tmp_path), "x", {"rows": frame}, {"c": 1, **more}, "1", build)[1]
    assert [say(rows), say(rows.repartition(3)), say(rows.limit(1)), say(rows, d=2)] == ["built", "reused", "built", "built"]
    folder = next(p for p in tmp_path.iterdir() if sinks.json_digest({"inputs": {"rows": sinks.table_digest(rows)}, "config": {"c": 1}, "code": "1"}) in p.name)
    rows.withColumn("n", F.lit(2)).write.mode("overwrite").parquet(str(folder / "rows"))
    assert say(rows) == "built"
    with pytest.raises(ValueError):
        sinks.canonical_json({"x": float("nan")})
    sinks.write_json(spark, {"b": [1, 2], "a": "é"}, str(tmp_path / "doc"))
    assert sinks.read_json(spark, str(tmp_path / "doc")) == {"a": "é", "b": [1, 2]}
    with pytest.raises(GateError):
        sinks.write_union_csv([rows.limit(0)], str(tmp_path / "none"))


def test_bundles_and_trees(spark):
    import hashlib

    sha = lambda c: hashlib.sha256(c).hexdigest()
    files = contents(spark, ("a", b"1"), ("b", b"2"), ("b", b"2"), ("../c", b"3"), ("d", b"4"))
    manifest = spark.createDataFrame([("a", 1, sha(b"1").upper()), ("b", 1, sha(b"2")), ("../c", 1, sha(b"3")), ("e", 1, "")], "path string, bytes long, sha256 string")
    assert {r.path: r.fault for r in sinks.verify_bundle(files, manifest).collect()} == {"b": "repeated", "../c": "unsafe path", "d": "unexpected", "e": "missing"}
    one = spark.createDataFrame([(1, '{"a": [1, 2.0], "b": null, "c": true}')], "k int, t string")
    two = spark.createDataFrame([(1, '{"a": [1, 2.00000000001], "b": 0, "d": true}')], "k int, t string")
    got = {(r.path, r.fault) for r in integrity.tree_differences(one, two, "k", "t").collect()}
    assert got == {("$.b", "kind"), ("$.c", "missing"), ("$.d", "unexpected")}


def test_stream_keeps_the_first_frame(spark, tmp_path):
    folder = tmp_path / "in"
    rows = [[("a", 0, [0.0, 0.0]), ("a", 1, [3.0, 4.0]), ("b", 5, None)], [("a", 2, [0.0, 2.0]), ("b", 6, [1.0, 1.0])], [("b", 7, [1.0, 3.0]), ("a", 3, [0.0, 0.0])]]
    schema = "k string, t int, v array<double>"
    for part in rows:  # one batch a file, in order
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    got = {(r.k, r.t): r.rmsd for r in S.drained(S.change_from_first(stream, "k", "t", "v"), "test-stream").collect()}
    first = {"a": np.zeros(2), "b": np.ones(2)}
    want = {(k, t): None if v is None else float(np.sqrt(np.mean((np.array(v) - first[k]) ** 2))) for part in rows for k, t, v in part}
    assert got == want

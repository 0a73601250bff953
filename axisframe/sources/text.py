"""Text sources: CSV, mmCIF loops, PDB columns and frames, and scattering curves.

Readers of whole files take a frame (path, text), one row a file, as ``files`` gives it; a file is one task's work.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from axisframe.operators.gates import GateError, require_columns, require_unique
from axisframe.store import written

_TOKEN = re.compile(r"'(.*?)'(?=\s|$)|\"(.*?)\"(?=\s|$)|(\S+)")


def read_csv(spark: SparkSession, path: str, schema: str | None = None, *, required: list[str] = (), finite: list[str] = ()) -> DataFrame:
    """A CSV table with a header, plain or gzipped; without a schema all columns are text and empty cells stay empty.

    Columns of a schema are matched by the header's order and names. Missing required columns and values of
    ``finite`` columns that are null or NaN are errors.
    """
    reader = spark.read.option("header", True).option("enforceSchema", False)
    frame = reader.schema(schema).csv(path) if schema else reader.csv(path).na.fill("")
    return require_columns(frame, list(required), list(finite))


def read_keyed(spark: SparkSession, path: str, key: str, schema: str | None = None) -> DataFrame:
    """A CSV table whose key is trimmed and upper-cased; a blank or repeated key is an error."""
    return require_unique(read_csv(spark, path, schema, required=[key]).withColumn(key, F.upper(F.trim(key))), [key])


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def loop_rows(text: str, category: str) -> list[dict[str, str]]:
    """The rows of a category's loop; none if the text has no such loop. An incomplete row is an error."""
    lines = iter(text.splitlines())
    names: list[str] = []
    held: list[str] = []
    rows: list[dict[str, str]] = []
    for line in lines:
        bare = line.strip()
        if not names:
            if bare != "loop_":
                continue
            for line in lines:
                bare = line.strip()
                if not bare.startswith(f"_{category}."):
                    break
                names.append(bare.split(".", 1)[1])
            if not names:
                continue
        if not bare or bare[0] == "#" or bare == "loop_" or (bare[0] == "_" and not held):
            break
        if line[0] == ";":
            raise ValueError(f"a {category} row has a text field of several lines")
        held += [a or b or c for a, b, c in _TOKEN.findall(line)]
        while len(held) >= len(names):
            rows.append(dict(zip(names, held)))
            held = held[len(names) :]
    if held:
        raise ValueError(f"incomplete {category} row of {len(held)} values")
    return rows


def mmcif_loop(texts: DataFrame, category: str) -> DataFrame:
    """(path, row from 0, fields map) of a category's loop in each (path, text)."""

    def run(batches):
        for pdf in batches:
            out = [(p, i, row) for p, t in zip(pdf["path"], pdf["text"], strict=True) for i, row in enumerate(loop_rows(t or "", category))]
            yield pd.DataFrame(out, columns=["path", "row", "fields"])

    return texts.select("path", "text").mapInPandas(run, "path string, row int, fields map<string,string>")


def alpha_carbons(texts: DataFrame, atom: str = "CA") -> DataFrame:
    """(path, chain, resnum, x, y, z, occupancy, n_alternates): the first ATOM of that name of each residue."""
    f = lambda *names: F.coalesce(*[F.nullif(F.nullif(F.try_element_at("fields", F.lit(n)), F.lit(".")), F.lit("?")) for n in names])
    rows = mmcif_loop(texts, "atom_site").where((f("group_PDB") == "ATOM") & (f("label_atom_id", "auth_atom_id") == atom))
    rows = rows.select("path", "row", f("auth_asym_id", "label_asym_id").alias("chain"), f("auth_seq_id", "label_seq_id").try_cast("int").alias("resnum"), *[f(f"Cartn_{c}").try_cast("double").alias(c) for c in "xyz"], f("occupancy").try_cast("double").alias("occupancy"), f("label_alt_id").alias("alt"))
    first = F.min_by(F.struct("x", "y", "z", "occupancy"), "row").alias("a")
    return rows.groupBy("path", "chain", "resnum").agg(first, F.count("alt").alias("n_alternates")).select("path", "chain", "resnum", "a.*", "n_alternates")


def range_groups(texts: DataFrame, accession: str, longest: int | None = None) -> DataFrame:
    """(path, strands, ranges): an accession's mapped intervals by the set of chains that carry them, never joined across.

    Rows without a chain stand alone. Intervals out of order or beyond ``longest`` are an error.
    """
    f = lambda n: F.try_element_at("fields", F.lit(n))
    rows = mmcif_loop(texts, "struct_ref_seq").where(F.upper(f("pdbx_db_accession")) == accession.upper())
    rows = rows.select("path", "row", f("db_align_beg").try_cast("int").alias("beg"), f("db_align_end").try_cast("int").alias("end"), F.trim(F.coalesce(f("pdbx_strand_id"), F.lit(""))).alias("strand"))
    rows = written(rows, "ranges")  # texts are parsed once, not again for the check
    bad = ~F.coalesce((F.col("beg") >= 1) & (F.col("end") >= F.col("beg")) & (F.col("end") <= (longest or 2**31 - 1)), F.lit(False))
    wrong = rows.where(bad)
    if not wrong.isEmpty():
        raise GateError(f"invalid interval: {tuple(wrong.first())}")
    chains = F.array_join(F.array_sort(F.transform(F.split("strand", ","), lambda x: F.trim(x))), ",")
    name = F.when(F.col("strand").isin("", ".", "?"), F.concat(F.lit("row "), F.col("row").cast("string"))).otherwise(chains)
    return rows.groupBy("path", name.alias("strands")).agg(F.array_sort(F.collect_set(F.struct("beg", "end"))).alias("ranges"))


def lines_of(texts: DataFrame) -> DataFrame:
    """(path, line_no from 0, line)."""
    return texts.select("path", F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "line"))


def pdb_atoms(texts: DataFrame, *, atom: str | None = None, chain: str | None = None) -> DataFrame:
    """(path, frame, line_no, name, resname, chain, resnum, x, y, z) by fixed columns; MODEL lines open frames from 1.

    Lines before the first MODEL, or in a file without any, are frame 0.
    """
    inside = Window.partitionBy("path").orderBy("line_no")
    lines = lines_of(texts).withColumn("frame", F.sum(F.col("line").startswith("MODEL ").cast("int")).over(inside).cast("int"))
    cut = lambda a, n: F.trim(F.substring("line", a, n))
    atoms = lines.where(F.substring("line", 1, 6).isin("ATOM  ", "HETATM"))
    atoms = atoms.select("path", "frame", "line_no", cut(13, 4).alias("name"), cut(18, 3).alias("resname"), cut(22, 1).alias("chain"), cut(23, 4).try_cast("int").alias("resnum"), *[cut(a, 8).try_cast("double").alias(c) for a, c in ((31, "x"), (39, "y"), (47, "z"))])
    if atom is not None:
        atoms = atoms.where(F.col("name") == atom)
    return atoms if chain is None else atoms.where(F.col("chain") == chain)


def scattering_points(texts: DataFrame) -> DataFrame:
    """(path, line_no, q, intensity, sigma): lines that start with three finite numbers; q or sigma up to 0 is an error."""
    parts = F.split(F.trim("line"), r"\s+")
    number = lambda i: F.get(parts, i).try_cast("double")
    points = lines_of(texts).select("path", "line_no", number(0).alias("q"), number(1).alias("intensity"), number(2).alias("sigma"))
    ok = F.lit(True)
    for c in ("q", "intensity", "sigma"):
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    checked = F.when((F.col("q") <= 0) | (F.col("sigma") <= 0), F.raise_error(F.concat(F.lit("q and sigma must be positive: "), "path"))).otherwise(F.col("q"))
    return points.where(ok).withColumn("q", checked.cast("double"))


def scattering_headers(texts: DataFrame) -> DataFrame:
    """(path, line_no, line): lines whose first three fields are not all numbers."""
    parts = F.split(F.trim("line"), r"\s+")
    return lines_of(texts).where((F.trim("line") != "") & F.exists(F.slice(parts, 1, 3), lambda x: x.try_cast("double").isNull())).select("path", "line_no", F.trim("line").alias("line"))


def unit_evidence(headers: DataFrame) -> DataFrame:
    """(path, unit, evidence): what header lines say of q's unit; ``unstated`` or ``conflicting`` where they don't tell."""
    low = F.lower("line")
    nm = low.rlike(r"1/nm|nm\^?-1|nm-1|inverse nanomet")
    angstrom = low.rlike(r"1/a\b|1/å|a\^-1|å-1|angstrom|inverse ang")
    per = headers.groupBy("path").agg(F.bool_or(nm).alias("nm"), F.bool_or(angstrom).alias("a"), F.array_join(F.sort_array(F.collect_set(F.when(nm | angstrom, F.col("line")))), "; ").alias("evidence"))
    unit = F.when(F.col("nm") & F.col("a"), "conflicting").when(F.col("nm"), "1/nm").when(F.col("a"), "1/angstrom").otherwise("unstated")
    return per.select("path", unit.alias("unit"), "evidence")


def header_json(headers: DataFrame, schema: str) -> DataFrame:
    """(path, value): the first JSON object in a header line, by a given schema."""
    found = headers.withColumn("j", F.regexp_extract("line", r"(\{.*\})", 1)).where("j <> ''")
    return found.groupBy("path").agg(F.min_by("j", "line_no").alias("j")).select("path", F.from_json("j", schema).alias("value"))


def mutations(texts: DataFrame) -> DataFrame:
    """(path, mutations): sorted distinct symbols such as W386A in a text."""
    letters = "ACDEFGHIKLMNPQRSTVWY"
    return texts.select("path", F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(rf"\b([{letters}][1-9]\d{{0,3}}[{letters}])\b"), 1))).alias("mutations"))


#: What a table's title says of its assay: the first line with a word that the lower-cased title has. Fixed values.
ASSAYS = (
    ("binding_spr", ("spr",)),
    ("binding_itc", ("itc",)),
    ("folding_dsf", ("dsf", "thermal")),
    ("saxs", ("saxs", "scattering")),
    ("mutation_construct_qc", ("lc-ms", "mutant", "mutagenesis")),
    ("structure_statistics", ("cryo-em", "crystallographic")),
)


def table_titles(texts: DataFrame, assays: tuple[tuple[str, tuple[str, ...]], ...] = ASSAYS) -> DataFrame:
    """(path, table_id, title, assay_type, line_no): lines that open with "Table S" and a number, the first of each id.

    ``line_no`` is from 0; a title that no word fits has an empty assay type.
    """
    titles = lines_of(texts).select("path", "line_no", F.regexp_extract(F.trim("line"), r"^Table S\d+\.?\s+.*", 0).alias("title")).where("title <> ''")
    first = titles.withColumn("table_id", F.regexp_extract("title", r"^Table (S\d+)", 1)).groupBy("path", "table_id").agg(F.min_by("title", "line_no").alias("title"), F.min("line_no").alias("line_no"))
    low, kind = F.lower("title"), None
    for name, words in assays:
        has = F.lit(False)
        for word in words:
            has = has | low.contains(word)
        kind = F.when(has, name) if kind is None else kind.when(has, name)
    return first.select("path", "table_id", "title", kind.otherwise("").alias("assay_type"), "line_no")

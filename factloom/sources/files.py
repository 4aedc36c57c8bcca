"""Files as tables: documents, listings, ledgers, port graphs; and what is written back.

All reads go through Spark's readers, so any store that Spark knows will do. A file that
can't be decoded gives a row with its error; a job never fails for one file.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.parsing import key_values

# Format of a document by its extension, and folders that are not walked.
FORMATS = {
    ".txt": "text",
    ".md": "text",
    ".markdown": "text",
    ".json": "json",
    ".py": "code:python",
    ".pyi": "code:python",
    ".cpp": "code:cpp",
    ".cc": "code:cpp",
    ".cxx": "code:cpp",
    ".hpp": "code:cpp",
    ".hh": "code:cpp",
    ".c": "code:c",
    ".h": "code:c",
    ".pdf": "pdf",
}
IGNORED = [".git", "__pycache__", ".venv", "venv", "node_modules", "build_artifacts"]


def _suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def _binary(spark: SparkSession, folder: str, glob: str | None) -> DataFrame | None:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return reader.load(folder)


def listing(spark: SparkSession, folder: str, glob: str | None = None) -> DataFrame:
    """(path, relative, extension, size), hidden and ignored folders left out; empty for a missing folder."""
    rows = _binary(spark, folder, glob)
    if rows is None:
        return spark.createDataFrame([], "path string, relative string, extension string, size long")
    root = re.sub("^[a-z]+:/*", "/", folder).rstrip("/") + "/"
    relative = F.substring_index("path", root, -1)
    out = rows.select("path", relative.alias("relative"), _suffix(F.col("path")).alias("extension"), F.col("length").alias("size"))
    skipped = reduce(lambda a, b: a | b, [F.contains(F.concat(F.lit("/"), F.col("relative")), F.lit(f"/{d}/")) for d in IGNORED])
    return out.where(~skipped & ~F.concat(F.lit("/"), F.col("relative")).rlike(r"/\."))


def workspace_bytes(files: DataFrame, skipped: tuple[str, ...] = (".git", "__pycache__")) -> DataFrame:
    """Total size of the Python files of a listing (path, extension, size), some folders left out."""
    out = reduce(lambda a, b: a | b, [F.contains("path", F.lit(f"/{d}/")) for d in skipped])
    return files.where(~out & (F.col("extension") == ".py")).agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


# Streams with their dictionary, operators that show text, and escapes of literal strings.
_PDF_STREAM = re.compile(rb"<<(.*?)>>\s*stream\r?\n(.*?)\r?\nendstream", re.S)
_PDF_SHOW = re.compile(rb"\((.*?)\)\s*Tj", re.S)
_PDF_LIST = re.compile(rb"\[(.*?)\]\s*TJ", re.S)
_PDF_PART = re.compile(rb"\((.*?)\)")
_PDF_ESCAPE = re.compile(rb"\\(?:([0-7]{1,3})|([nrt()\\])|)", re.S)
_PDF_SIGNS = {b"n": b"\n", b"r": b"\r", b"t": b"\t"}


def pdf_literal(raw: bytes) -> str:
    """A literal string's text: signs and octal numbers for what is escaped; other backslashes go."""

    def one(m: re.Match) -> bytes:
        octal, sign = m.groups()
        return bytes([int(octal, 8) & 255]) if octal else _PDF_SIGNS.get(sign, sign or b"")

    return _PDF_ESCAPE.sub(one, raw).decode("latin-1")


def pdf_text(data: bytes) -> str:
    """Shown strings of a PDF's streams, single ones before those of lists; a stream that can't be inflated is skipped."""
    out: list[str] = []
    for about, body in _PDF_STREAM.findall(data):
        if b"FlateDecode" in about:
            try:
                body = zlib.decompress(body)
            except zlib.error:
                continue
        shown = _PDF_SHOW.findall(body) + [part for several in _PDF_LIST.findall(body) for part in _PDF_PART.findall(several)]
        out += [*map(pdf_literal, shown), "\n"]
    return " ".join(out)


def _decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts, errors = [], []
        for form, data in zip(batch["format"], batch["content"], strict=True):
            try:
                text, error = (pdf_text(data) if form == "pdf" else data.decode("utf-8", "ignore")), None
            except Exception as e:  # noqa: BLE001  a row's error, not the job's
                text, error = "", str(e)
            texts.append(text)
            errors.append(error)
        yield pd.DataFrame({"path": batch["path"], "format": batch["format"], "text": texts, "error": errors})


def documents(spark: SparkSession, folder: str, glob: str | None = None) -> DataFrame:
    """(path, format, text, error) of files with a known extension."""
    rows = _binary(spark, folder, glob)
    if rows is None:
        return spark.createDataFrame([], "path string, format string, text string, error string")
    known = F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv])
    skipped = reduce(lambda a, b: a | b, [F.contains("path", F.lit(f"/{d}/")) for d in IGNORED])
    typed = rows.where(~skipped).select("path", F.try_element_at(known, _suffix(F.col("path"))).alias("format"), "content").where("format is not null")
    return typed.mapInPandas(_decoded, "path string, format string, text string, error string")


# Patterns of a language's files, where a source names none.
LANGUAGE_GLOBS = {"python": ["**/*.py"], "rust": ["**/*.rs"], "c": ["**/*.c", "**/*.h"], "cpp": ["**/*.cpp", "**/*.hpp", "**/*.cc"]}


def glob_pattern(glob: str) -> str:
    """A regular expression for a relative path: ``**/`` is any folders or none, ``*`` and ``?`` stay in one name."""
    parts = re.split(r"(\*\*/|\*\*|\*|\?)", glob)
    known = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(known.get(p) or re.escape(p) for p in parts) + "$"


def ingested(spark: SparkSession, sources: list[dict]) -> tuple[DataFrame, DataFrame]:
    """(files, report) of context sources.

    A source has ``path``, and may have ``language``, ``include`` and ``exclude`` (patterns of
    relative paths; an excluded pattern without a folder holds for names), ``purpose`` and ``target_mapping``.
    ``files`` is (source, path, relative, destination, language, size), a file once for each source;
    ``report`` is (source, purpose, files_ingested, bytes, error), a missing folder being an error.
    """
    found, told = None, []
    for source in sources:
        path, language = source["path"].rstrip("/"), str(source.get("language", "python")).lower()
        name = path.rpartition("/")[2]
        told.append((path, source.get("purpose", ""), None if _binary(spark, path, None) is not None else f"context source not found: {path}"))
        rows = listing(spark, path)
        wanted = source.get("include") or LANGUAGE_GLOBS.get(language, ["**/*"])
        keep = reduce(lambda a, b: a | b, [F.col("relative").rlike(glob_pattern(g)) for g in wanted])
        for g in source.get("exclude") or []:
            keep = keep & ~F.col("relative").rlike(glob_pattern(g if "/" in g else f"**/{g}"))
        target = source.get("target_mapping", f"imported/{name}")
        own = rows.where(keep).select(F.lit(path).alias("source"), "path", "relative", F.concat(F.lit(f"{target}/"), F.col("relative")).alias("destination"), F.lit(language).alias("language"), "size")
        found = own if found is None else found.unionByName(own)
    told_ = spark.createDataFrame(told, "source string, purpose string, error string")
    if found is None:
        found = spark.createDataFrame([], "source string, path string, relative string, destination string, language string, size long")
    counts = found.groupBy("source").agg(F.count("*").alias("files_ingested"), F.sum("size").alias("bytes"))
    report = told_.join(counts, "source", "left").select("source", "purpose", F.coalesce("files_ingested", F.lit(0)).alias("files_ingested"), F.coalesce("bytes", F.lit(0)).alias("bytes"), "error")
    return found, report


def scanned(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size, fingerprint, fields): 16 digits of the content's hash and its KEY=VALUE lines."""
    rows = _binary(spark, folder, None)
    if rows is None:
        return spark.createDataFrame([], "path string, size long, fingerprint string, fields map<string,string>")
    text = F.decode("content", "UTF-8")
    return rows.select("path", F.col("length").alias("size"), F.substring(F.sha2("content", 256), 1, 16).alias("fingerprint"), key_values(text).alias("fields"))


def ledger_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Blocks of a ledger: JSON lines, a list, or an object with a chain; lines that don't parse are skipped."""
    lines = spark.read.text(path).where(F.ltrim("value").startswith("{")).select(F.from_json("value", schema).alias("b"))
    keys = [f.name for f in lines.schema["b"].dataType.fields]
    lines = lines.where(F.coalesce(*[F.col(f"b.{k}").cast("string") for k in keys]).isNotNull()).select("b.*")
    if not lines.isEmpty():
        return lines
    # No line is a block: the file is one document.
    text = spark.read.text(path, wholetext=True)
    whole = text.select(F.coalesce(F.from_json("value", f"struct<chain:array<{schema}>>")["chain"], F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<{schema}>"))).alias("blocks"))
    return whole.where("blocks is not null and not forall(blocks, b -> b is null)").select(F.inline("blocks"))


def record_replay(spark: SparkSession, path: str, new: DataFrame, size: int = 200) -> None:
    """Adds trajectories to a replay ledger (a folder of JSON lines), of which the best ``size`` by result stay.

    The new ledger is written beside the old one and takes its place by renaming, so a reader
    sees one of both, and a job that fails leaves the old one. One writer at a time.
    """
    from ..operators.similarity import bounded

    jvm = spark._jvm
    here, aside, old = (jvm.org.apache.hadoop.fs.Path(path + end) for end in ("", "._next", "._old"))
    fs = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(here) and fs.exists(old):  # a writer ended between its two renames
        fs.rename(old, here)
    rows = new
    if fs.exists(here):
        kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new.schema.fields)
        rows = spark.read.schema(kind).json(path).unionByName(new)
    bounded(rows, size).write.mode("overwrite").json(path + "._next")
    fs.delete(old, True)
    if fs.exists(here):
        fs.rename(here, old)
    fs.rename(aside, here)
    fs.delete(old, True)


def write_port_graph(nodes: DataFrame, wires: DataFrame, path: str, version: str = "1") -> None:
    """A port graph as a folder of JSON lines, a node with its ports each, that ``port_graph`` reads.

    ``nodes`` is (node_id, cls, value), ``wires`` (src, port, dst, dst_port).
    """
    port = F.struct(F.col("port").alias("name"), F.col("dst").alias("target_node"), F.col("dst_port").alias("target_port"))
    ports = wires.groupBy(F.col("src").alias("node_id")).agg(F.array_sort(F.collect_list(port)).alias("ports"))  # a node's ports
    none = F.array().cast(ports.schema["ports"].dataType)
    node = F.struct("node_id", F.col("cls").alias("class"), "value", F.coalesce("ports", none).alias("ports"))
    nodes.join(ports, "node_id", "left").select(F.lit(version).alias("version"), F.array(node).alias("nodes")).write.mode("overwrite").json(path)


def write_json(df: DataFrame, path: str, one_file: bool = False) -> None:
    """JSON lines; in one file for a small report."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").json(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A folder with nodes and edges as JSON lines, each value that JSON lacks as text."""
    for name, df in (("nodes", nodes), ("edges", edges)):
        plain = df.select(*[F.col(c).cast("string").alias(c) if t.startswith(("decimal", "binary", "interval")) else F.col(c) for c, t in df.dtypes])
        plain.write.mode("overwrite").json(f"{path}/{name}")


def write_generation(population: DataFrame, generation: int, path: str) -> None:
    """Appends a generation's snapshot; writing one again replaces it."""
    population.withColumn("generation", F.lit(generation)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("generation").parquet(path)


def port_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, wires) of a JSON file, or a folder of JSON lines, with nodes and their ports' targets; wires lead to known nodes only."""
    shape = "version string, nodes array<struct<node_id:bigint,class:string,value:string,ports:array<struct<name:string,target_node:bigint,target_port:string>>>>"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isFile()
    rows = spark.read.schema(shape).option("multiLine", str(whole).lower()).json(path).select(F.explode("nodes").alias("n")).select("n.*")
    nodes = rows.select("node_id", F.col("class").alias("cls"), "value")
    wires = rows.select(F.col("node_id").alias("src"), F.explode("ports").alias("p")).select("src", F.col("p.name").alias("port"), F.col("p.target_node").alias("dst"), F.col("p.target_port").alias("dst_port"))
    return nodes, wires.join(nodes.select(F.col("node_id").alias("dst")), "dst").select("src", "port", "dst", "dst_port")

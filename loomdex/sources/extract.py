"""Source files to tables: one distributed pass reads and extracts, the rest are projections of its nested rows."""

from __future__ import annotations

import hashlib
import os
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.functions import text
from loomdex.runtime import dealt, ship
from loomdex.sources import golang, python, script

READERS = {"python": python.extract, "go": golang.extract, "javascript": script.extract, "typescript": script.extract}
_SYMBOL = "struct<qualified_name:string,name:string,kind:string,signature:string,params:string,returns:string,docstring:string,line:int,end_line:int,bases:array<string>,body:string>"
SCHEMA = f"path string, language string, hash string, mtime double, size long, error string, symbols array<{_SYMBOL}>, imports array<struct<source:string,names:array<string>>>, calls array<struct<src_qname:string,callee_raw:string,line:int>>"
_S = pa.struct([("qualified_name", pa.string()), ("name", pa.string()), ("kind", pa.string()), ("signature", pa.string()), ("params", pa.string()), ("returns", pa.string()), ("docstring", pa.string()), ("line", pa.int32()), ("end_line", pa.int32()), ("bases", pa.list_(pa.string())), ("body", pa.string())])
_ARROW = pa.schema([("path", pa.string()), ("language", pa.string()), ("hash", pa.string()), ("mtime", pa.float64()), ("size", pa.int64()), ("error", pa.string()), ("symbols", pa.list_(_S)), ("imports", pa.list_(pa.struct([("source", pa.string()), ("names", pa.list_(pa.string()))]))), ("calls", pa.list_(pa.struct([("src_qname", pa.string()), ("callee_raw", pa.string()), ("line", pa.int32())])))])


def record(path: str, content: bytes, mtime: float = 0.0) -> dict:
    """A file's row; a source that can't be read gives its error and nothing else."""
    language = text.LANGUAGES[Path(path).suffix.lower()]
    row = {"path": path, "language": language, "hash": hashlib.sha256(content).hexdigest(), "mtime": mtime, "size": len(content), "error": None, "symbols": [], "imports": [], "calls": []}
    try:
        found = READERS[language](path, content.decode("utf-8-sig", "replace"))
    except (SyntaxError, ValueError, RecursionError, IndexError, KeyError) as e:
        return row | {"error": f"{type(e).__name__}: {e}"}
    row["symbols"] = [vars(s) for s in found.symbols]
    row["imports"] = [{"source": s, "names": n} for s, n in found.imports]
    row["calls"] = [{"src_qname": a, "callee_raw": c, "line": n} for a, c, n in found.calls]
    return row


def extract_paths(spark: SparkSession, root: str, paths: list[str], partitions: int | None = None) -> DataFrame:
    """Read and extract files below ``root``, which executors must see; Spark's own file listing would leave out names that begin with ``_``."""
    ship(spark)
    rows = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), partitions or spark.sparkContext.defaultParallelism * 4)))

    def run(batches):
        for b in batches:
            out = []
            for p in b.column("path").to_pylist():
                try:
                    full = os.path.join(root, p)
                    with open(full, "rb") as f:
                        out.append(record(p, f.read(), os.stat(full).st_mtime))
                except OSError:
                    continue  # gone since it was listed
            yield pa.RecordBatch.from_pylist(out, _ARROW)

    return rows.mapInArrow(run, SCHEMA)


def extract_contents(contents: DataFrame) -> DataFrame:
    """Extract from rows of (path, content binary), wherever they were read from; other suffixes are left out.

    Parsing costs far more than reading, so rows are dealt to some tasks a core first: a table of small rows may be a single split.
    """
    ship(contents.sparkSession)
    known = dealt(contents.where(text.language_of(F.col("path")).isNotNull()).select("path", "content"), contents.sparkSession.sparkContext.defaultParallelism * 4, "path")

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pylist([record(p, c or b"") for p, c in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True)], _ARROW)

    return known.mapInArrow(run, SCHEMA)


def stamps(root: str, paths: list[str]) -> list[tuple[str, int, float]]:
    """Path, size and time of each file that is there."""
    out = []
    for p in paths:
        try:
            s = os.stat(os.path.join(root, p))
            out.append((p, s.st_size, s.st_mtime))
        except OSError:
            continue
    return out


def files_table(extracted: DataFrame, parsed_at) -> DataFrame:
    return extracted.select("path", "language", "hash", "mtime", "size", text.role_of(F.col("path")).alias("role"), F.lit(parsed_at).cast("timestamp").alias("parsed_at"))


def symbols_table(extracted: DataFrame, lang: str = "en", describe=None) -> DataFrame:
    """Symbols with role and description; of several with one name in a file the last stays. ``describe`` replaces the rule that words descriptions."""
    each = extracted.select(F.col("path").alias("file"), "language", F.posexplode("symbols").alias("seq", "s")).select("file", "language", "seq", "s.*")
    last = each.groupBy("file", "qualified_name").agg(F.max_by(F.struct(*[c for c in each.columns if c not in ("file", "qualified_name")]), "seq").alias("x")).select("file", "qualified_name", "x.*")
    said = (describe or text.description)(F.col("docstring"), F.col("kind"), F.col("name"), F.col("line"), F.col("returns"), lang)
    return last.select("file", "qualified_name", "name", "kind", "signature", "params", "returns", said.alias("description"), text.role_of(F.col("file")).alias("role"), "line", "end_line", "language", "bases", "body", "docstring", "seq")


def imports_table(extracted: DataFrame) -> DataFrame:
    return extracted.select(F.col("path").alias("file"), F.posexplode("imports").alias("seq", "i")).select("file", "i.source", "i.names", "seq")


def calls_table(extracted: DataFrame) -> DataFrame:
    each = extracted.select(F.col("path").alias("file"), F.posexplode("calls").alias("seq", "c")).select("file", "c.src_qname", "c.callee_raw", "c.line", "seq")
    return each.groupBy("file", "src_qname", "callee_raw", "line").agg(F.min("seq").alias("seq"))

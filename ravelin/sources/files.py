"""File ingest: a recursive scan, converters by extension, a manifest with incremental reuse, and pruning of vanished documents."""

from __future__ import annotations

import os
import shutil
import subprocess
import tempfile
from collections.abc import Callable
from functools import cache
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.functions.text import document_date, document_kind, document_title, html_to_markdown, passages_column

TEXT = frozenset({".md", ".markdown", ".txt"})
HTML = frozenset({".html", ".htm"})
OFFICE = frozenset("." + x for x in (
    "doc docx docm dot dotx odt ott fodt rtf wps pages xls xlsx xlsm xlsb xlt xltx ods ots fods csv tsv numbers "
    "ppt pptx pptm pps ppsx pot potx odp otp fodp key odg vsd vsdx pub"
).split())

#: A converter takes (path, bytes) and gives Markdown, or None when it can't.
Converter = Callable[[str, bytes], str | None]


_LISTED = "uri string, chemin_source string, mtime long, taille long"
_SCANNED = T.StructType([T.StructField("chemin_source", T.StringType()), T.StructField("nom", T.StringType()), T.StructField("extension", T.StringType()), T.StructField("mtime", T.LongType()), T.StructField("taille", T.LongType()), T.StructField("contenu", T.BinaryType())])


def _open(root: str):
    """(file system, path in it) of a folder: a path of the machine or a URI that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


def _below(root: str, folder: str, recursive: bool) -> list[tuple[str, str, bool, int, int]]:
    """(path, path below the root, is it a folder?, seconds, size)"""
    from pyarrow import fs

    system, base = _open(root)
    base = base.rstrip("/")
    found = system.get_file_info(fs.FileSelector(f"{base}/{folder}" if folder else base, recursive=recursive))
    return [(f.path, f.path[len(base) :].lstrip("/"), f.type == fs.FileType.Directory, (f.mtime_ns or 0) // 10**9, f.size or 0) for f in found]


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """chemin_source, nom, extension, mtime (seconds), taille, contenu of every file below ``root``.

    Folders are entered whatever their names, hidden ones too, and empty files have a row. Only ``.DS_Store`` and file names that
    begin with a dot are left out. Order by ``chemin_source`` where order matters. The driver lists ``root`` itself, tasks
    list what is in its folders and read the files, so ``root`` must be reachable from every executor (a shared path, or a URI of
    a file system that pyarrow opens). A file that vanishes meanwhile has no row.
    """
    top = _below(root, "", False)
    folders = [(f[1],) for f in top if f[2]]
    here = [f for f in top if not f[2]]

    def listed(batches):
        for pdf in batches:
            rows = [f for folder in pdf["d"] for f in _below(root, folder, True) if not f[2]]
            yield pd.DataFrame([(r[0], r[1], r[3], r[4]) for r in rows], columns=["uri", "chemin_source", "mtime", "taille"])

    def read(batches):
        system, _ = _open(root)
        for pdf in batches:
            for lo in range(0, len(pdf), 64):
                rows = []
                for r in pdf.iloc[lo : lo + 64].itertuples(index=False):
                    try:
                        with system.open_input_stream(r.uri) as f:
                            data = f.read()
                    except FileNotFoundError:
                        continue
                    path = PurePosixPath(r.chemin_source)
                    rows.append((r.chemin_source, path.name, path.suffix.lower(), r.mtime, r.taille, data))
                yield pd.DataFrame(rows, columns=_SCANNED.names)

    files = spark.createDataFrame([(f[0], f[1], f[3], f[4]) for f in here], _LISTED)
    if folders:
        width = min(len(folders), 4 * spark.sparkContext.defaultParallelism)
        files = files.union(spark.createDataFrame(folders, "d string").repartition(width).mapInPandas(listed, _LISTED))
    shown = files.where(~F.startswith(F.element_at(F.split("chemin_source", "/"), -1), F.lit(".")))
    return shown.repartition(4 * spark.sparkContext.defaultParallelism, "chemin_source").mapInPandas(read, _SCANNED)


def plain_text(path: str, data: bytes) -> str:
    """UTF-8 with replacement signs."""
    return data.decode("utf-8", errors="replace")


def raw_text(path: str, data: bytes) -> str | None:
    """Text if it can be: a NUL among the first 4096 bytes says it is binary."""
    return None if b"\0" in data[:4096] else data.decode("utf-8", errors="replace")


def web_page(path: str, data: bytes) -> str:
    return html_to_markdown(data.decode("utf-8", errors="replace"))


def any_to_markdown(path: str, data: bytes) -> str | None:
    """With markitdown, where it is installed."""
    import io

    try:
        from markitdown import MarkItDown
    except ImportError:
        return None
    return MarkItDown().convert_stream(io.BytesIO(data), file_extension=PurePosixPath(path).suffix).text_content


def pdf_text(path: str, data: bytes) -> str | None:
    """With pdfminer, then pdfplumber, where one is installed."""
    import io

    try:
        from pdfminer.high_level import extract_text

        return extract_text(io.BytesIO(data))
    except ImportError:
        pass
    try:
        import pdfplumber

        with pdfplumber.open(io.BytesIO(data)) as pdf:
            return "\n\n".join(p.extract_text() or "" for p in pdf.pages)
    except ImportError:
        return None


_PROBE = r"{\rtf1\ansi probe\par}"


@cache
def office_command() -> str | None:
    """The office program of this machine that tells its version within 20 seconds and converts a sample within 60; asked once in a process."""
    for name in ("libreoffice", "soffice", "openoffice"):
        found = shutil.which(name)
        if not found:
            continue
        try:
            if subprocess.run([found, "--version"], capture_output=True, timeout=20).returncode:
                continue
            with tempfile.TemporaryDirectory() as work:  # scratch of the probe
                with open(f"{work}/probe.rtf", "w", encoding="ascii") as f:
                    f.write(_PROBE)
                subprocess.run([found, "--headless", "--convert-to", "html", "--outdir", work, f"{work}/probe.rtf"], capture_output=True, timeout=60, check=True)
                if os.path.exists(f"{work}/probe.html"):
                    return found
        except (OSError, subprocess.SubprocessError):
            continue
    return None


def office_document(path: str, data: bytes) -> str | None:
    """By the office program to HTML and on to Markdown; 300 seconds at most. Off unless it is registered."""
    program = office_command()
    if program is None:
        return None
    with tempfile.TemporaryDirectory() as work:  # scratch of one conversion, nothing is read from it later
        source = f"{work}/in{PurePosixPath(path).suffix}"
        with open(source, "wb") as f:
            f.write(data)
        subprocess.run([program, "--headless", "--convert-to", "html", "--outdir", work, source], capture_output=True, timeout=300, check=True)
        with open(f"{work}/in.html", encoding="utf-8", errors="replace") as f:
            return html_to_markdown(f.read())


def default_converters(office: bool = False) -> dict[str, list[Converter]]:
    """extension -> converters in the order to try; the key ``*`` serves all others."""
    out: dict[str, list[Converter]] = {e: [plain_text] for e in TEXT} | {e: [web_page, raw_text] for e in HTML}
    out |= {e: [*([office_document] if office else []), any_to_markdown, raw_text] for e in OFFICE}
    return out | {".pdf": [any_to_markdown, pdf_text, raw_text], "*": [any_to_markdown, raw_text]}


_CONVERTED = T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("markdown", T.StringType()), T.StructField("erreur", T.StringType())])


def convert(files: DataFrame, converters: dict[str, list[Converter]] | None = None) -> DataFrame:
    """Adds ok, markdown, erreur. A document that fails is an error of its own and never stops the others; an empty one isn't ok and has no error."""
    table = converters or default_converters()

    def one(path: str, extension: str, data: bytes) -> dict:
        last = "no converter could read it"
        for converter in table.get(extension) or table.get("*", []):
            try:
                text = converter(path, bytes(data))
            except Exception as e:  # one document's failure is reported in its row
                last = f"{type(e).__name__}: {e}"[:500]
                continue
            if text is not None:
                return {"ok": bool(text.strip()), "markdown": text, "erreur": None}
        return {"ok": False, "markdown": None, "erreur": last}

    @F.pandas_udf(_CONVERTED)
    def run(paths: pd.Series, extensions: pd.Series, contents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(*x) for x in zip(paths, extensions, contents, strict=True)], columns=["ok", "markdown", "erreur"])

    return files.withColumn("_c", run("chemin_source", "extension", "contenu")).select("*", "_c.*").drop("_c")


def document_id(path: Column) -> Column:
    return F.concat(F.lit("DOC-"), F.substring(F.sha1(path), 1, 10))


def manifest(files: DataFrame, limit: int = 2500) -> DataFrame:
    """One row for each file with its identity, fingerprint and the configuration that shaped its passages."""
    return files.select(
        document_id(F.col("chemin_source")).alias("doc_id"), "chemin_source", F.sha2("contenu", 256).alias("sha256"), "mtime", "taille", F.lit(f"max_chunk={limit}").alias("config"),
    )


def manifest_diff(now: DataFrame, before: DataFrame) -> DataFrame:
    """doc_id, etat: ``inchange`` (same time, size and configuration), ``identique`` (same bytes and configuration), ``modifie``, ``nouveau``, ``disparu``.

    Reuse also needs the same configuration: another passage size makes other passages.
    """
    a, b = now.alias("a"), before.alias("b")
    same_config = F.col("a.config").eqNullSafe(F.col("b.config"))
    state = (
        F.when(F.col("b.doc_id").isNull(), "nouveau").when(F.col("a.doc_id").isNull(), "disparu")
        .when(same_config & (F.col("a.mtime") == F.col("b.mtime")) & (F.col("a.taille") == F.col("b.taille")), "inchange")
        .when(same_config & (F.col("a.sha256") == F.col("b.sha256")), "identique").otherwise("modifie")
    )
    return a.join(b, F.col("a.doc_id") == F.col("b.doc_id"), "full").select(F.coalesce("a.doc_id", "b.doc_id").alias("doc_id"), state.alias("etat"))


def prune_orphans(artefacts: DataFrame, manifest_now: DataFrame) -> DataFrame:
    """Artefacts of documents that are still there."""
    return artefacts.join(manifest_now.select("doc_id"), "doc_id", "left_semi")


def documents_of(converted: DataFrame) -> DataFrame:
    """The documents table (with markdown) of the files that could be read."""
    stem = F.regexp_replace("nom", r"\.[^.]*$", "")
    return converted.where("ok").select(
        document_id(F.col("chemin_source")).alias("doc_id"), "chemin_source", document_title(F.col("markdown"), stem).alias("titre"),
        document_kind(F.col("nom"), F.col("markdown")).alias("type_document"), document_date(F.col("nom"), F.col("markdown")).alias("date_document"),
        F.sha2("contenu", 256).alias("sha256"), "mtime", "taille", "markdown",
    )


def chunks_of(documents: DataFrame, limit: int = 2500, small: int = 200, text: str = "markdown") -> DataFrame:
    """chunk_id, doc_id, ordre, chemin_titres, texte: passages numbered from 0. Order by ``ordre``: ids sort as text only below 1000."""
    cut = documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(passages_column(F.col(text), limit, small)).alias("ordre", "p"))
    return cut.select(F.format_string("%s#%03d", "doc_id", "ordre").alias("chunk_id"), "doc_id", "ordre", "p.chemin_titres", "p.texte")

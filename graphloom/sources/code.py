"""Sources: code trees, ranges of lines, keyed JSON, archives, and the symbols of Python files."""

from __future__ import annotations

import ast
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions of code files and folders that a walk leaves out (fixed values).
CODE = ("py", "js", "ts", "tsx", "jsx", "java", "go", "rs", "c", "h", "cpp", "hpp", "cs", "rb", "php", "scala", "kt", "swift", "sql", "sh", "md", "json", "yaml", "yml", "toml")
IGNORED = ("node_modules", ".git", "venv", ".venv", "__pycache__", "dist", "build", ".idea")


def code_tree(spark: SparkSession, root: str, extensions: tuple[str, ...] = CODE, most_bytes: int | None = None) -> DataFrame:
    """(path, content) of the code files below a folder, outside ignored folders; bad UTF-8 is replaced."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    good = F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*extensions) & ~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(x) for x in IGNORED]))
    raw = F.col("content") if most_bytes is None else F.substring("content", 1, most_bytes)
    return files.where(good).select("path", F.decode(raw, "UTF-8").alias("content"))


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header, quotes doubled and line feeds inside quotes."""
    return spark.read.schema(schema).options(header=True, quote='"', escape='"', multiLine=True).csv(path)


def keyed_json(spark: SparkSession, folder: str) -> DataFrame:
    """One JSON document a file, newest ``updated_at`` first."""
    return spark.read.option("multiLine", "true").json(folder).orderBy(F.desc("updated_at"))


def json_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a graph document {nodes: [...], edges: [...]}."""
    doc = spark.read.option("multiLine", "true").json(path)
    return doc.select(F.explode("nodes").alias("x")).select("x.*"), doc.select(F.explode("edges").alias("x")).select("x.*")


#: Bytes of unzipped files that are passed on together.
UNZIPPED = 4 << 20


def unzipped(archives: DataFrame) -> DataFrame:
    """(archive, path, content) of the files in zip archives (path, content), an archive a row."""
    names = ["archive", "path", "content"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, raw in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    held, size = [], 0
                    for i in z.infolist():
                        if i.is_dir():
                            continue
                        held.append((name, i.filename, z.read(i).decode("utf-8", "replace")))
                        size += i.file_size
                        if size >= UNZIPPED or len(held) >= 1000:
                            yield pd.DataFrame(held, columns=names)
                            held, size = [], 0
                    if held:
                        yield pd.DataFrame(held, columns=names)

    return archives.select("path", "content").mapInPandas(run, "archive string, path string, content string")


def archived(spark: SparkSession, path: str) -> DataFrame:
    """The files in the zip archives of a folder."""
    return unzipped(spark.read.format("binaryFile").load(path))


#: Files of an archive, about.
ARCHIVED = 4096


def zipped(files: DataFrame, name: Column, most: int = ARCHIVED) -> DataFrame:
    """(path, content): zip archives of files (path, content), those with one name in one archive.

    More than ``most`` files of a name are dealt out, by a hash of their paths,
    over archives of about that many, of the same name; no task gets all.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for p, c in zip(pdf["path"], pdf["content"], strict=True):
                z.writestr(p, c)
        return pd.DataFrame({"path": [pdf["name"].iloc[0]], "content": [out.getvalue()]})

    own = files.select(name.alias("name"), "path", "content")
    parts = own.groupBy(F.col("name").alias("_of")).agg(F.ceil(F.count("*") / most).alias("parts"))
    dealt = own.join(parts, F.col("name").eqNullSafe(F.col("_of"))).withColumn("part", F.pmod(F.xxhash64("path"), F.col("parts")))
    return dealt.select("name", "part", "path", "content").groupBy("name", "part").applyInPandas(run, "path string, content binary")


def _symbols(path: str, content: str) -> list[tuple]:
    try:
        tree = ast.parse(content or "")
    except (SyntaxError, ValueError):
        return []
    out = []

    def visit(node: ast.AST, owner: str) -> None:
        for x in ast.iter_child_nodes(node):
            if isinstance(x, ast.ClassDef):
                bases = [ast.unparse(b) for b in x.bases]
                out.append((path, "class", owner, x.name, x.lineno, x.end_lineno, bases, ast.get_docstring(x)))
                visit(x, f"{owner}.{x.name}".strip("."))
            elif isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef):
                out.append((path, "method" if owner else "function", owner, x.name, x.lineno, x.end_lineno, [a.arg for a in x.args.args], ast.get_docstring(x)))
                for c in ast.walk(x):
                    if isinstance(c, ast.Call):
                        out.append((path, "call", f"{owner}.{x.name}".strip("."), ast.unparse(c.func), c.lineno, c.end_lineno, [], None))
            elif isinstance(x, ast.Import | ast.ImportFrom):
                base = getattr(x, "module", None) or ""
                out.extend((path, "import", owner, f"{base}.{a.name}".strip("."), x.lineno, x.end_lineno, [], None) for a in x.names)

    visit(tree, "")
    return out


def python_symbols(files: DataFrame) -> DataFrame:
    """(path, kind, owner, name, line, end_line, details, docstring) of Python sources (path, content)."""
    names = ["path", "kind", "owner", "name", "line", "end_line", "details", "docstring"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for p, c in zip(pdf["path"], pdf["content"], strict=True) for r in _symbols(p, c)]
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, "path string, kind string, owner string, name string, line long, end_line long, details array<string>, docstring string")


def call_edges(symbols: DataFrame) -> DataFrame:
    """(caller, callee, confidence): calls resolved in their own file first, then to the only definition of the name."""
    defs = symbols.where(F.col("kind").isin("function", "method")).select("path", "name", F.concat_ws(".", F.nullif("owner", F.lit("")), "name").alias("target"))
    calls = symbols.where("kind = 'call'").select("path", F.col("owner").alias("caller"), F.element_at(F.split("name", r"\."), -1).alias("name"))
    near = calls.join(defs, ["path", "name"]).select("caller", F.col("target").alias("callee"), F.lit(0.85).alias("confidence"))
    away = calls.join(defs, ["path", "name"], "left_anti")
    every = defs.groupBy("name").agg(F.min("target").alias("callee"), F.count("*").alias("n"))
    far = away.join(every, "name").select("caller", "callee", F.when(F.col("n") == 1, 0.5).otherwise(0.3).alias("confidence"))
    return near.unionByName(far).distinct()

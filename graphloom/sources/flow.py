"""Names and flow inside the functions of Python sources (path, content), a file a row."""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

_FUNCTION = (ast.FunctionDef, ast.AsyncFunctionDef)


def _functions(content: str | None) -> Iterator[tuple[str, ast.AST]]:
    """Functions with the names of their classes; files that are no Python have none."""
    try:
        todo = [("", ast.parse(content or ""))]
    except (SyntaxError, ValueError):
        return
    while todo:
        owner, node = todo.pop()
        for x in ast.iter_child_nodes(node):
            name = f"{owner}.{getattr(x, 'name', '')}".strip(".")
            if isinstance(x, _FUNCTION):
                yield name, x
            if isinstance(x, (*_FUNCTION, ast.ClassDef)):
                todo.append((name, x))


def _names(node: ast.AST, kind: type) -> list[str]:
    return [x.id for x in ast.walk(node) if isinstance(x, ast.Name) and isinstance(x.ctx, kind)]


def _fields(node: ast.AST, kind: type) -> list[str]:
    return [x.attr for x in ast.walk(node) if isinstance(x, ast.Attribute) and isinstance(x.ctx, kind) and isinstance(x.value, ast.Name) and x.value.id == "self"]


def _statements(f: ast.AST) -> Iterator[tuple[str, str, str]]:
    yield from (("param", a.arg, "") for a in f.args.args)
    for x in ast.walk(f):
        if isinstance(x, ast.Assign):
            needs = _names(x.value, ast.Load) + [f"self.{a}" for a in _fields(x.value, ast.Load)]
            for target in x.targets:
                sets = _names(target, ast.Store) + [f"self.{a}" for a in _fields(target, ast.Store)]
                yield from (("needs", a, b) for a in sets for b in needs)
        elif isinstance(x, ast.Return):
            yield "return", "", ""
    for body in f.body:
        yield from (("def", a, "") for a in _names(body, ast.Store))
        yield from (("use", a, "") for a in _names(body, ast.Load))
        yield from (("write", a, "") for a in _fields(body, ast.Store))
        yield from (("read", a, "") for a in _fields(body, ast.Load))


def _control(body: list[ast.stmt], then: int | None) -> Iterator[tuple[int, int, str]]:
    """Edges between statements; ``then`` is the line that follows the block."""
    for i, x in enumerate(body):
        after = body[i + 1].lineno if i + 1 < len(body) else then
        if isinstance(x, ast.If | ast.For | ast.While):
            back = after if isinstance(x, ast.If) else x.lineno
            yield x.lineno, x.body[0].lineno, "true"
            yield from _control(x.body, back)
            if x.orelse:
                yield x.lineno, x.orelse[0].lineno, "false"
                yield from _control(x.orelse, after)
            elif after is not None:
                yield x.lineno, after, "false"
        elif after is not None and not isinstance(x, ast.Return | ast.Raise):
            yield x.lineno, after, "next"


def _data(f: ast.AST) -> Iterator[tuple[str, int, int]]:
    """(name, line that set it last, line of use), in the order of lines."""
    last = {a.arg: f.lineno for a in f.args.args if a.arg != "self"}
    for x in sorted((x for x in ast.walk(f) if isinstance(x, ast.Name)), key=lambda x: (x.lineno, isinstance(x.ctx, ast.Store))):
        if isinstance(x.ctx, ast.Store):
            last[x.id] = x.lineno
        elif x.id in last:
            yield x.id, last[x.id], x.lineno


def _each(files: DataFrame, found: Callable, schema: str) -> DataFrame:
    """The rows that ``found`` makes of every function, after its path and name."""
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(p, name, *r) for p, c in zip(pdf["path"], pdf["content"], strict=True) for name, f in _functions(c) for r in found(f)], columns=columns)

    return files.select("path", "content").mapInPandas(run, schema)


def statements(files: DataFrame) -> DataFrame:
    """(path, method, kind, name, other): params, defs, uses, fields read and written, what variables need, returns."""
    return _each(files, _statements, "path string, method string, kind string, name string, other string")


def control(files: DataFrame) -> DataFrame:
    """(path, method, line, next, kind)."""
    return _each(files, lambda f: _control(f.body, None), "path string, method string, line long, next long, kind string")


def data(files: DataFrame) -> DataFrame:
    """(path, method, name, line, used)."""
    return _each(files, _data, "path string, method string, name string, line long, used long").distinct()

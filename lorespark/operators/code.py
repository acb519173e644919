"""Symbols, imports, calls, bases and decorators of source text.

Python is parsed by its own grammar; languages with braces by an island grammar (``islands``), as no full one is at hand.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids
from . import islands

def python_facts(body: str) -> list[tuple]:
    """(kind, name, qualified_name, owner, line) of entities, and of imports, calls, bases and decorators under their owner."""
    out: list[tuple] = []

    def dotted(e: ast.AST) -> str:
        return dotted(e.value) + "." + e.attr if isinstance(e, ast.Attribute) else e.id if isinstance(e, ast.Name) else ""

    def visit(node: ast.AST, owner: str, in_class: bool) -> None:
        for c in ast.iter_child_nodes(node):
            if isinstance(c, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                q = f"{owner}.{c.name}" if owner else c.name
                is_class = isinstance(c, ast.ClassDef)
                out.append(("class" if is_class else "method" if in_class else "function", c.name, q, owner, c.lineno))
                out.extend(("decorator", dotted(d.func if isinstance(d, ast.Call) else d), ast.unparse(d), q, d.lineno) for d in c.decorator_list)
                if is_class:
                    out.extend(("base", dotted(b), dotted(b), q, b.lineno) for b in c.bases if dotted(b))
                visit(c, q, is_class)
                continue
            if isinstance(c, ast.Import):
                out.extend(("import", a.name, a.name, owner, c.lineno) for a in c.names)
            elif isinstance(c, ast.ImportFrom):
                out.extend(("import", a.name, f"{'.' * c.level}{c.module or ''}.{a.name}", owner, c.lineno) for a in c.names)
            elif isinstance(c, ast.Call) and (name := dotted(c.func)):
                out.append(("call", name.rsplit(".", 1)[-1], name, owner, c.lineno))
            visit(c, owner, in_class)

    visit(ast.parse(body), "", False)
    return out


def facts(body: str, language: str) -> list[tuple]:
    """Python's facts by its own grammar, other languages' by ``islands``; text that doesn't parse gives one fact of kind ``error``, another language none."""
    if language != "python":
        return islands.facts(body, language) if language in islands.LANGUAGES else []
    try:
        return python_facts(body)
    except (SyntaxError, ValueError, RecursionError) as e:
        return [("error", type(e).__name__, str(e)[:200], "", 0)]


#: Kinds of facts that declare a symbol.
DECLARATIONS = ("class", "function", "method", "struct", "interface", "enum", "namespace", "property", "field")


def entities(found: DataFrame, key: str) -> DataFrame:
    """(key, id, kind, name, qualified_name, owner, line, ordinal) of the declarations among extracted facts; overloads of one kind and qualified name in a file are counted from 0 in line order, and the count is part of the id."""
    w = Window.partitionBy(key, "kind", "qualified_name").orderBy("line")
    counted = found.where(F.col("kind").isin(*DECLARATIONS)).withColumn("ordinal", F.row_number().over(w) - 1)
    return counted.select(key, ids.entity_id(F.col(key), F.col("kind"), F.col("qualified_name"), F.col("ordinal")).alias("id"), "kind", "name", "qualified_name", "owner", "line", "ordinal")


def extract(files: DataFrame, key: str, language: str, body: str) -> DataFrame:
    """(key, kind, name, qualified_name, owner, line) of every fact of every file; source that doesn't parse gives one of kind ``error``."""
    key_type = files.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, *f) for k, l, t in zip(b[key], b[language], b[body], strict=True) for f in facts(t or "", l or "")]
            yield pd.DataFrame(rows, columns=[key, "kind", "name", "qualified_name", "owner", "line"])

    return files.select(key, language, body).mapInPandas(run, f"`{key}` {key_type}, kind string, name string, qualified_name string, owner string, line int")

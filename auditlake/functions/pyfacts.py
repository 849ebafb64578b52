"""Syntax facts of Python sources, computed in Arrow workers.

The worker only reports facts; every judgement on them is a column expression.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

FACTS_TYPE = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("line", T.IntegerType()),
            T.StructField("end_line", T.IntegerType()),
            T.StructField("name", T.StringType()),
            T.StructField("mutable_defaults", T.IntegerType()),
            T.StructField("walk_ordinal", T.IntegerType()),
            T.StructField("text", T.StringType()),
        ]
    )
)


# Where the parser ends a line.
_PARSER_LINE_END = re.compile(r"\r\n?|\n")
# Fields that hold statements, handlers or cases, in the order a node lists them.
_BLOCKS = ("body", "handlers", "orelse", "finalbody", "cases")


def _statements(tree: ast.Module) -> Iterator[ast.AST]:
    """Statements breadth-first.  Expressions hold none, so skipping them leaves the order as it is."""
    queue = deque([tree])
    while queue:
        node = queue.popleft()
        for block in _BLOCKS:
            queue.extend(getattr(node, block, ()))
        yield node


def facts_of(source: str) -> list[dict]:
    """Facts of one file in breadth-first order; one ``parse_error`` fact if it does not parse.

    Whatever goes wrong with a file stays with that file.
    """
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return _facts(ast.parse(source), _PARSER_LINE_END.split(source))
    except (SyntaxError, ValueError, RecursionError, MemoryError, LookupError) as exc:
        return [dict(kind="parse_error", line=0, name=type(exc).__name__, walk_ordinal=0)]


def _facts(tree: ast.Module, text: list[str]) -> list[dict]:
    facts = []
    for ordinal, node in enumerate(_statements(tree)):
        if isinstance(node, ast.ExceptHandler) and node.type is None:
            fact = dict(kind="bare_except", mutable_defaults=0)
        elif isinstance(node, ast.FunctionDef):
            mutable = [d for d in node.args.defaults if isinstance(d, (ast.List, ast.Dict, ast.Set))]
            fact = dict(kind="function", name=node.name, mutable_defaults=len(mutable))
        else:
            continue
        facts.append(
            fact
            | dict(
                line=node.lineno,
                end_line=node.end_lineno,
                walk_ordinal=ordinal,
                text=text[node.lineno - 1],
            )
        )
    return facts


@F.arrow_udf(FACTS_TYPE)
def python_facts(content: pa.Array) -> pa.Array:
    facts = [None if source is None else facts_of(source) for source in content.to_pylist()]
    return pa.array(facts, type=to_arrow_type(FACTS_TYPE))

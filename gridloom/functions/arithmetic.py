"""Arithmetic over columns, written as text: numbers, {column}, + - * / and parentheses."""

from __future__ import annotations

import ast
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .parsing import LENIENT, number

_TINY = 2.220446049250313e-16


def arithmetic(df: DataFrame, expression: str) -> Column:
    """The expression as a Column; null if an operand is, or a divisor is (nearly) zero. Python's own grammar reads it,
    of which nothing but these forms is let through; names reach Spark as column references, never as SQL text."""
    names: list[str] = []

    def reference(m: re.Match) -> str:
        name = m[1].strip()
        if name not in df.columns:
            raise ValueError(f"no column {name!r} in the expression")
        names.append(name)
        return f" c{len(names) - 1} "

    text = re.sub(r"\{([^{}]*)\}", reference, expression)
    if not text.strip() or re.search(r"[^0-9.+\-*/()\sc]", text) or "**" in text or "//" in text:
        raise ValueError(f"not an arithmetic expression: {expression!r}")
    try:
        tree = ast.parse(text.strip(), mode="eval").body
    except SyntaxError as e:
        raise ValueError(f"not an arithmetic expression: {expression!r}") from e

    def build(node: ast.AST) -> Column:
        match node:
            case ast.Constant(value=int() | float() as v):
                return F.lit(float(v))
            case ast.Name(id=name):
                return number(df, names[int(name[1:])], LENIENT)
            case ast.UnaryOp(op=ast.USub(), operand=x):
                return -build(x)
            case ast.BinOp(left=x, op=ast.Add(), right=y):
                return build(x) + build(y)
            case ast.BinOp(left=x, op=ast.Sub(), right=y):
                return build(x) - build(y)
            case ast.BinOp(left=x, op=ast.Mult(), right=y):
                return build(x) * build(y)
            case ast.BinOp(left=x, op=ast.Div(), right=y):
                by = build(y)
                return F.when(F.abs(by) >= _TINY, F.try_divide(build(x), by))
        raise ValueError(f"not an arithmetic expression: {expression!r}")

    return F.round(build(tree), 6)

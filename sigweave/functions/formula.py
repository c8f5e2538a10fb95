"""User formulas over columns: arithmetic, min, max and a few functions, parsed and translated, never evaluated as code."""

from __future__ import annotations

import ast
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_BINARY = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: F.try_divide(a, b), ast.Pow: F.pow, ast.Mod: lambda a, b: a % b}
_ONE = {"log10": F.log10, "log2": F.log2, "log": F.log, "sqrt": F.sqrt, "abs": F.abs, "exp": F.exp, "floor": F.floor, "ceil": F.ceil, "signum": F.signum}
_MANY = {"min": F.least, "max": F.greatest}


def compile_formula(formula: str, variables: dict[str, Column]) -> Column:
    """The column of a formula like "max(0.1 + pop, 0.9 - 0.2 * log10(size))"; `^` is a power. ValueError for anything else."""

    def walk(node: ast.expr) -> Column:
        match node:
            case ast.Constant(value=bool()):
                pass
            case ast.Constant(value=int() | float() as v):
                return F.lit(float(v))
            case ast.Name(id=name) if name in variables:
                return variables[name].cast("double")
            case ast.BinOp(left=a, op=op, right=b) if type(op) in _BINARY:
                return _BINARY[type(op)](walk(a), walk(b))
            case ast.UnaryOp(op=ast.USub(), operand=a):
                return -walk(a)
            case ast.UnaryOp(op=ast.UAdd(), operand=a):
                return walk(a)
            case ast.Call(func=ast.Name(id=name), args=[a], keywords=[]) if name in _ONE:
                return _ONE[name](walk(a)).cast("double")
            case ast.Call(func=ast.Name(id=name), args=args, keywords=[]) if name in _MANY and len(args) > 1:
                return reduce(_MANY[name], map(walk, args))
        raise ValueError(f"not part of a formula: {ast.unparse(node)}")

    try:
        tree = ast.parse(formula.replace("^", "**"), mode="eval")
    except SyntaxError as e:
        raise ValueError(f"not a formula: {formula}") from e
    return walk(tree.body)

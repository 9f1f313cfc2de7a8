"""Arrow UDFs (survey section 2.10), for what has no built-in expression."""

from __future__ import annotations

import ast
import io
import re
import tokenize as pytok
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.functions.expr import KEEP_TOKENS

_KEEP = frozenset(KEEP_TOKENS)
# Types as objects: a type as text would need a session when the module is imported.
WORDS = T.ArrayType(T.StringType())
NAMES = T.StructType([T.StructField("defined", WORDS), T.StructField("used", WORDS), T.StructField("bail", T.BooleanType())])


def _code_tokens(code: str) -> list[str]:
    """Names, numbers and strings anonymised; text that is no Python falls back to words and marks."""
    kinds = {pytok.NUMBER: "N", pytok.STRING: "S"}
    silent = {pytok.COMMENT, pytok.NL, pytok.NEWLINE, pytok.INDENT, pytok.DEDENT, pytok.ENDMARKER}
    try:
        toks = [t for t in pytok.generate_tokens(io.StringIO(code).readline) if t.type not in silent]
    except (pytok.TokenError, SyntaxError):
        return [w if w in _KEEP else "V" for w in re.findall(r"\w+|\S", code)]
    return [t.string if t.type == pytok.NAME and t.string in _KEEP else "V" if t.type == pytok.NAME else kinds.get(t.type, t.string) for t in toks]


@F.pandas_udf(WORDS)
def py_tokens(code: pd.Series) -> pd.Series:
    """X01."""
    return code.fillna("").map(_code_tokens)


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode NFC."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def _call_args(code: str, name: str) -> list[str]:
    """Texts between the brackets of each call of ``name``; an unclosed call runs to the end."""
    out = []
    for m in re.finditer(re.escape(name) + r"\s*\(", code):
        depth, k = 1, m.end()
        while k < len(code) and depth:
            depth += {"(": 1, ")": -1}.get(code[k], 0)
            k += 1
        out.append(code[m.end() : k - 1 if not depth else k])
    return out


def call_args(code, name: str):
    """Argument texts of all calls of ``name``, at any depth of brackets."""

    @F.pandas_udf(WORDS)
    def run(codes: pd.Series) -> pd.Series:
        return codes.fillna("").map(lambda c: _call_args(c, name))

    return run(code)


# Constructs in which names may appear dynamically.
BAIL = re.compile(r"\bimport\s+\*|\bexec\s*\(|\beval\s*\(|\b(?:globals|locals|vars)\s*\(\s*\)\s*\[|\bsetattr\s*\(|\b__import__\s*\(")


def _names(code: str) -> dict:
    """Names that a cell defines and uses; ``bail`` if it can't be told."""
    code = re.sub(r"^\s*[%!].*$", "", code, flags=re.M)
    if BAIL.search(code):
        return {"defined": [], "used": [], "bail": True}
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError):
        return {"defined": [], "used": [], "bail": True}
    defined, used = set(), set()
    for node in ast.walk(tree):
        match node:
            case ast.Name(id=name, ctx=ast.Load()):
                used.add(name)
            case ast.Name(id=name):
                defined.add(name)
            case ast.arg(arg=name):
                defined.add(name)
            case ast.FunctionDef(name=name) | ast.AsyncFunctionDef(name=name) | ast.ClassDef(name=name):
                defined.add(name)
            case ast.alias(name=name, asname=other):
                defined.add(other or name.split(".")[0])
            case ast.ExceptHandler(name=str(name)):
                defined.add(name)
            case ast.Global(names=names) | ast.Nonlocal(names=names):
                defined.update(names)
            case ast.MatchAs(name=str(name)) | ast.MatchStar(name=str(name)):
                defined.add(name)
    return {"defined": sorted(defined), "used": sorted(used), "bail": False}


@F.pandas_udf(NAMES)
def py_names(code: pd.Series) -> pd.DataFrame:
    """The set logic stays in Spark."""
    return pd.DataFrame([_names(c or "") for c in code], columns=["defined", "used", "bail"])


def indel(a: str, b: str) -> float:
    """100 * 2 * LCS / (len a + len b); 100 for two empty strings."""
    if not a and not b:
        return 100.0
    # one bit for each place of a: zeros of ``rest`` mark the ends of a longest common subsequence
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    rest = full
    for y in b:
        both = rest & at.get(y, 0)
        rest = ((rest + both) | (rest - both)) & full
    return 200.0 * (len(a) - rest.bit_count()) / (len(a) + len(b))


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """X05."""
    return pd.Series([indel(x or "", y or "") for x, y in zip(a, b)])

r"""Java file metadata: code lines, declared package, public methods.

Comments go with one ``regexp_replace`` that keeps captured literals (string,
character, text block), so a comment marker inside a literal stays; a block
comment over several lines leaves one line break. Code lines are the
non-blank lines that remain. Package and methods are searched with literals
emptied.

The method list holds the explicitly ``public`` methods of any nested type,
minus getters (``get*`` without parameters) and setters (``set*``, one
parameter, void). Column expressions cut the code into *heads*, the text from
each ``public`` to the next ``public`` or ``;``; one Arrow pass reads the tokens of every
head once, with a stack of open brackets, up to the bracket that closes the
parameters. So type arguments and annotations may nest to any depth and hold
any number of arguments, and the time is linear in the text. A head whose brackets do
not match, like one of a field, a constructor, a class or a record, is no method.

Loops over alternatives are written without backtracking (possessive and
unrolled), since Java's matcher recurses on them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from trellis.functions import paths

LITERAL = (r'"""[\s\S]*?"""' r'|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"' r"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'")
COMMENT = r"//[^\n]*|/\*[^*\n]*+(?:\*+[^*/\n][^*\n]*+)*+(?:\*+(\n)|(\n))?[\s\S]*?(?:\*/|\z)"
NON_BLANK_LINE = r"[^\r\n]*\S[^\r\n]*"
PACKAGE = r"(?m)^\s*package\s+([\w.]+)\s*;"
PUBLIC = r"(?U)(?<![\w$.])public(?![\w$])"
TOKEN = re.compile(r"[\w$]+|\.\.\.|[^\w\s$]")
# Fixed values of the Java language.
MODIFIERS = {"static", "final", "synchronized", "abstract", "native", "default", "strictfp", "transient", "volatile", "sealed"}
NO_TYPES = {"class", "interface", "enum", "new", "return", "throw", "else"}
CLOSES = {"(": ")", "[": "]", "{": "}", "<": ">"}


def without_comments(src: Column) -> Column:
    return F.regexp_replace(src, f"({LITERAL})|{COMMENT}", "$1$2$3")


def without_literals(code: Column) -> Column:
    return F.regexp_replace(code, LITERAL, '""')


def heads(bare: Column) -> Column:
    """Texts after each ``public`` up to the next one or a ``;``, without those that have no parameters."""
    parts = F.split(bare, PUBLIC)
    cut = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda h: F.substring_index(h, ";", 1))
    return F.filter(cut, lambda h: F.contains(h, F.lit("(")))


def _plain(tokens: Iterator[str]) -> Iterator[tuple[str, int]]:
    """Tokens outside annotations, each with the number of brackets open before it (a closing one: after it).

    Ends at a bracket that closes none, or another than the last opened one.
    """
    stack: list[str] = []
    tokens = iter(tokens)
    token = next(tokens, None)
    while token is not None:
        ahead = None
        if token == "@":
            token = next(tokens, None)  # its name
            ahead = next(tokens, None)
            while ahead == ".":
                next(tokens, None)
                ahead = next(tokens, None)
            if token == "interface":
                return
            if ahead == "(":  # its arguments
                inner = [")"]
                for ahead in tokens:
                    if ahead in "([{":
                        inner.append(CLOSES[ahead])
                    elif ahead in ")]}" and ahead != inner.pop():
                        return
                    if not inner:
                        break
                ahead = next(tokens, None)
        elif token in CLOSES:
            yield token, len(stack)
            stack.append(CLOSES[token])
        elif token in CLOSES.values():
            if not stack or stack.pop() != token:
                return
            yield token, len(stack)
        else:
            yield token, len(stack)
        token = next(tokens, None) if ahead is None else ahead


def _spelled(tokens: list[str]) -> str:
    """Type tokens as text: ``, `` after a comma, a space between words."""
    out, before = [], ""
    for t in tokens:
        if before == "," or t == "&" or before == "&" or (t[0].isalnum() or t[0] in "_$") and (before[-1:].isalnum() or before[-1:] in ("_", "$", "?", "]") and before):
            out.append(" ")
        out.append(t)
        before = t
    return "".join(out)


def _parameter(tokens: list[str]) -> str | None:
    """Type of one parameter: modifiers and name dropped, brackets after the name moved to the type; None for a receiver."""
    tokens = [t for t in tokens if t != "final"]
    end = len(tokens)
    while end >= 2 and tokens[end - 2:end] == ["[", "]"]:
        end -= 2
    if end < 2:
        return _spelled(tokens)
    return None if tokens[end - 1] == "this" else _spelled(tokens[:end - 1] + tokens[end:])


def signature(head: str) -> str | None:
    """``name(types)`` of the method declared by a head; None for getters, setters and what is no method."""
    before: list[str] = []
    parameters: list[list[str]] = []
    inside = False
    for token, depth in _plain(m.group() for m in TOKEN.finditer(head)):
        if inside:
            if depth == 0 and token == ")":
                break
            if depth == 1 and token == ",":
                parameters.append([])
            elif token in "{}=;":
                return None
            else:
                parameters[-1].append(token)
        elif depth == 0 and token == "(":
            inside, parameters = True, [[]]
        elif token in "{}=;()" or token in NO_TYPES:
            return None
        elif depth or token not in MODIFIERS:
            before.append(token)
    else:
        return None
    if before[:1] == ["<"]:  # the method's own type parameters
        depth = 0
        for i, t in enumerate(before):
            depth += (t == "<") - (t == ">")
            if depth == 0:
                before = before[i + 1:]
                break
    name = before[-1] if before else ""
    kind = _spelled(before[:-1])
    if not kind or before[0] == "record" or not (name[0].isalnum() or name[0] in "_$") or before[-2] == ".":
        return None
    types = [t for t in map(_parameter, filter(None, parameters)) if t is not None]
    if name.startswith("get") and not types or name.startswith("set") and len(types) == 1 and kind == "void":
        return None
    return f"{name}({', '.join(types)})"


@F.pandas_udf(ArrayType(StringType()))
def signatures(found: pd.Series) -> pd.Series:
    return found.map(lambda hs: None if hs is None else [s for s in map(signature, hs) if s is not None])


def with_java_metadata(files: DataFrame, content: str = "content") -> DataFrame:
    """``files`` with ``code_lines``, ``declared_package`` and ``public_methods``; NULL where the file is not Java."""
    is_java = F.col("file_path").endswith(".java")
    step = files.withColumn("__code", F.when(is_java, without_comments(F.coalesce(F.col(content), F.lit("")))))
    step = step.withColumn("__bare", without_literals(F.col("__code")))
    package = F.regexp_extract("__bare", PACKAGE, 1)
    return (step.withColumns({
        "code_lines": F.regexp_count("__code", F.lit(NON_BLANK_LINE)).cast("bigint"),
        "declared_package": F.when(package != "", package),
        "public_methods": signatures(heads(F.col("__bare")))})
        .drop("__code", "__bare"))


def java_metadata(files: DataFrame) -> DataFrame:
    """(file_id, code_lines, declared_package, public_methods) for ``.java`` files."""
    java = files.where(F.col("file_path").endswith(".java")).select("file_id", "file_path", "content")
    return with_java_metadata(java).drop("file_path", "content")


def directory_packages(files_meta: DataFrame, dir_key: str = "dir_path") -> DataFrame:
    """Package name of a directory from its first file by path (declared package, else dir name).

    ``files_meta`` has ``dir_path, file_path, declared_package`` (NULL for
    non-Java or undeclared). A first Java file without a declaration gives the
    directory name, and such files are listed by ``files_without_package``.
    """
    name = F.coalesce(F.col("declared_package"), paths.parent_dir_name("file_path"))
    return (files_meta.groupBy(dir_key)
            .agg(F.min_by(name, "file_path").alias("package_name")))


def files_without_package(files_meta: DataFrame) -> DataFrame:
    return files_meta.where(F.col("file_path").endswith(".java") & F.col("declared_package").isNull())

"""Path predicates and path-derived columns, all as JVM-side Column expressions.

Covers the supported-extension test, the test/target exclusion, the
valid-file conjunction, extension → language, parent directory as package,
basename, ancestor expansion and module-relative paths.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference: the eight source suffixes
# (case-sensitive) and the extension → language table (15 extensions,
# everything else "unknown").
SOURCE_EXTENSIONS = (".java", ".scala", ".js", ".ts", ".tsx", ".py", ".cpp", ".hs")
EXTENSION_LANGUAGE = {
    ".java": "java",
    ".scala": "scala",
    ".js": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript-react",
    ".py": "python",
    ".cpp": "cpp",
    ".hs": "haskell",
    ".properties": "properties",
    ".yaml": "yaml",
    ".yml": "yaml",
    ".xml": "xml",
    ".kt": "kotlin",
    ".groovy": "groovy",
    ".sh": "shell",
}
EXCLUDED_PATH_WORDS = ("test", "target")

SOURCE_SUFFIX_REGEX = r"\.(" + "|".join(e[1:] for e in SOURCE_EXTENSIONS) + r")$"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def is_source_file(path) -> Column:
    """Ends with one of the supported suffixes (case-sensitive)."""
    return _c(path).rlike(SOURCE_SUFFIX_REGEX)


def is_excluded_path(path) -> Column:
    """Lower-cased whole path contains ``test`` or ``target``."""
    low = F.lower(_c(path))
    cond = F.lit(False)
    for w in EXCLUDED_PATH_WORDS:
        cond = cond | low.contains(w)
    return cond


def is_valid_source_file(path) -> Column:
    return is_source_file(path) & ~is_excluded_path(path)


def extension(path) -> Column:
    """Text from the last ``.`` to the end ('' when there is no dot)."""
    return F.regexp_extract(_c(path), r"(\.[^.]*)$", 1)


def file_type(path) -> Column:
    ext = extension(path)
    out = F.lit("unknown")
    for e, lang in reversed(list(EXTENSION_LANGUAGE.items())):
        out = F.when(ext == e, lang).otherwise(out)
    return out


def parent_dir_name(path) -> Column:
    """Name of the parent directory, '' at top level."""
    parts = F.split(_c(path), "/")
    return F.when(F.size(parts) >= 2, F.element_at(parts, -2)).otherwise(F.lit(""))


def basename(path) -> Column:
    return F.substring_index(_c(path), "/", -1)


def dirname(path) -> Column:
    """Everything before the last '/' ('' when there is none)."""
    return F.regexp_extract(_c(path), r"^(.*)/[^/]*$", 1)


def ancestors(dir_path) -> Column:
    """Array of every prefix of a '/'-separated relative directory, shortest first.

    ``a/b/c`` → ``[a, a/b, a/b/c]``; the closed form of the self-feeding
    directory recursion (no iteration, no feedback topic).
    """
    parts = F.split(_c(dir_path), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)),
                       lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def depth(dir_path) -> Column:
    return F.size(F.split(_c(dir_path), "/"))


def relative_to(base, path) -> Column:
    """``path`` with ``base/`` removed from its front."""
    return _c(path).substr(F.length(_c(base)) + 2, F.lit(1 << 30))


def module_location(project_location, module_name) -> Column:
    return F.concat_ws("/", _c(project_location), _c(module_name))

"""The data model: schemas of facts and tables, and groups of kinds."""

from __future__ import annotations

from pyspark.sql import types as T

# Kinds, words and sentences that answers must carry as they are.
CALLS = ("calls",)
REFERENCES = ("references", "calls_indirect")
TYPE_REASONS = (
    ("param_type", "takes this type as a parameter"),
    ("returns", "returns this type"),
    ("field_type", "holds this type in a field"),
    ("var_type", "declares a variable of this type"),
    ("aliases", "names this type in an alias"),
)
DEPENDENCIES = (
    "calls", "references", "calls_indirect", "inherits", "overrides", "field_type", "param_type", "returns",
    "var_type", "aliases", "specializes", "instantiates",
)
CALLABLE = ("function", "method", "constructor", "destructor", "conversion_function", "function_template")
RANGE_CONTAINERS = ("function", "method", "constructor", "destructor", "class", "struct", "namespace", "conversion_function")
TYPES = ("class", "struct", "union", "enum")
SEVERITIES = ("error", "fatal", "warning")
ACCESS = {"pub": "public", "prot": "protected", "priv": "private", "none": "none"}
NOTABLE = (
    "virtual", "pure", "override", "abstract", "static", "const", "explicit", "deleted", "defaulted", "inline",
    "constexpr", "deprecated", "variadic", "union", "lambda", "scoped", "using", "extern_c", "tmpl", "inst",
)
ACCURACY = ("exact", "approximate", "degraded", "unknown")
ACCURACY_OF = {"compile_commands.json": "exact", "auto-detected": "approximate", "fallback": "degraded"}
LANGUAGES = {".c": "c", ".cc": "c++", ".cpp": "c++", ".cxx": "c++", ".c++": "c++", ".m": "objective-c", ".mm": "objective-c++"}
SKIPPED_FOLDERS = (".git", ".hg", ".svn", "node_modules", "__pycache__", ".cache", ".ccache", "CMakeFiles")
DATABASE_FOLDERS = ("", "build", "Build", "cmake-build-debug", "cmake-build-release", "out", "out/build", "build/debug", "build/release")
STATUS_WORDS = {"A": "added", "M": "modified", "D": "deleted", "R": "renamed", "C": "copied", "T": "type changed"}
MOST_SITES, CLOSURE_DEPTH, PARENT_DEPTH, NAMESPACE_DEPTH = 5, 8, 8, 4


#: One record of a fact stream; key names are those on the wire and differ by case alone in two places.
FACT = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("t", "k", "v", "p", "u", "n", "q", "s", "ty", "a", "b", "sp", "sev", "m")]
    + [T.StructField(n, T.LongType()) for n in ("i", "f", "df", "w")]
    + [T.StructField(n, T.IntegerType()) for n in ("sys", "stub", "l", "c", "el", "ec", "dl", "dc", "ang")]
    + [T.StructField("degraded", T.StringType()), T.StructField("F", T.MapType(T.StringType(), T.StringType()))]
)

# Columns follow the wire.
FILE = ("path string, is_system boolean, in_project boolean")
TU = ("tu string, config_source string, config_detail string, degraded boolean, pch_dropped string, errors long, stamp string, stats string")
RAW_SYMBOL = (
    "tu string, usr string, stub int, kind string, name string, qualified string, signature string, type_text string, file string, line int, col int, "
    "end_line int, end_col int, def_file string, def_line int, def_col int, parent_usr string, flags string"
)
RAW_EDGE = ("tu string, kind string, src string, dst string, file string, line int, weight long, flags string")
RAW_INCLUDE = ("tu string, from_file string, to_file string, line int, angled int, spelled string")
RAW_DIAG = ("tu string, severity string, file string, line int, col int, message string")

"""Column builders shared by operators: names, locations, spans, flags, text matching."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkweft import model


def first_filled(*columns: Column | str) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in columns))


def display(prefix: str = "") -> Column:
    return first_filled(f"{prefix}qualified", f"{prefix}name", F.col(f"{prefix}usr").cast("string"))


def ascii_lower(text: Column) -> Column:
    """Lower case of A to Z alone, as matching without regard to case has it here."""
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def like(text: Column, pattern: Column) -> Column:
    """LIKE without regard to ASCII case; % and _ in the pattern are live and nothing escapes them."""
    literal = F.replace(ascii_lower(pattern), F.lit("\\"), F.lit("\\\\"))
    return F.call_function("like", ascii_lower(text), literal)


def contains(text: Column, part: Column) -> Column:
    return like(text, F.concat(F.lit("%"), part, F.lit("%")))


def relative(path: Column, root: str) -> Column:
    inside = path.startswith(root.rstrip("/") + "/")
    return F.when(inside, F.substring(path, F.lit(len(root.rstrip("/")) + 2), F.length(path))).otherwise(path)


def location(path: Column, line: Column) -> Column:
    """path:line, the path alone where no line is known, '' without a file."""
    return F.when(path.isNull(), "").when(F.coalesce(line, F.lit(0)) == 0, path).otherwise(F.concat_ws(":", path, line.cast("string")))


def split_location(text: Column) -> tuple[Column, Column]:
    """(path, line) of 'path:line' or 'path:a-b' (its first line); null where the text is none."""
    found = r"^(.*[/.].*):([0-9]+)(?:-[0-9]+)?$"
    fits = text.rlike(found)
    return F.when(fits, F.regexp_extract(text, found, 1)), F.when(fits, F.regexp_extract(text, found, 2).try_cast("int"))


def split_signature(text: Column) -> tuple[Column, Column]:
    """(name, signature with parentheses) of 'name(args)'; the signature is null where there is none."""
    open_at = F.instr(text, "(")
    fits = text.endswith(")") & (open_at > 1)
    return F.when(fits, F.trim(F.substring(text, F.lit(1), open_at - 1))).otherwise(text), F.when(fits, F.substring(text, open_at, F.length(text)))


def same_file(path: Column, wanted: Column) -> Column:
    """Whether two paths name one file: equal, or one ends with the other at a folder."""
    slashed = lambda p: F.concat(F.lit("/"), p)
    filled = (F.length(path) > 0) & (F.length(wanted) > 0)
    return F.coalesce(filled & ((path == wanted) | path.endswith(slashed(wanted)) | wanted.endswith(slashed(path))), F.lit(False))


def language(path: Column) -> Column:
    suffix = F.regexp_extract(F.lower(path), r"(\.[^./]+)$", 1)
    known = F.create_map(*(F.lit(x) for pair in model.LANGUAGES.items() for x in pair))
    return F.try_element_at(known, suffix)


def flags(text: Column) -> Column:
    """A flags object as a map, empty where it is none."""
    return F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))


def notable(text: Column) -> Column:
    """The flags worth telling; a flag that is merely set reads true."""
    kept = F.map_filter(flags(text), lambda k, v: k.isin(*model.NOTABLE) & ~v.isin("", "0"))
    return F.transform_values(kept, lambda k, v: F.when(v == "1", F.lit("true")).otherwise(v))


def access_word(code: Column) -> Column:
    words = F.create_map(*(F.lit(x) for pair in model.ACCESS.items() for x in pair))
    return F.coalesce(F.try_element_at(words, code), code)


def callable_kind(kind: Column) -> Column:
    return F.coalesce(kind.isin(*model.CALLABLE), F.lit(False))


def stamp(content: Column, database_time: Column) -> Column:
    """The state of a unit: SHA-256 over its bytes, a NUL, and the time of its compilation database."""
    return F.sha2(F.concat(content, F.unhex(F.lit("00")), F.encode(database_time.cast("string"), "utf-8")), 256)

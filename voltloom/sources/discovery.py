"""Finding model files and the times in their texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.files import instant

#: What a time in a running text looks like.
_TIME = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:\d{2})|\d{8}T\d{6}Z|\d{8}_\d{6}|\d{8}T\d{4}Z|\d{8}_\d{4}"


def glob_pattern(glob: str) -> str:
    """A glob as a pattern for whole paths: ** crosses folders, * and ? don't, {a,b} is either."""
    out, depth = "", 0
    for part in re.findall(r"\*\*/|\*\*|\*|\?|\{|\}|,|[^*?{},]+", glob):
        if part == "{":
            depth, out = depth + 1, out + "(?:"
        elif part == "}" and depth:
            depth, out = depth - 1, out + ")"
        elif part == "," and depth:
            out += "|"
        else:
            out += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part) or re.escape(part)
    return rf"^{out}\z"


def discover(files: DataFrame, path: str = "path", ending: str = ".xml", ignored: tuple[str, ...] = (), glob: str | None = None) -> DataFrame:
    """Distinct (path) of the files with the ending, in any letter case, that lie in none of the ignored
    folders; paths with ./ and // are the same as without. Order is left to who shows them."""
    p = F.regexp_replace(F.replace(F.col(path), F.lit("\\"), F.lit("/")), r"(?<=/)(?:\./|/)+", "")
    found = files.select(p.alias("path")).where(F.lower("path").endswith(ending.lower())).distinct()
    for folder in ignored:
        found = found.where(~F.concat(F.lit("/"), "path").contains(f"/{folder.strip('/')}/"))
    return found.where(F.col("path").rlike(glob_pattern(glob))) if glob else found


def near_field(text: Column, field: str) -> Column:
    """The time beside a field's name: as an attribute's value, as an element's text, or at most 300
    characters behind it; of each form the first that is a time."""
    f = re.escape(field)
    forms = (rf'(?i)\b[\w:.-]*{f}\b\s*=\s*"([^"]+)"', rf"(?i)<[\w:.-]*{f}[^>]*>\s*([^<]+)\s*</[\w:.-]*{f}\s*>", rf"(?i)\b[\w:.-]*{f}\b.{{0,300}}?({_TIME})")

    def first(form: str) -> Column:
        found = F.regexp_extract_all(text, F.lit(form), F.lit(1))
        times = F.transform(found, lambda x: F.coalesce(instant(x), instant(F.regexp_extract(x, f"({_TIME})", 1))))
        return F.get(F.array_compact(times), F.lit(0))

    return F.coalesce(*map(first, forms))

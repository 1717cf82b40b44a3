"""POSIX path components as column expressions.

Rules of PurePosixPath: repeated and trailing slashes don't count, a leading dot is no suffix,
and the suffix is the last one only. Null paths give nulls.
"""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalized(path: Column) -> Column:
    """Without repeated slashes, ``.`` segments and trailing slashes."""
    p = F.regexp_replace(path, "/+", "/")
    p = F.regexp_replace(F.regexp_replace(p, r"(?:/\.)+(?=/|$)", ""), r"^\./", "")
    return F.when(path.rlike("^/+$"), "/").otherwise(F.regexp_replace(p, "/$", ""))


def name(path: Column) -> Column:
    return F.regexp_extract(normalized(path), "([^/]*)$", 1)


def suffix(path: Column) -> Column:
    return F.regexp_extract(name(path), r"^.+?(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    n = name(path)
    return F.substring(n, F.lit(1), F.length(n) - F.length(suffix(path)))


def parent(path: Column) -> Column:
    p = normalized(path)
    up = F.regexp_replace(p, "/?[^/]*$", "")
    return F.when(up != "", up).otherwise(F.when(p.startswith("/"), "/").otherwise("."))


def parts(path: Column) -> Column:
    """Segments; a leading slash is the first of them."""
    p = normalized(path)
    return F.concat(F.when(p.startswith("/"), F.array(F.lit("/"))).otherwise(F.array().cast("array<string>")), F.filter(F.split(p, "/"), lambda x: x != ""))


def with_components(df: DataFrame, path_col: str = "path") -> DataFrame:
    """Add parent, name, stem and suffix, those that aren't there."""
    made = {"parent": parent, "name": name, "stem": stem, "suffix": suffix}
    return df.withColumns({k: f(F.col(path_col)) for k, f in made.items() if k not in df.columns})


def common_root(df: DataFrame, path_col: str = "path") -> str:
    """The longest common leading parts of all paths: those of the least and the greatest list of parts."""
    low, high = df.filter(F.col(path_col).isNotNull()).select(parts(F.col(path_col)).alias("p")).agg(F.min("p"), F.max("p")).first()
    shared = []
    for a, b in zip(low or [], high or [], strict=False):
        if a != b:
            break
        shared.append(a)
    return "/".join(shared).replace("//", "/")


def with_depth(df: DataFrame, path_col: str = "path", root: str | None = None) -> DataFrame:
    """Add depth: parts below ``root`` (by default the common root); all parts for a path that isn't under it."""
    at = parts(F.col(path_col))
    base = root if root is not None else common_root(df, path_col)
    lead = parts(F.lit(base)) if base else F.array().cast("array<string>")
    n = F.size(lead)
    under = F.slice(at, F.lit(1), n) == lead
    return df.withColumn("depth", F.when(under, F.size(at) - n).otherwise(F.size(at)).cast("long"))


def with_filename_features(df: DataFrame, path_col: str = "path", sep: str = "_", prefix: str | None = "feat", max_tokens: int | None = None, include_parent: bool = False, include_all_parts: bool = False, token_names: list[str] | str | None = None) -> DataFrame:
    """Split file stems at the literal ``sep`` into columns; short rows get empty strings.

    The number of columns is ``max_tokens``, or that of the longest row (one pass over the paths).
    """
    tokens = F.split(stem(F.col(path_col)), re.escape(sep))
    n = max_tokens or df.agg(F.max(F.size(tokens))).first()[0] or 0
    own = token_names if isinstance(token_names, list) else []
    lead = "token" if prefix is None or token_names == "auto" else prefix
    names = [own[i] if i < len(own) else f"{lead}{i + 1}" for i in range(n)]
    out = df.withColumns({c: F.coalesce(F.get(tokens, F.lit(i)), F.lit("")) for i, c in enumerate(names)})
    if include_parent:
        folder = name(parent(F.col(path_col)))
        out = out.withColumn("parent_name" if "parent" in df.columns else "parent", folder)
    if include_all_parts:
        at = parts(F.col(path_col))
        k = df.agg(F.max(F.size(at))).first()[0] or 0
        out = out.withColumns({f"path_part{i}": F.coalesce(F.get(at, F.lit(i)), F.lit("")) for i in range(k)})
    return out


def hidden(path: Column) -> Column:
    """Whether a segment starts with a dot."""
    return path.rlike(r"(^|/)\.[^/]")


def glob_regex(pattern: str) -> str:
    """The regular expression of a glob, as Java reads it."""
    return "^(?s:" + fnmatch.translate(pattern).removeprefix("(?s:").removesuffix(")\\z").removesuffix(")\\Z") + ")$"


def match_regex(pattern: str) -> str:
    """The regular expression of a glob on the last segments of a path, as many as the pattern has; on the whole path if it starts with a slash.

    ``*``, ``?`` and sets don't match a slash.
    """
    def segment(given: str) -> str:
        out, i = "", 0
        while i < len(given):
            c, i = given[i], i + 1
            end = given.find("]", i + 1 + given[i : i + 1].count("!")) if c == "[" else -1
            if end > 0:
                inside = given[i:end].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
                out += "[^/" + inside[1:] + "]" if inside.startswith("!") else "[" + inside.replace("^", "\\^") + "]"
                i = end + 1
            else:
                out += {"*": "[^/]*", "?": "[^/]"}.get(c) or re.escape(c)
        return out

    parts = [segment(x) for x in pattern.split("/") if x and x != "."]
    return ("^/" if pattern.startswith("/") else "^(?:.*/)?") + "/".join(parts) + "$"


def pattern_regex(pattern: str, glob: bool = False, case_sensitive: bool = False) -> str | None:
    """A search pattern as a regular expression on names; null matches nothing, as a bad pattern does."""
    if not pattern or pattern == ".":
        return ""
    text = glob_regex(pattern) if glob else pattern
    try:
        re.compile(text)
    except re.error:
        return None
    return text if case_sensitive else f"(?i){text}"


def strip_url(url: Column) -> Column:
    """The path of a URL, without scheme, host, query and fragment."""
    return F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z]+://[^/?#]*", ""), r"[?#].*$", "")

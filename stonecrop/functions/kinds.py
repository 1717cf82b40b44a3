"""Sets of file suffixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stonecrop.functions import paths

#: Suffixes that count as images.
IMAGE = {".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tif", ".tiff", ".webp"}
#: Suffixes that count as text.
TEXT = {
    ".txt", ".md", ".markdown", ".rst", ".json", ".jsonl", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".conf", ".py", ".rs", ".js", ".ts", ".tsx",
    ".jsx", ".css", ".html", ".htm", ".xml", ".sql", ".sh", ".bash", ".zsh", ".fish", ".r", ".jl", ".go", ".java", ".c", ".cpp", ".h", ".hpp", ".rb",
    ".php", ".swift", ".kt", ".scala", ".lua", ".pl", ".pm", ".tf", ".tfvars", ".env", ".make", ".cmake", ".gradle", ".cs",
}


def is_image(path: Column) -> Column:
    return F.lower(paths.suffix(path)).isin(*sorted(IMAGE))


def is_text(path: Column) -> Column:
    return F.lower(paths.suffix(path)).isin(*sorted(TEXT))


def has_extension(path: Column, extensions: list[str] | str) -> Column:
    """Whether the last suffix is one of ``extensions``, by any case, dot or not."""
    given = [extensions] if isinstance(extensions, str) else list(extensions)
    return F.lower(paths.suffix(path)).isin(*["." + x.lower().lstrip(".") for x in given])

"""Path and key columns."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column
from pyspark.sql import functions as F

# The file endings each listing accepts.
DOCUMENT_ENDINGS = ("pdf", "png", "jpg", "jpeg")
BATCH_ENDINGS = ("pdf", "png", "jpg", "jpeg", "tiff", "docx")
OFFICE_ENDINGS = ("pdf", "png", "jpg", "jpeg", "doc", "docx", "odt", "ppt", "pptx", "odp")


def basename(path: Column) -> Column:
    """Part after the last slash; null when the path ends in one."""
    return F.regexp_substr(path, F.lit(r"[^/]+$"))


def last_segment(path: Column) -> Column:
    """Part after the last slash; empty when the path ends in one."""
    return F.substring_index(path, "/", -1)


def stem(name: Column) -> Column:
    """Name without its last ending; dot-files keep their name."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def ending(name: Column) -> Column:
    """Lower-case ending without the dot, empty when there is none."""
    return F.lower(F.regexp_extract(last_segment(name), r"(?<=.)\.([^.]+)$", 1))


def has_ending(name: Column, endings) -> Column:
    return ending(name).isin(*endings)


def matches_glob(key: Column, pattern: str) -> Column:
    """Glob on the whole key, so ``*`` also crosses folders."""
    return key.rlike("^" + fnmatch.translate(pattern).removesuffix(r"\Z").removesuffix(r"\z") + r"\z")


def names_single_file(prefix: Column) -> Column:
    return prefix.rlike(r"\.(" + "|".join(BATCH_ENDINGS) + ")$")


def is_folder_marker(key: Column) -> Column:
    return key.endswith("/")


def uri_bucket(uri: Column) -> Column:
    return F.regexp_extract(uri, r"^[a-z0-9]+://([^/]+)/(.*)$", 1)


def uri_key(uri: Column) -> Column:
    return F.regexp_extract(uri, r"(?s)^[a-z0-9]+://([^/]+)/(.*)$", 2)


def output_key(key: Column, source_root: str = "input/", target_root: str = "output/") -> Column:
    """Key of the markdown result: other root, same sub-folders, ending replaced by ``.md``."""
    relative = F.when(key.startswith(source_root), F.substring(key, len(source_root) + 1, 1 << 30)).otherwise(key)
    folder = F.regexp_extract(relative, r"^(.*/)[^/]*$", 1)
    return F.concat(F.lit(target_root), folder, stem(last_segment(relative)), F.lit(".md"))


def top_folder(key: Column) -> Column:
    """Second segment of a key with sub-folders, ``root`` for two segments, else null."""
    parts = F.split(key, "/")
    return F.when(F.size(parts) > 2, F.get(parts, F.lit(1))).when(F.size(parts) == 2, F.lit("root"))


def chunk_image_path(root: str, document: Column, page: Column, kind: Column, chunk_id: Column) -> Column:
    """Relative image path of a chunk; null unless id, type and page are all there."""
    known = (F.coalesce(chunk_id, F.lit("")) != "") & (F.coalesce(kind, F.lit("")) != "") & page.isNotNull()
    path = F.concat(
        F.lit(f"{root}/chunk_images/"), stem(document), F.lit("/page_"), page.cast("string"),
        F.lit("/"), kind, F.lit("."), chunk_id, F.lit(".png"),
    )
    return F.when(known, path)

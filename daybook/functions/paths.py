"""Path columns: slugs, comparison form, relative paths, languages, noise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extension -> language id; label of files without extension.
LANGUAGE_BY_EXTENSION = {
    "ts": "typescript",
    "tsx": "typescriptreact",
    "js": "javascript",
    "jsx": "javascriptreact",
    "mjs": "javascript",
    "cjs": "javascript",
    "py": "python",
    "rs": "rust",
    "go": "go",
    "scss": "scss",
    "sass": "scss",
    "css": "css",
    "html": "html",
    "htm": "html",
    "json": "json",
    "jsonc": "json",
    "md": "markdown",
    "mdx": "markdown",
    "prisma": "prisma",
    "java": "java",
    "c": "c",
    "h": "c",
    "cpp": "cpp",
    "hpp": "cpp",
    "cs": "csharp",
    "php": "php",
    "rb": "ruby",
    "sh": "shellscript",
    "ps1": "powershell",
    "yml": "yaml",
    "yaml": "yaml",
    "sql": "sql",
    "vue": "vue",
    "svelte": "svelte",
}
OTHER_LANGUAGE = "autre"
# The shorter table used for files seen on disk.
DISK_EXTENSIONS = (
    "ts", "tsx", "js", "jsx", "py", "rs", "go", "java", "md", "json", "css", "scss", "html", "prisma",
)
# Fixed value: folders whose files are not counted.
NOISE_FOLDERS = r"(^|/)(\.git|node_modules|dist|dist-test|\.next|build|coverage)(/|$)"


def path_slug(path: Column) -> Column:
    """Each of : \\ / and space becomes one dash; dashes at either end go; lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(path, r"[:\\/ ]", "-"), "^-+|-+$", ""))


def comparable_path(path: Column) -> Column:
    """Runs of slashes of either kind become one /, the trailing one goes; lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(path, r"[\\/]+", "/"), "/$", ""))


def is_under(root: Column, path: Column) -> Column:
    """path is root or lies below it."""
    r, p = comparable_path(root), comparable_path(path)
    return (p == r) | F.startswith(p, F.concat(r, F.lit("/")))


def ancestors(path: Column) -> Column:
    """The comparable path and every folder above it; equi-joins against roots replace a prefix join."""
    parts = F.split(comparable_path(path), "/")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
    )


def relative_path(root: Column, path: Column) -> Column:
    """path without a leading root (any case); backslashes become /."""
    rest = F.substring(path, F.length(root) + 1, F.length(path))
    inside = F.regexp_replace(rest, r"^[\\/]+", "")
    below = F.startswith(F.lower(path), F.lower(root))
    return F.replace(F.when(below, inside).otherwise(path), F.lit("\\"), F.lit("/"))


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), key)


def language_of(path: Column) -> Column:
    """Language by the text after the last dot; the extension itself if unknown."""
    extension = F.lower(F.substring_index(path, ".", -1))
    return F.when(F.contains(path, F.lit(".")), _lookup(LANGUAGE_BY_EXTENSION, extension)).otherwise(
        F.lit(OTHER_LANGUAGE)
    )


def disk_language_of(path: Column) -> Column:
    """Language of a file seen on disk: a path without dot counts as its own extension."""
    table = {x: LANGUAGE_BY_EXTENSION[x] for x in DISK_EXTENSIONS}
    return _lookup(table, F.lower(F.substring_index(path, ".", -1)))


def is_noise(path: Column) -> Column:
    return F.rlike(path, F.lit(NOISE_FOLDERS))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[\\/]"), -1)


def transcript_uuid(path: Column) -> Column:
    """Session id from a transcript's file name: no rollout-<…>- prefix, no .jsonl."""
    return F.regexp_replace(F.regexp_replace(file_name(path), "^rollout-.*?-", ""), r"\.jsonl$", "")

"""Which files are taken: languages by name, folders left out, and the first reason to skip a file, all as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeseek.functions.text import name_of, suffix

MAX_BYTES = 2 * 1024 * 1024
#: Languages by suffix, languages by name, folders left out by name and by path.
LANGUAGES = {
    ".c": "C", ".cc": "C++", ".cpp": "C++", ".cs": "C#", ".css": "CSS", ".go": "Go", ".h": "C/C++ Header", ".hpp": "C++ Header", ".html": "HTML",
    ".java": "Java", ".js": "JavaScript", ".json": "JSON", ".jsx": "JavaScript JSX", ".kt": "Kotlin", ".kts": "Kotlin Script", ".md": "Markdown",
    ".php": "PHP", ".ps1": "PowerShell", ".py": "Python", ".rb": "Ruby", ".rs": "Rust", ".scss": "SCSS", ".sh": "Shell", ".sql": "SQL",
    ".svelte": "Svelte", ".swift": "Swift", ".toml": "TOML", ".ts": "TypeScript", ".tsx": "TypeScript TSX", ".vue": "Vue", ".xml": "XML",
    ".yaml": "YAML", ".yml": "YAML",
}
NAMED = {"dockerfile": "Dockerfile", "makefile": "Makefile"}
LEFT_OUT = (
    ".cache", ".git", ".idea", ".mypy_cache", ".next", ".nuxt", ".pytest_cache", ".ruff_cache", ".test_tmp", ".tmp-doc-screenshot-profile", ".venv", ".vscode",
    "__pycache__", "build", "coverage", "dist", "env", "node_modules", "out", "target", "temp", "tmp", "vendor", "venv",
)
LEFT_OUT_PATHS = (".github/artifacts", ".github/cache", "data/manifests", "data/repository_cache")


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def extension(path: Column) -> Column:
    """The suffix that decides the language: none for files known by name; null for files of no known language."""
    return F.when(F.lower(name_of(path)).isin(*NAMED), "").when(suffix(path).isin(*LANGUAGES), suffix(path))


def language(path: Column) -> Column:
    return F.coalesce(_lookup(NAMED, F.lower(name_of(path))), _lookup(LANGUAGES, suffix(path)))


def is_left_out(path: Column) -> Column:
    """Whether a folder above the file is left out, by its name or by its path from the root."""
    folders = F.slice(F.split(F.lower(path), "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    named = F.exists(folders, lambda x: x.isin(*LEFT_OUT))
    joined = F.concat(F.array_join(folders, "/"), F.lit("/"))
    below = F.lit(False)
    for p in LEFT_OUT_PATHS:
        below = below | joined.startswith(f"{p}/")
    return named | below


def skip_reason(path: Column, size: Column, content: Column, is_link: Column, error: Column, max_bytes: int = MAX_BYTES) -> Column:
    """The first reason not to take a file, in a fixed order; null for files that are taken. content is binary."""
    return (
        F.when(is_link, "symbolic_link")
        .when(language(path).isNull(), "unsupported_extension")
        .when(size > max_bytes, f"exceeds_size_limit:{max_bytes}")
        .when(error.isNotNull(), F.concat(F.lit("unreadable: "), error))
        .when(F.position(F.lit(b"\0"), content) > 0, "binary_content")
        .when(~F.is_valid_utf8(content.cast("string")), "not_utf8")
    )

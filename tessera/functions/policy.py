"""Admission rules as column expressions: paths, contents, languages."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import suffix

MAX_FILE_BYTES = 4 * 1024 * 1024
MAX_TOTAL_BYTES = 128 * 1024 * 1024
MAX_FILES = 50_000

# Names that are never read, patterns of secrets, and languages by suffix.
EXCLUDED_DIRS = (
    ".git", ".venv", "venv", "node_modules", "__pycache__", ".idea", ".vscode", "dist", "build", "target",
    ".pytest_cache", ".ruff_cache", ".artifacts", ".ssh", ".aws", ".gnupg",
)
EXCLUDED_NAMES = (
    ".env", ".env.*", "*.pem", "*.key", "id_rsa*", "id_ed25519*", "credentials*", "secrets*", "service-account*.json",
    "service_account*.json", "client_secret*.json", "*.p12", "*.pfx", "*.db", "*.sqlite*", "*.pyc", ".DS_Store",
)
SECRET_PATTERNS = (
    r"-----BEGIN (?:[A-Z0-9 ]+ )?PRIVATE KEY-----",
    r"\b(?:sk-(?:proj-|ant-)?[A-Za-z0-9_-]{20,}|AKIA[A-Z0-9]{16})\b",
    r"\b(?:ghp_|github_pat_)[A-Za-z0-9_]{20,}\b",
    r"\bxox[baprs]-[A-Za-z0-9-]{20,}\b",
    r"(?im)^\s*(?:-\s*)?(?:spring\.datasource\.password|datasource\.password|DB_PASSWORD|POSTGRES_PASSWORD|MYSQL_PASSWORD|MYSQL_ROOT_PASSWORD|password)\s*[=:]\s*(?!['\"]?\$\{)['\"]?[^'\"\s#]+",
    r"\b(?:postgres(?:ql)?(?:\+[A-Za-z0-9_]+)?|mysql(?:\+[A-Za-z0-9_]+)?)://[^/\s:@]+:(?!\$\{)[^@\s/]+@",
    r"\$\{[A-Za-z_][A-Za-z0-9_]*PASSWORD[A-Za-z0-9_]*:[^}]+\}",
)
LANGUAGES = {
    ".py": "python", ".pyi": "python", ".java": "java", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript",
    ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".swift": "swift", ".rs": "rust", ".vue": "vue",
}
STRUCTURE_LANGUAGES = ("python", "java", "typescript", "javascript")
VALUE_FLOW_LANGUAGES = ("python", "java")


def glob_regex(pattern: str) -> str:
    """A glob over one path segment as an anchored regular expression."""
    table = {"*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(table.get(c, re.escape(c)) for c in pattern) + "$"


def valid_path(path: Column) -> Column:
    """A normalised relative POSIX path of at most 1024 characters."""
    return (
        path.isNotNull() & (path != "") & (F.char_length(path) <= 1024)
        & ~path.rlike(r"[\\:\x00-\x1f\x7f]") & ~path.rlike(r"^/|//|/$|(^|/)\.{1,2}(/|$)")
    )


def excluded_path(path: Column) -> Column:
    """True if any segment is an excluded folder or name, whatever its case."""
    parts = F.split(F.lower(path), "/")
    names = "|".join(glob_regex(p.lower()) for p in EXCLUDED_NAMES)
    return F.arrays_overlap(parts, F.array(*map(F.lit, EXCLUDED_DIRS))) | F.exists(parts, lambda p: p.rlike(names))


def content_problem(content: Column) -> Column:
    """Why a text is not admitted, or null."""
    secret = F.lit(False)
    for pattern in SECRET_PATTERNS:
        secret |= content.rlike(pattern)
    return (
        F.when(F.octet_length(content) > MAX_FILE_BYTES, F.lit(f"file exceeds {MAX_FILE_BYTES} bytes"))
        .when(F.instr(content, "\0") > 0, F.lit("binary content"))
        .when(secret, F.lit("possible credential or private key"))
    )


def language(path: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.coalesce(table[suffix(path)], F.lit("unsupported"))


def structure_language(path: Column) -> Column:
    found = language(path)
    return F.when(found.isin(*STRUCTURE_LANGUAGES), found).otherwise(F.lit("unsupported"))

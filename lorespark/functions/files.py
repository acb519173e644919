"""What a path says about a file."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text

# Suffixes of code and of documents.
CODE = [
    ".py", ".pyi", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".go", ".rs", ".java", ".kt", ".kts", ".scala", ".c", ".h", ".cpp", ".cc", ".hpp",
    ".cs", ".rb", ".php", ".swift", ".m", ".sh", ".bash", ".zsh", ".ps1", ".sql", ".lua", ".pl", ".r",
]
DOCUMENT = [
    ".pdf", ".doc", ".docx", ".ppt", ".pptx", ".xls", ".xlsx", ".md", ".markdown", ".txt", ".rst", ".csv", ".html", ".htm", ".odt", ".rtf", ".eml",
    ".ods", ".odp", ".epub", ".png", ".jpg", ".jpeg", ".tif", ".tiff",
]
# Languages and document formats by suffix.
LANGUAGE = {".py": "python", ".pyi": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".mts": "typescript", ".cts": "typescript", ".tsx": "tsx", ".go": "go", ".rs": "rust", ".java": "java", ".cs": "csharp"}
FORMAT = {".pdf": "pdf", ".docx": "docx", ".pptx": "pptx", ".xlsx": "xlsx", ".html": "html", ".htm": "html", ".md": "markdown", ".markdown": "markdown", ".txt": "txt", ".eml": "eml", ".csv": "csv", ".odt": "odt", ".ods": "ods", ".odp": "odp", ".epub": "epub", ".png": "image", ".jpg": "image", ".jpeg": "image", ".tif": "image", ".tiff": "image"}
# Folders never scanned, and names of secret files (shell globs).
SKIPPED_FOLDERS = [
    ".git", "node_modules", "bin", "obj", "dist", "build", "target", ".venv", "venv", "vendor", "coverage", ".cache", ".next", ".idea", ".vscode",
]
SECRET_NAMES = [
    ".env", ".env.*", "*.pem", "*.key", "id_rsa", "id_ed25519", "credentials*", "secrets*",
]


def glob_pattern(glob: str) -> str:
    """A shell glob (``*``, ``?``, ``[seq]``, ``[!seq]``) as an anchored regular expression."""
    out, i = "^", 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2) if c == "[" else -1
        if c == "[" and end > 0:
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            i = end
        else:
            out += {"*": "(?s:.*)", "?": "(?s:.)"}.get(c) or ("\\" + c if not c.isalnum() and c != "_" else c)
        i += 1
    return out + "$"


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def kind(path: Column) -> Column:
    s = text.suffix(path)
    return F.when(s.isin(CODE), "code").when(s.isin(DOCUMENT), "document").otherwise("unknown")


def language(path: Column) -> Column:
    return _lookup(LANGUAGE, text.suffix(path))


def document_format(path: Column) -> Column:
    return _lookup(FORMAT, text.suffix(path))


def is_secret(path: Column) -> Column:
    return text.file_name(path).rlike("|".join(glob_pattern(g) for g in SECRET_NAMES))


def in_skipped_folder(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*(F.lit(x) for x in SKIPPED_FOLDERS)))


def matches(path: Column, patterns: list[str]) -> Column:
    """Any of the ignore-file patterns: with a slash over the whole path, else over the name; one that ends in a slash is for folders only."""
    hit = F.lit(False)
    for p in patterns:
        if p.endswith("/"):
            continue
        hit = hit | (path.rlike(glob_pattern(p.lstrip("/"))) if "/" in p else text.file_name(path).rlike(glob_pattern(p)))
    return hit


def is_ignored(path: Column, patterns: list[str] = (), include: list[str] = ()) -> Column:
    named = matches(path, [*patterns])
    if include:
        named = named & ~matches(path, [*include])
    return in_skipped_folder(path) | is_secret(path) | named


def normalized(path: Column) -> Column:
    """A path with forward slashes, without empty and ``.`` segments, each ``..`` undone with the segment before it; beyond the top it is dropped.  A slash in front stays."""
    clean = F.replace(path, F.lit("\\"), F.lit("/"))
    up = lambda done: F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
    parts = F.aggregate(F.split(clean, "/"), F.array().cast("array<string>"), lambda done, x: F.when(x == "..", up(done)).when(x.isin("", "."), done).otherwise(F.concat(done, F.array(x))))
    return F.concat(F.when(F.startswith(clean, F.lit("/")), "/").otherwise(""), F.array_join(parts, "/"))


def folders_above(path: Column | str) -> Column:
    """A normalised path and every folder above it."""
    c = F.col(path) if isinstance(path, str) else path
    parts = F.split(c, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def is_test(path: Column) -> Column:
    """Test files by the naming rules of their languages."""
    name = text.file_name(F.regexp_replace(path, r"\\", "/"))
    return name.rlike(r"^test_.+\.py$|^.+_test\.(py|go)$|^.+Tests?\.(cs|java)$|^.+\.(test|spec)\.(js|jsx|ts|tsx)$")

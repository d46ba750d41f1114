"""Lists and limits that results depend on."""

from __future__ import annotations

# Language of each extension.
LANGUAGE_OF = {
    ".py": "python",
    ".pyi": "python",
    ".ts": "typescript",
    ".tsx": "tsx",
    ".js": "javascript",
    ".jsx": "javascript",
    ".mjs": "javascript",
    ".cjs": "javascript",
    ".rs": "rust",
    ".go": "go",
    ".java": "java",
    ".kt": "kotlin",
    ".kts": "kotlin",
    ".c": "c",
    ".h": "c",
    ".cpp": "cpp",
    ".cc": "cpp",
    ".hpp": "cpp",
    ".cs": "c_sharp",
    ".rb": "ruby",
    ".php": "php",
    ".swift": "swift",
    ".scala": "scala",
    ".lua": "lua",
    ".sh": "bash",
    ".bash": "bash",
    ".sql": "sql",
    ".html": "html",
    ".css": "css",
    ".json": "json",
    ".yaml": "yaml",
    ".yml": "yaml",
    ".toml": "toml",
    ".md": "markdown",
}

# Further extensions that are indexed as text.
TEXT_EXTENSIONS = (
    *LANGUAGE_OF,
    ".txt", ".cfg", ".ini", ".env", ".dockerfile",
    ".xml", ".gitignore", ".jsonc", ".mdx",
    ".gradle", ".properties", ".proto", ".avsc", ".graphql", ".graphqls",
    ".feature", ".http", ".conf", ".hocon", ".dockerignore",
)
TEXT_NAMES = ("dockerfile", "makefile")

# Folders, names and parts of paths that are never indexed.
IGNORED_FOLDERS = (
    ".git", ".hg", ".svn",
    "node_modules", ".venv", "venv", "env", "__pycache__",
    ".mypy_cache", ".pytest_cache", ".ruff_cache",
    "dist", "out", "coverage",
    "build", "target", ".gradle", "gradle",
    "bin", "obj", ".settings",
    ".idea", ".vscode", ".cache", ".turbo", ".next",
    "graphify-out",
)
KEPT_DOT_FOLDERS = (".github", ".mvn")
IGNORED_NAMES = (
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "npm-shrinkwrap.json",
    "poetry.lock", "uv.lock", "pdm.lock", "cargo.lock", "composer.lock",
    "gemfile.lock", "go.sum",
)
MINIFIED_PARTS = (".min.js", ".min.css", ".bundle.js", ".map")
IGNORED_PARTS = ("docs/i18n/", "/i18n/", "/translated-changelogs/", "/locales/", "/translations/")

# Limits.
DOC_EXTENSIONS = (".md", ".mdx", ".txt", ".rst")
MAX_DOC_BYTES = 131_072
MAX_FILE_BYTES = 1_500_000
MAX_LINE_CHARS = 5_000
BINARY_PROBE_BYTES = 4_096
WINDOW_LINES, OVERLAP_LINES = 60, 15
PREVIEW_CHARS = 400
BM25_K1, BM25_B, BM25_LEAST_IDF = 1.2, 0.75, 1e-6
NEAR_DEFAULT = 10
OVERFETCH = 8

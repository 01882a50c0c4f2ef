"""Defaults and fixed values shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    chunk_size: int = 500
    chunk_overlap: int = 50
    top_k_vector: int = 10
    top_k_keyword: int = 10
    rrf_k: int = 60
    top_k: int = 5
    max_top_k: int = 20
    neighbours: int = 2
    max_tokens: int = 512
    embedding_dim: int = 64


DEFAULTS = Settings()

# ---- fixed values -------------------------------------------------------

DOC_EXTENSIONS = (".rst", ".md", ".mdx")
MAX_FILE_BYTES = 1024 * 1024
NON_DOC_NAMES = ("Makefile", "requirements.txt", "setup.py", "conf.py")

CORPUS_EXCLUDED_DIRS = (
    "/examples/",
    "/test/",
    "/tests/",
    "/__pycache__/",
    "/node_modules/",
    "/build/",
    "/dist/",
    "/.git/",
)

API_ROOT = "pytorch-docs/"
API_EXTENSIONS = (".rst", ".md")
API_EXCLUDED_PARTS = ("/cpp/", "/libtorch", "/cuda", "/cpu", "/cudnn")

FOCUSED_GLOBS = (
    "**/data.rst",
    "**/nn.rst",
    "**/distributed.rst",
    "**/ddp.rst",
    "**/tutorials/**/*data*.rst",
    "**/tutorials/**/*distributed*.rst",
    "**/tracking*.mdx",
    "**/model-registry*.mdx",
    "**/models*.mdx",
    "**/getting-started*.mdx",
    "**/serve/**/*getting-started*.rst",
    "**/serve/**/*key-concepts*.rst",
    "**/serve/**/*production*.rst",
    "**/serve/**/*deployment*.rst",
)

BROAD_KEYWORDS = (
    "api",
    "reference",
    "guide",
    "tutorial",
    "example",
    "function",
    "class",
    "method",
    "parameter",
    "return",
    "usage",
    "installation",
    "configuration",
    "training",
    "model",
    "dataset",
    "pipeline",
)
BROAD_MIN_KEYWORDS = 3
FOCUSED_KEYWORDS = ("api", "tutorial", "guide", "example", "reference", "documentation")
MIN_PAGE_CHARS = 500
MIN_CONTENT_CHARS = 200

BROAD_BOILERPLATE = ("script", "style", "nav", "footer", "header")
FOCUSED_BOILERPLATE = ("script", "style", "nav", "footer", "header", "aside")
FOCUSED_BOILERPLATE_CLASSES = ("nav", "sidebar", "menu", "footer", "header", "breadcrumb")
FOCUSED_MAIN_CLASSES = ("content", "main", "documentation")

# (words looked for in the query, text looked for in source_url, bonus)
BOOST_RULES = (
    (("pytorch", "torch", "dataloader"), "pytorch-docs", 0.02),
    (("mlflow",), "mlflow-docs", 0.02),
)

QUERY_PREFIX = "search_query: "
DOCUMENT_PREFIX = "search_document: "

VECTOR_DIM = 768
BYTES_PER_FLOAT = 4
FREE_TIER_MB = 1024
CHUNK_COUNT_WARNING = 300_000
WORDS_PER_CHUNK = 200

RATE_LIMIT_REQUESTS = 60
RATE_LIMIT_WINDOW_SECONDS = 60

BM25_K1 = 1.2
BM25_B = 0.75
BM25_MIN_IDF = 1e-6

# ---- end of fixed values ------------------------------------------------

"""Parameters with their defaults, checked when made."""

from __future__ import annotations

from dataclasses import dataclass, replace

from millrace.errors import require
from millrace.schemas import ITEM_TYPES


@dataclass(frozen=True)
class WindowChunking:
    """Fixed windows of size code points, each overlapping the next."""

    size: int = 1000
    overlap: int = 100

    def __post_init__(self):
        require(self.size > 0 and 0 <= self.overlap < self.size, "DOCUMENT_CHUNK_CONFIG_INVALID", "size > 0 and 0 <= overlap < size are needed", size=self.size, overlap=self.overlap)

    @property
    def step(self) -> int:
        return self.size - self.overlap


@dataclass(frozen=True)
class BlockChunking:
    """Section-aware packing of blocks."""

    max_chars: int = 1000
    min_chars: int = 200
    overlap: int = 100
    max_table_chars: int = 4000
    keep_table_intact: bool = True
    keep_formula_with_context: bool = True
    include_headers_footers: bool = False

    def __post_init__(self):
        ok = self.max_chars > 0 and 0 <= self.min_chars <= self.max_chars and 0 <= self.overlap < self.max_chars and self.max_table_chars > 0
        require(ok, "DOCUMENT_CHUNK_CONFIG_INVALID", "0 <= min <= max, 0 <= overlap < max and a positive table limit are needed")


@dataclass(frozen=True)
class Embedding:
    model: str = "Qwen3-Embedding-0.6B"
    dim: int = 1024
    batch: int = 8
    normalize: bool = True

    def __post_init__(self):
        require(bool(self.model.strip()) and self.dim > 0 and self.batch > 0, "EMBEDDING_CONFIG_INVALID", "a model name and positive dim and batch are needed")


@dataclass(frozen=True)
class Hybrid:
    """Weighted reciprocal-rank fusion of a keyword and a vector list."""

    limit: int = 10
    keyword_weight: float = 0.5
    vector_weight: float = 0.5
    rrf_k: int = 60
    keyword_top_k: int = 50
    vector_top_k: int = 50
    max_limit: int = 50

    def __post_init__(self):
        bad = "HYBRID_SEARCH_CONFIG_INVALID"
        require(1 <= self.limit <= self.max_limit, bad, f"limit must be 1 to {self.max_limit}", limit=self.limit)
        require(self.rrf_k > 0, bad, "rrf_k must be positive")
        require(self.keyword_weight >= 0 and self.vector_weight >= 0 and self.keyword_weight + self.vector_weight > 0, bad, "weights must be at least 0 and not both 0")
        require(min(self.keyword_top_k, self.vector_top_k) >= self.limit, bad, "both top k must reach the limit")


@dataclass(frozen=True)
class Bm25:
    k1: float = 1.2
    b: float = 0.75


@dataclass(frozen=True)
class Rag:
    top_k: int = 8
    max_chars: int = 12_000
    no_context_message: str = "当前知识库中未检索到足够依据，无法可靠回答该问题。"

    def __post_init__(self):
        require(self.top_k > 0 and self.max_chars >= 0, "RAG_CONFIG_INVALID", "top_k must be positive and max_chars at least 0")


@dataclass(frozen=True)
class Extraction:
    """How many chunks, and how many of their characters, one extraction may read."""

    max_chunks: int = 20
    max_chars: int = 12_000
    most_chunks: int = 50
    mode: str = "document"
    item_types: tuple[str, ...] | None = None
    default_status: str = "draft"

    def __post_init__(self):
        bad = "KNOWLEDGE_ITEM_CONFIG_INVALID"
        require(1 <= self.max_chunks <= self.most_chunks and self.max_chars > 0, bad, "max_chunks must be 1 to the cap and max_chars positive")
        require(self.mode.strip().lower() in ("document", "chunks"), bad, "mode must be document or chunks", mode=self.mode)
        require(self.item_types is None or (bool(self.item_types) and set(self.item_types) <= set(ITEM_TYPES)), bad, "item_types must be known, and one at least", item_types=self.item_types)
        require(self.default_status.strip().lower() == "draft", bad, "extracted items start as drafts", default_status=self.default_status)

    def with_max_chunks(self, asked: int | None) -> Extraction:
        """The settings for a request that asks for fewer chunks."""
        require(asked is None or 1 <= asked <= self.max_chunks, "KNOWLEDGE_ITEM_CONFIG_INVALID", "max_chunks must be 1 to the configured number", max_chunks=asked)
        return self if asked is None else replace(self, max_chunks=asked)


#: What may be uploaded.
UPLOAD_EXTENSIONS = (".pdf", ".doc", ".docx", ".xls", ".xlsx", ".png", ".jpg", ".jpeg", ".bmp", ".tif", ".tiff", ".webp", ".txt", ".md", ".csv")
UPLOAD_MAX_BYTES = 52_428_800

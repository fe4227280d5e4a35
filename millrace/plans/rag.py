"""Question answering and extraction around injected language-model providers."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.config import Extraction, Hybrid, Rag
from millrace.errors import require
from millrace.operators.context import citations, formatted_context, pack_context, system_prompt, user_prompt
from millrace.operators.knowledge import chunk_selection, validate_extractions
from millrace.operators.retrieval import hybrid_search

ROLES = ("system", "user", "assistant", "tool")


@dataclass(frozen=True)
class Message:
    role: str
    content: str

    def __post_init__(self):
        require(self.role in ROLES, "LLM_REQUEST_INVALID", "unknown role", role=self.role)


@dataclass(frozen=True)
class Request:
    messages: tuple[Message, ...]
    temperature: float = 0.0
    json_mode: bool = False

    def __post_init__(self):
        require(bool(self.messages), "LLM_REQUEST_INVALID", "a message is needed")
        require(0 <= self.temperature <= 2, "LLM_REQUEST_INVALID", "temperature must be 0 to 2")


class LanguageModel(Protocol):
    def generate(self, request: Request) -> str: ...


def generated(model: LanguageModel, request: Request) -> str:
    """The model's answer: not blank and, in JSON mode, which a model may say that it lacks (json_mode = False), JSON."""
    require(not request.json_mode or getattr(model, "json_mode", True), "LLM_PARAMETER_UNSUPPORTED", "the model has no JSON mode")
    answer = model.generate(request)
    require(bool(answer and answer.strip()), "LLM_EMPTY_CONTENT", "the model said nothing")
    if request.json_mode:
        try:
            json.loads(answer)
        except ValueError:
            require(False, "LLM_JSON_INVALID", "the answer is not JSON")
    return answer


@dataclass
class EchoModel:
    """A deterministic stand-in: answers with a fixed text and remembers what it was asked."""

    answer: str = "[1]"
    asked: list[Request] = field(default_factory=list)

    def generate(self, request: Request) -> str:
        self.asked.append(request)
        return self.answer


def contexts(docs: DataFrame, vectors: DataFrame, queries: DataFrame, hybrid: Hybrid, rag: Rag, id_col: str = "doc_id", text_col: str = "text", name_col: str = "source") -> DataFrame:
    """Packed contexts of all queries (query_id, text, embedding), as pack_context() gives them."""
    hits = hybrid_search(docs, vectors, queries, hybrid, id_col, text_col)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("content"), F.col(name_col).alias("original_filename"))
    items = hits.join(texts, "id").select("query_id", "position", F.col("id").cast("string").alias("chunk_id"), F.col("id").cast("string").alias("document_id"), F.lit(0).alias("chunk_index"), "original_filename", "retrieval_source", "hybrid_score", "content")
    return pack_context(items, rag)


def prompts(packed: DataFrame, queries: DataFrame) -> DataFrame:
    """Rows (query_id, context_status, prompt, total_chars), a row for each query."""
    held = queries.select("query_id", "text").join(formatted_context(packed), "query_id", "left")
    status = F.when(F.col("context").isNull(), "no_context").otherwise("ok")
    return held.select("query_id", status.alias("context_status"), user_prompt(F.col("text"), F.coalesce("context", F.lit(""))).alias("prompt"), F.coalesce("total_chars", F.lit(0)).alias("total_chars"))


def ask(model: LanguageModel, prompt_rows: DataFrame, packed: DataFrame, query_id, rag: Rag = Rag()) -> dict:
    """The answer to one query with its citations. Without context the model isn't called."""
    row = prompt_rows.where(F.col("query_id") == query_id).first()
    require(row is not None, "RAG_QUERY_EMPTY", "no such query")
    if row.context_status == "no_context":
        return {"answer": rag.no_context_message, "context_status": "no_context", "citations": []}
    answer = generated(model, Request((Message("system", system_prompt(rag)), Message("user", row.prompt))))
    cited = citations(packed.where(F.col("query_id") == query_id)).orderBy("citation_id").limit(rag.top_k)
    return {"answer": answer, "context_status": "ok", "citations": [r.asDict() for r in cited.toLocalIterator()]}


def extraction_inputs(chunks: DataFrame, settings: Extraction = Extraction()) -> DataFrame:
    """The chunks that one extraction of a document reads; documents over the character budget give none."""
    return chunk_selection(chunks, settings.max_chunks, settings.max_chars).where(~F.col("over_budget")).drop("over_budget")


def extracted(outputs: DataFrame) -> DataFrame:
    """Validated items of model outputs, a row each."""
    good = validate_extractions(outputs).where("error is null")
    return good.select("*", F.posexplode("items").alias("position", "item")).drop("items")

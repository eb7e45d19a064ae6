"""Settings from the environment, a ``.env`` file or defaults, with typed values and checks."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, fields
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    """Sizes, limits and weights; names in the environment are these in capitals."""

    chunking_strategy: str = "F"
    chunk_size: int = 800
    chunk_overlap: int = 150
    semantic_min_chunk_size: int = 250
    semantic_max_chunk_size: int = 1200
    retriever_top_k: int = 10
    retriever_dense_top_k: int = 30
    retriever_bm25_top_k: int = 30
    retriever_rerank_top_k: int = 20
    retriever_ranking_mode: str = "reranker_entity_rrf"
    retriever_source_cap: int = 2
    retriever_min_relevance: float = 0.25
    per_query_token_limit: int = 10_000
    daily_token_limit: int = 1_000_000
    tool_timeout_seconds: float = 30.0
    local_retrieval_timeout_seconds: float = 60.0
    total_pipeline_timeout_seconds: float = 120.0
    retriever_entity_guard: bool = True

    def problems(self) -> list[str]:
        """What is out of bounds, and nested timeouts that can't take effect; empty if all is well."""
        checks = [
            (self.chunking_strategy not in ("F", "R", "P", "V"), "chunking_strategy must be F, R, P or V"),
            (self.chunk_size <= 0 or not 0 <= self.chunk_overlap < self.chunk_size, "chunk_overlap must be at least 0 and below chunk_size"),
            (not 0 < self.semantic_min_chunk_size <= self.semantic_max_chunk_size, "semantic chunk sizes are out of order"),
            (min(self.retriever_top_k, self.retriever_dense_top_k, self.retriever_bm25_top_k, self.retriever_rerank_top_k) <= 0, "numbers of results must be positive"),
            (self.retriever_ranking_mode not in ("reranker_only", "reranker_entity", "reranker_entity_rrf"), "retriever_ranking_mode is unknown"),
            (self.local_retrieval_timeout_seconds > self.total_pipeline_timeout_seconds, "local_retrieval_timeout_seconds exceeds total_pipeline_timeout_seconds"),
            (self.tool_timeout_seconds > self.total_pipeline_timeout_seconds, "tool_timeout_seconds exceeds total_pipeline_timeout_seconds"),
        ]
        return [said for bad, said in checks if bad]


def _boolean(text: str) -> bool:
    return text.strip().lower() in ("1", "true", "yes", "on")


def read_env(path: str | Path) -> dict[str, str]:
    """``NAME=value`` lines of a file; comments, blank lines and quotes around values are dropped. A missing file is empty."""
    if not Path(path).is_file():
        return {}
    pairs = (line.split("=", 1) for line in Path(path).read_text(encoding="utf-8-sig").splitlines() if "=" in line and not line.lstrip().startswith("#"))
    return {k.strip().removeprefix("export ").strip(): v.strip().strip("'\"") for k, v in pairs}


def load(env_file: str | Path = ".env", environ: Mapping[str, str] | None = None) -> Settings:
    """The environment wins over the file, the file over defaults; a value of the wrong type fails with its name."""
    given = read_env(env_file) | dict(os.environ if environ is None else environ)
    parse: dict[str, Callable] = {"int": int, "float": float, "bool": _boolean, "str": str}
    values = {}
    for f in fields(Settings):
        if f.name.upper() in given:
            try:
                values[f.name] = parse[f.type](given[f.name.upper()])
            except ValueError as e:
                raise ValueError(f"{f.name.upper()} is not of type {f.type}") from e
    return Settings(**values)


@dataclass
class Tool:
    """A named function with typed parameters, for expressions by name."""

    name: str
    call: Callable
    parameters: dict[str, type] = field(default_factory=dict)
    returns: str = "string"


class Registry:
    """Tools by name; disabled ones and wrong arguments are refused before a call."""

    def __init__(self, disabled: tuple[str, ...] = ()):
        self.tools: dict[str, Tool] = {}
        self.disabled = set(disabled)

    def add(self, tool: Tool) -> Tool:
        if tool.name in self.tools:
            raise ValueError(f"{tool.name} is registered already")
        self.tools[tool.name] = tool
        return tool

    def call(self, name: str, retries: int = 0, **given):
        if name not in self.tools or name in self.disabled:
            raise KeyError(f"{name} is unknown or disabled")
        tool = self.tools[name]
        wrong = [k for k, kind in tool.parameters.items() if not isinstance(given.get(k), kind)] + [k for k in given if k not in tool.parameters]
        if wrong:
            raise TypeError(f"{name}: {', '.join(sorted(wrong))}")
        for left in range(retries, -1, -1):
            try:
                return tool.call(**given)
            except Exception:
                if not left:
                    raise

    def register_sql(self, spark, name: str) -> None:
        """Make a tool an SQL function."""
        spark.udf.register(name, self.tools[name].call, self.tools[name].returns)

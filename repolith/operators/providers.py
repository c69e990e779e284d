"""Model providers behind one call, and the interfaces that hosts and stores offer.

A provider is a way to write a request and to read a reply; the transport that
carries it is given, so that tests need no network. Calls come from the
executors through `generation.generate`, which never fails a job for a failed call.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame

#: Sends a body to an address with headers and gives the reply's text.
Transport = Callable[[str, dict[str, str], bytes], str]


def post(url: str, headers: dict[str, str], body: bytes, timeout: float = 120.0) -> str:
    """The reply to a POST request."""
    with urllib.request.urlopen(urllib.request.Request(url, data=body, headers=headers, method="POST"), timeout=timeout) as reply:  # noqa: S310
        return reply.read().decode()


@dataclass(frozen=True)
class Provider:
    """How one kind of service is asked: its address, the header of its key, and the shapes of request and reply."""

    url: str
    key_header: str | None
    key_prefix: str
    request: Callable[[str, str, str, dict, float], dict]
    reply: Callable[[dict], str]


def _chat(model: str, system: str, user: str, schema: dict, temperature: float) -> dict:
    return {"model": model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}], "temperature": temperature, "response_format": {"type": "json_schema", "json_schema": {"name": "answer", "schema": schema}}}


def _local(model: str, system: str, user: str, schema: dict, temperature: float) -> dict:
    return {"model": model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}], "stream": False, "format": schema, "options": {"temperature": temperature}}


def _contents(model: str, system: str, user: str, schema: dict, temperature: float) -> dict:
    return {"contents": [{"parts": [{"text": f"{system}\n\n{user}"}]}], "generationConfig": {"responseMimeType": "application/json", "responseSchema": schema, "temperature": temperature}}


def _messages(model: str, system: str, user: str, schema: dict, temperature: float) -> dict:
    return {"model": model, "max_tokens": 4096, "system": system, "messages": [{"role": "user", "content": user}], "temperature": temperature, "tools": [{"name": "answer", "input_schema": schema}], "tool_choice": {"type": "tool", "name": "answer"}}


PROVIDERS = {
    "openai": Provider("https://api.openai.com/v1/chat/completions", "Authorization", "Bearer ", _chat, lambda r: r["choices"][0]["message"]["content"]),
    "grok": Provider("https://api.x.ai/v1/chat/completions", "Authorization", "Bearer ", _chat, lambda r: r["choices"][0]["message"]["content"]),
    "gemini": Provider("https://generativelanguage.googleapis.com/v1beta/models/{model}:generateContent", "x-goog-api-key", "", _contents, lambda r: r["candidates"][0]["content"]["parts"][0]["text"]),
    "anthropic": Provider("https://api.anthropic.com/v1/messages", "x-api-key", "", _messages, lambda r: json.dumps(next(b["input"] for b in r["content"] if b["type"] == "tool_use"))),
    "ollama": Provider("http://127.0.0.1:11434/api/chat", None, "", _local, lambda r: r["message"]["content"]),
}


class ProviderError(RuntimeError):
    """An unknown provider, a missing key, or a reply without an answer."""


def provider_call(name: str, model: str, schemas: dict[str, dict], key: str | None = None, temperature: float = 0.2, transport: Transport = post) -> Callable[[str, str, str], str]:
    """A call for `generation.generate` through the provider of a name; schemas: JSON schemas by name. The answer is JSON that has the schema's required fields."""
    if name not in PROVIDERS:
        raise ProviderError(f"unknown provider {name}")
    p = PROVIDERS[name]
    if p.key_header and not key:
        raise ProviderError(f"{name} needs a key")
    headers = {"Content-Type": "application/json"} | ({p.key_header: p.key_prefix + key} if p.key_header else {}) | ({"anthropic-version": "2023-06-01"} if name == "anthropic" else {})

    def call(system: str, user: str, schema: str) -> str:
        wanted = schemas.get(schema, {"type": "object"})
        reply = json.loads(transport(p.url.format(model=model), headers, json.dumps(p.request(model, system, user, wanted, temperature)).encode()))
        try:
            answer = p.reply(reply)
            missing = [f for f in wanted.get("required", []) if f not in json.loads(answer)]
        except (KeyError, IndexError, StopIteration, ValueError, TypeError) as e:
            raise ProviderError(f"{name} gave no answer") from e
        if missing:
            raise ProviderError(f"{name} left out {', '.join(missing)}")
        return answer

    return call


class Indexer(Protocol):
    """Builds an index of chunks, and replaces chunks of it by their key."""

    def build(self, chunks: DataFrame) -> DataFrame: ...
    def update(self, index: DataFrame, chunks: DataFrame) -> DataFrame: ...


class ChunkSource(Protocol):
    """Gives stored chunks."""

    def chunks(self) -> DataFrame: ...


class ChunkSink(Protocol):
    """Takes chunks, and writes what describes them at last."""

    def add(self, chunks: DataFrame) -> None: ...
    def finalize(self) -> DataFrame: ...


class Retriever(Protocol):
    """Finds the k best chunks of questions, with scores."""

    def search(self, questions: DataFrame, k: int = 6) -> DataFrame: ...


class RepoHostClient(Protocol):
    """A host of code reviews."""

    def fetch_change_metadata(self, change_id: str) -> dict[str, object]: ...
    def fetch_diff(self, change_id: str) -> str: ...
    def publish_review_comment(self, change_id: str, body: str) -> None: ...


class IssueTrackerClient(Protocol):
    """A tracker of issues."""

    def fetch_issue(self, issue_id: str) -> dict[str, object]: ...


class CiLogClient(Protocol):
    """A service that runs jobs."""

    def fetch_job_log(self, job_id: str) -> str: ...
    def download_artifact(self, job_id: str, artifact_name: str, target: str) -> str: ...


class LexicalIndex:
    """Index and retriever over one table of chunks, by BM25."""

    def __init__(self, chunks: DataFrame | None = None) -> None:
        self.index = None if chunks is None else self.build(chunks)

    def build(self, chunks: DataFrame) -> DataFrame:
        """The index of chunks."""
        from repolith.operators import retrieval

        self.index = retrieval.indexed(chunks)
        return self.index

    def update(self, index: DataFrame, chunks: DataFrame) -> DataFrame:
        """The index with chunks in place of those of the same key."""
        from repolith.operators import retrieval

        self.index = retrieval.upsert(index, retrieval.indexed(chunks), ["csc_id", "chunk_id"])
        return self.index

    def search(self, questions: DataFrame, k: int = 6) -> DataFrame:
        """The k best chunks of each question."""
        from repolith.operators import retrieval

        return retrieval.top_k(self.index, questions, k)

"""Models behind small protocols: HTTP backends, and deterministic offline ones."""

from __future__ import annotations

import json
import re
import time
import urllib.request
import zlib
from dataclasses import dataclass
from functools import lru_cache
from typing import Protocol

import numpy as np


class EmbeddingProvider(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...
    def ping(self) -> bool: ...


class ChatProvider(Protocol):
    def chat(self, messages: list[dict], temperature: float, max_tokens: int) -> str: ...


class ModelError(RuntimeError):
    pass


def post(url: str, body: dict, headers: dict | None = None, timeout: float = 120, tries: int = 1, pause: float = 0.5) -> dict:
    """The JSON that a POST gives. What may pass (no connection, a full or failing service) is tried again after a pause that doubles."""
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **(headers or {})})
    for left in reversed(range(tries)):
        try:
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                if answer.status != 200:
                    raise ModelError(f"{url}: status {answer.status}")
                return json.loads(answer.read())
        except (OSError, ValueError) as e:
            status = getattr(e, "code", None)
            passing = isinstance(e, OSError) and (status is None or status == 429 or status >= 500)
            if not left or not passing:
                raise ModelError(f"{url}: {e}") from e
            time.sleep(pause)
            pause *= 2
    raise ModelError(f"{url}: not tried")


@lru_cache(1 << 16)
def _crc(word: str) -> int:
    return zlib.crc32(word.encode())


@dataclass
class HashingEmbedder:
    """Feature hashing of words: offline and the same everywhere."""

    dims: int = 384

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dims), np.float64)
        for row, t in zip(out, texts, strict=True):
            hashes = np.array([_crc(w) for w in re.findall(r"\w+", t.lower())], np.int64)
            row += np.bincount(hashes % self.dims, np.where(hashes >> 31, 1.0, -1.0), self.dims)
        norms = np.sqrt((out**2).sum(axis=1, keepdims=True))
        return (out / np.where(norms > 0, norms, 1)).astype(np.float32).tolist()

    def ping(self) -> bool:
        return True


@dataclass
class HttpEmbedder:
    """POST {host}/api/embed with {model, input}; takes `embeddings`. Tried `tries` times."""

    host: str
    model: str
    tries: int = 4

    def embed(self, texts: list[str]) -> list[list[float]]:
        got = post(f"{self.host}/api/embed", {"model": self.model, "input": texts}, tries=self.tries).get("embeddings") or []
        if len(got) != len(texts):
            raise ModelError("the model returned no embedding")
        return got

    def ping(self) -> bool:
        try:
            with urllib.request.urlopen(f"{self.host}/api/tags", timeout=5) as answer:
                return answer.status == 200
        except OSError:
            return False


def model_name(provider) -> str:
    """What tells a model's vectors from another's: its own `name`, or its class and fields."""
    return getattr(provider, "name", None) or re.sub(r"tries=\d+|[^\w.:-]+", "_", repr(provider))


def wait_for(ping, timeout: float, every: float = 1.0) -> bool:
    """Poll until ping() holds or the time is over."""
    end = time.monotonic() + timeout
    while not ping():
        if time.monotonic() >= end:
            return False
        time.sleep(every)
    return True


@dataclass
class LocalChat:
    """Chat of a local model host, not streamed and without thinking."""

    host: str
    model: str

    def chat(self, messages: list[dict], temperature: float, max_tokens: int) -> str:
        body = {"model": self.model, "messages": messages, "stream": False, "think": False, "options": {"temperature": temperature, "num_predict": max_tokens}}
        return post(f"{self.host}/api/chat", body).get("message", {}).get("content", "")


@dataclass
class RemoteChat:
    """Chat-completions of a remote service. A temperature of zero is left out, so the service's default holds."""

    url: str
    key: str
    model: str

    def chat(self, messages: list[dict], temperature: float, max_tokens: int) -> str:
        if not self.key or not self.model:
            raise ModelError("the remote chat needs a key and a model")
        body = {"model": self.model, "messages": messages, "max_tokens": max_tokens} | ({"temperature": temperature} if temperature else {})
        choices = post(self.url, body, {"Authorization": f"Bearer {self.key}"}).get("choices") or []
        if not choices:
            raise ModelError("the model returned no choice")
        return choices[0].get("message", {}).get("content", "")


@dataclass
class ExtractiveChat:
    """Offline: an answer is the first source's first sentence with its citation; other requests give nothing."""

    def chat(self, messages: list[dict], temperature: float, max_tokens: int) -> str:
        m = re.search(r"\[Fonte (\d+): [^\]]*\]\n(.+)", messages[-1]["content"])
        return f"{m[2].split('. ')[0]} [Fonte {m[1]}]" if m else ""


def chat_provider(backend: str, host: str = "", key: str = "", model: str = "") -> ChatProvider | None:
    """`remote` goes to the remote service, `offline` to the extractive chat, `none` nowhere, anything else to the local host."""
    backend = backend.strip().lower()
    if backend == "none":
        return None
    if backend == "offline":
        return ExtractiveChat()
    return RemoteChat(host, key, model) if backend == "remote" else LocalChat(host, model)


def embedding_provider(model: str, dims: int, host: str) -> EmbeddingProvider:
    return HashingEmbedder(dims) if model == "hashing" else HttpEmbedder(host, model)


HYDE = "Escreva de duas a três frases técnicas, em português, que poderiam responder a esta pergunta em uma documentação: "
ANSWER = "Responda apenas com base nas fontes abaixo e cite cada uma como [Fonte N]. "
NOT_FOUND = "Se as fontes não contêm a resposta, escreva: Não encontrei essa informação na documentação."


def hypothetical_answer(chat: ChatProvider, query: str) -> str:
    return chat.chat([{"role": "user", "content": HYDE + query}], 0.2, 150).strip()


def query_text(chat: ChatProvider | None, query: str) -> str:
    """What is embedded for a query: a hypothetical answer and the query, or the query alone if there is none."""
    try:
        guess = hypothetical_answer(chat, query) if chat else ""
    except ModelError:
        guess = ""
    return f"{guess}\n{query}" if guess else query


def grounded_answer(chat: ChatProvider, query: str, context: str) -> str:
    if not context:
        return ""
    messages = [{"role": "system", "content": ANSWER + NOT_FOUND}, {"role": "user", "content": f"{context}\n\nPergunta: {query}"}]
    try:
        return chat.chat(messages, 0.0, 800).strip()
    except ModelError:
        return ""

"""Prompts, generation clients and answer clean-up."""

from __future__ import annotations

import errno
import hashlib
import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

# Answer labels that are taken off, and error codes of a provider.
PREFIXES = ("FINAL_ANSWER:", "CÂU TRẢ LỜI:")
ERROR_CODES = (
    "EMPTY_PROMPT", "MISSING_API_KEY", "LLM_TIMEOUT", "LLM_CONNECTION_RESET", "LLM_TRANSPORT_ERROR", "LLM_AUTH_ERROR", "LLM_RATE_LIMITED",
    "LLM_SERVER_ERROR", "LLM_PROVIDER_ERROR", "LLM_INVALID_RESPONSE", "LLM_REQUEST_FAILED", "INVALID_MOCK_RESPONSE",
)
RETRIED = {"LLM_TIMEOUT", "LLM_CONNECTION_RESET", "LLM_RATE_LIMITED", "LLM_SERVER_ERROR"}


@dataclass(frozen=True)
class Template:
    name: str
    version: str
    text: str

    @property
    def sha256(self) -> str:
        return hashlib.sha256(self.text.encode()).hexdigest()

    @classmethod
    def read(cls, path: str, name: str, version: str) -> Template:
        with open(path, "rb") as file:
            return cls(name, version, file.read().decode("utf-8"))


def render(template: Template, question: Column, evidence: Column | None = None) -> Column:
    """Literal replacement of {question}, then of {evidence}; the template must have the fields it is given."""
    if "{question}" not in template.text or (evidence is not None) != ("{evidence}" in template.text):
        raise ValueError("template and fields do not match")
    text = F.replace(F.lit(template.text), F.lit("{question}"), question)
    return text if evidence is None else F.replace(text, F.lit("{evidence}"), evidence)


def few_shot(examples: list[tuple[str, str]], question: Column, instruction: str = "") -> Column:
    """A prompt of fixed examples, then the question."""
    shots = "".join(f"Câu hỏi: {q}\nTrả lời: {a}\n\n" for q, a in examples)
    return F.concat(F.lit(f"{instruction}\n\n{shots}Câu hỏi: "), strip(question), F.lit("\nTrả lời:"))


def clean_answer(raw: Column) -> Column:
    """Line ends as LF, no outer blanks; at most two rounds of one outer code fence, then one exact label."""
    text = strip(F.regexp_replace(raw, r"\r\n?", "\n"))
    for _ in range(2):
        text = strip(F.regexp_replace(text, r"(?s)\A[ \t]*```[A-Za-z0-9_-]*[ \t]*\n(.*)\n[ \t]*```[ \t]*\z", "$1"))
        bare = text
        for prefix in PREFIXES:
            bare = F.when(text.startswith(prefix), F.substring(text, len(prefix) + 1, 1 << 30)).otherwise(bare)
        text = strip(bare)
    return text


def mock_response(prompt: Column) -> Column:
    """A deterministic answer from the prompt's digest."""
    return F.concat(F.lit("Mock response ["), F.left(F.sha2(prompt, 256), F.lit(16)), F.lit("]."))


class ProviderError(Exception):
    def __init__(self, code: str, message: str = ""):
        super().__init__(message or code)
        self.code = code


def redact(message: str) -> str:
    """Secrets in provider messages."""
    return re.sub(r"(?i)(bearer\s+|(?:api[_-]?key|token|secret|authorization)[\"'\s:=]+)[^\s\"',}]+", r"\1<redacted>", message)


def network_code(error: BaseException) -> str:
    """The code of a failed connection, whatever wraps it."""
    while isinstance(error, urllib.error.URLError) and isinstance(error.reason, BaseException):
        error = error.reason
    if isinstance(error, TimeoutError) or getattr(error, "errno", None) in (errno.ETIMEDOUT, 10060):
        return "LLM_TIMEOUT"
    if isinstance(error, (ConnectionResetError, ConnectionAbortedError)) or getattr(error, "errno", None) in (errno.ECONNRESET, errno.ECONNABORTED, 10053, 10054):
        return "LLM_CONNECTION_RESET"
    return "LLM_TRANSPORT_ERROR"


@dataclass
class ChatClient:
    """POSTs chat completions to an OpenAI-compatible or Ollama server, with retries and back-off."""

    url: str
    model: str
    api_key: str | None = None
    max_tokens: int = 96
    timeout: float = 180.0
    retries: int = 2
    backoff: float = 0.5
    style: str = "openai"
    needs_key: bool = False
    sleep: Callable[[float], None] = time.sleep
    transport: Callable[[str, bytes, dict, float], bytes] | None = None
    headers: dict = field(default_factory=dict)

    def _send(self, body: bytes, headers: dict) -> bytes:
        if self.transport:
            return self.transport(self.url, body, headers, self.timeout)
        with urllib.request.urlopen(urllib.request.Request(self.url, body, headers), timeout=self.timeout) as reply:
            return reply.read()

    def _once(self, prompt: str) -> str:
        ask = {"model": self.model, "messages": [{"role": "user", "content": prompt}], "stream": False}
        ask |= {"options": {"num_predict": self.max_tokens}} if self.style == "ollama" else {"max_tokens": self.max_tokens}
        headers = {"Content-Type": "application/json", **self.headers}
        if self.api_key:
            headers["Authorization"] = f"Bearer {self.api_key}"
        try:
            reply = json.loads(self._send(json.dumps(ask).encode(), headers))
        except urllib.error.HTTPError as e:
            code = "LLM_AUTH_ERROR" if e.code in (401, 403) else "LLM_RATE_LIMITED" if e.code == 429 else "LLM_SERVER_ERROR" if e.code >= 500 else "LLM_PROVIDER_ERROR"
            raise ProviderError(code, redact(str(e))) from None
        except OSError as e:
            raise ProviderError(network_code(e), redact(str(e))) from None
        except ValueError:
            raise ProviderError("LLM_INVALID_RESPONSE") from None
        except Exception as e:  # noqa: BLE001 - a transport may raise anything
            raise ProviderError("LLM_REQUEST_FAILED", redact(str(e))) from None
        try:
            text = reply["message"]["content"] if self.style == "ollama" else reply["choices"][0]["message"]["content"]
        except (KeyError, IndexError, TypeError):
            raise ProviderError("LLM_INVALID_RESPONSE") from None
        if not isinstance(text, str) or not text.strip():
            raise ProviderError("LLM_INVALID_RESPONSE")
        return text

    def __call__(self, prompt: str) -> tuple[str, int]:
        """(answer, retries used)."""
        if not prompt.strip():
            raise ProviderError("EMPTY_PROMPT")
        if self.needs_key and not (self.api_key or "").strip():
            raise ProviderError("MISSING_API_KEY")
        for attempt in range(self.retries + 1):
            try:
                return self._once(prompt), attempt
            except ProviderError as e:
                if e.code not in RETRIED or attempt == self.retries:
                    raise
                self.sleep(self.backoff * 2**attempt)
        raise AssertionError


def generate(prompts: DataFrame, client: Callable[[], Callable[[str], tuple[str, int]]]) -> DataFrame:
    """Operator: (id, prompt) -> (id, raw_answer, status, error_code, retries, latency_ms).

    ``client()`` is built once per task.  Provider errors are rows, not exceptions.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = client()
        for frame in frames:
            rows = []
            for id_, prompt in zip(frame["id"], frame["prompt"]):
                began = time.monotonic()
                try:
                    answer, retries = ask(prompt or "")
                    row = (id_, answer, "success", None, retries)
                except ProviderError as e:
                    row = (id_, None, "error", e.code, None)
                rows.append((*row, (time.monotonic() - began) * 1000))
            yield pd.DataFrame(rows, columns=["id", "raw_answer", "status", "error_code", "retries", "latency_ms"]).astype({"retries": "Int32"})

    return prompts.select("id", "prompt").mapInPandas(run, "id string, raw_answer string, status string, error_code string, retries int, latency_ms double")


def mock_generate(prompts: DataFrame, responses: DataFrame | None = None) -> DataFrame:
    """The same rows from a fixture (prompt, response) or the digest; blank prompts are errors.  JVM only."""
    blank = ~F.coalesce(F.col("prompt").rlike(r"(?U)[^\s]"), F.lit(False))
    rows = prompts.select("id", "prompt")
    if responses is not None:
        rows = rows.join(responses.select("prompt", F.col("response").alias("_r")), "prompt", "left")
        answer = F.coalesce("_r", mock_response(F.col("prompt")))
    else:
        answer = mock_response(F.col("prompt"))
    code = F.when(blank, F.lit("EMPTY_PROMPT")).when(~answer.rlike(r"(?U)[^\s]"), F.lit("INVALID_MOCK_RESPONSE"))
    return rows.select(
        "id", F.when(code.isNull(), answer).alias("raw_answer"), F.when(code.isNull(), "success").otherwise("error").alias("status"),
        code.alias("error_code"), F.when(code.isNull(), F.lit(0)).alias("retries"), F.lit(0.0).alias("latency_ms"),
    )

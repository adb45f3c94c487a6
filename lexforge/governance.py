"""Profiles, split rights, secrets, run identities and frozen fingerprints: driver-side contracts."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone
from pathlib import PurePosixPath

# Fixed values.
SECRET_WORDS = ("apikey", "authorization", "credential", "password", "passwd", "secret", "token")
REDACTED = "<redacted>"
METHODS = ("direct", "bm25_rag", "hybrid_rag", "finetuned_reader", "tuned_bm25_reader")
RAG_METHODS, TRAINING_SPLITS = METHODS[:3], ("train",)
SPLIT_RIGHTS = {
    "train": {"build_index", "inspect_retrieval", "validate_data"},
    "warmup": {"build_index", "inspect_retrieval", "validate_data", "evaluate", "inference", "submission"},
    "public": {"build_index", "inspect_retrieval", "validate_data", "inference", "submission"},
    "private": {"build_index", "inspect_retrieval", "validate_data", "inference", "submission"},
}


def is_secret(key: str) -> bool:
    plain = "".join(c for c in key.casefold() if c.isalnum())
    return any(word in plain for word in SECRET_WORDS)


def redacted(value):
    """The value with the contents of secret-looking keys hidden, at any depth."""
    if isinstance(value, dict):
        return {k: REDACTED if is_secret(str(k)) else redacted(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [redacted(v) for v in value]
    return value


def redacted_command(argv: list[str]) -> list[str]:
    """A command line whose secret options lost their values."""
    out, hide = [], False
    for word in argv:
        name, sign, _ = word.partition("=")
        if hide:
            out.append(REDACTED)
            hide = False
        elif word.startswith("-") and is_secret(name):
            out.append(f"{name}={REDACTED}" if sign else word)
            hide = not sign
        else:
            out.append(word)
    return out


def require_right(split: str, right: str) -> None:
    if split not in SPLIT_RIGHTS:
        raise ValueError(f"unknown split {split!r}")
    if right not in SPLIT_RIGHTS[split]:
        raise PermissionError(f"{right} is not allowed on {split}")


def require_references(split: str, access: str) -> None:
    """Only the warm-up split exposes references, and only for approved evaluation."""
    require_right(split, "evaluate")
    if access != "approved_evaluation":
        raise PermissionError("reference access is not approved")


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False)


def digest(value) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def run_id(method: str, now: datetime | None = None) -> str:
    now = (now or datetime.now(timezone.utc)).astimezone(timezone.utc)
    return f"{now:%Y%m%dT%H%M%S%f}Z-{method}"


def safe_relative(path: str) -> str:
    p = PurePosixPath(path)
    if p.is_absolute() or ".." in p.parts:
        raise ValueError(f"path must be relative and inside the project: {path}")
    return path


def safe_cache(path: str) -> str:
    if "data" in PurePosixPath(path).parts:
        raise ValueError("caches must not lie inside a data folder")
    return path


@dataclass(frozen=True)
class Profile:
    """What a run depends on; invariants are checked when it is made."""

    method: str = "bm25_rag"
    split: str = "public"
    chunk_max_chars: int = 1200
    chunk_overlap_chars: int = 200
    chunk_min_chars: int = 100
    candidates: int = 12
    k1: float = 1.5
    b: float = 0.75
    evidence_top_k: int = 4
    evidence_chars: int = 4000
    per_document: int = 2
    overlap_threshold: float = 0.8
    reranker: str = "none"
    generator: str = "mock"
    model: str = "mock"
    url: str = ""
    key_variable: str = ""
    max_tokens: int = 96
    timeout: float = 180.0
    data: str = "data"
    output: str = "outputs"
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        def need(ok: bool, what: str) -> None:
            if not ok:
                raise ValueError(what)

        need(self.method in METHODS, f"unknown method {self.method!r}")
        need(self.split in SPLIT_RIGHTS, f"unknown split {self.split!r}")
        need(0 <= self.chunk_overlap_chars < self.chunk_max_chars, "chunk overlap must be below chunk size")
        need(0 < self.chunk_min_chars <= self.chunk_max_chars, "chunk minimum must be within chunk size")
        need(self.k1 > 0 and 0 <= self.b <= 1, "k1 must be positive and b within [0, 1]")
        need(0 < self.evidence_top_k <= self.candidates, "evidence top k must be within the candidates")
        need(self.evidence_chars > 0 and self.per_document > 0, "evidence limits must be positive")
        need(0 < self.overlap_threshold <= 1, "overlap threshold must be within (0, 1]")
        need((self.method == "hybrid_rag") == (self.reranker != "none"), "hybrid_rag needs a reranker, other methods none")
        need(self.generator in ("mock", "openai", "ollama"), f"unknown generator {self.generator!r}")
        need(self.generator == "mock" or bool(self.url), "a generator needs its url")
        need(self.max_tokens > 0 and self.timeout > 0, "generation limits must be positive")
        need(not any(is_secret(k) for k in self.extra), "secrets do not belong into a profile")
        safe_relative(self.data), safe_relative(self.output)

    @classmethod
    def read(cls, path: str) -> Profile:
        """A JSON profile, or YAML where PyYAML is there; unknown fields are refused."""
        with open(path, encoding="utf-8") as file:
            text = file.read()
        if path.endswith((".yaml", ".yml")):
            import yaml

            values = yaml.safe_load(text)
        else:
            values = json.loads(text)
        if unknown := set(values) - set(cls.__dataclass_fields__):
            raise ValueError(f"unknown fields: {', '.join(sorted(unknown))}")
        return cls(**values)

    @property
    def fingerprint(self) -> str:
        return digest(asdict(self))


def training_policy(splits: list[str]) -> dict:
    """Whether only splits that training may use are asked for."""
    refused = sorted(set(splits) - set(TRAINING_SPLITS))
    return {"allowed_splits": list(TRAINING_SPLITS), "candidate_splits": list(splits), "disallowed_splits": refused, "pass": not refused}


def reference_policy() -> dict:
    """Whether references of public and private are out of reach, by trying."""
    errors = {}
    for split in ("public", "private"):
        try:
            require_references(split, "approved_evaluation")
        except PermissionError as error:
            errors[split] = str(error)
    return {"public_blocked": "public" in errors, "private_blocked": "private" in errors, "errors": errors, "pass": len(errors) == 2}


#: The fields whose values a frozen run may not change.
FROZEN = ("profile", "template", "corpus", "chunk_cache", "index", "splits", "representative_run")


def freeze(**values) -> dict:
    """A fingerprint of everything a run depends on; fields that are not known yet are unresolved."""
    if unknown := set(values) - set(FROZEN):
        raise ValueError(f"unknown fields: {', '.join(sorted(unknown))}")
    fields = {name: values.get(name) or "UNRESOLVED" for name in FROZEN}
    return {"schema_version": "lexforge.freeze.1", "fields": fields, "sha256": digest(fields)}


def load_freeze(path: str) -> dict:
    """A stored fingerprint; one whose digest does not fit its fields is refused."""
    with open(path, encoding="utf-8") as file:
        frozen = json.load(file)
    if set(frozen.get("fields", {})) != set(FROZEN) or frozen.get("sha256") != digest(frozen["fields"]):
        raise ValueError(f"{path} is no intact fingerprint")
    return frozen


def require_frozen(frozen: dict, current: dict) -> None:
    """Fails where a field differs or is unresolved."""
    if changed := drift(frozen["fields"], current["fields"]):
        raise ValueError("differs from the frozen run: " + ", ".join(name for name, _, _ in changed))


def drift(frozen: dict, current: dict) -> list[tuple[str, object, object]]:
    """(field, frozen, current) of every field that differs; unresolved frozen values never match."""
    names = sorted(set(frozen) | set(current))
    return [(n, frozen.get(n), current.get(n)) for n in names if frozen.get(n) != current.get(n) or frozen.get(n) == "UNRESOLVED"]

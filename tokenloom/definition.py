"""What a tokenizer is: small ranked tables and lists of steps.  Everything here is plain data on the driver."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace
from typing import Any

KINDS = ("unknown", "control", "priority")


class DefinitionError(ValueError):
    pass


@dataclass(frozen=True)
class Special:
    id: int
    bytes: bytes
    kind: str = "control"
    score: float = 0.0
    extract: bool = False
    ident: str | None = None

    @property
    def order(self) -> tuple:
        return KINDS.index(self.kind), self.score, self.id


@dataclass(frozen=True)
class Step:
    """One configured step: a name of the compilers' registries and its arguments."""

    name: str
    args: dict[str, Any] = field(default_factory=dict)


def step(name: str, **args: Any) -> Step:
    return Step(name, args)


@dataclass(frozen=True)
class Definition:
    """vocab is in rank order (its order is meaning); scores go with it for unigram models."""

    model: str  # bytepair, unigram or wordpiece
    vocab: tuple[tuple[int, bytes], ...]
    scores: tuple[float, ...] = ()
    chars: bool = True
    max_word_chars: int = 0
    specials: tuple[Special, ...] = ()
    fallback: tuple[str, ...] = ("skip",)
    normalization: tuple[Step, ...] = ()
    split: tuple[Step, ...] = ()
    processing: tuple[Step, ...] = ()
    decoding: tuple[Step, ...] = ()
    word_end: str = ""
    word_continuation: str = ""
    source: str = "tokenloom"
    meta: tuple[tuple[str, str], ...] = ()
    #: (content, position) of tokens that a caller may put around texts; encoding doesn't.
    templates: tuple[tuple[str, str], ...] = ()

    def validated(self) -> Definition:
        if self.model not in ("bytepair", "unigram", "wordpiece"):
            raise DefinitionError(f"unknown model {self.model}")
        if not self.vocab:
            raise DefinitionError("the vocabulary is empty")
        tokens = [b for _, b in self.vocab]
        if self.model != "wordpiece" and len(set(tokens)) < len(tokens):
            raise DefinitionError("two vocabulary entries have the same bytes")
        if self.model == "unigram" and len(self.scores) != len(self.vocab):
            raise DefinitionError("scores and vocabulary differ in length")
        if len({s.bytes for s in self.specials}) < len(self.specials):
            raise DefinitionError("two special tokens have the same bytes")
        for s in self.specials:
            s.bytes.decode()
            if s.kind not in KINDS:
                raise DefinitionError(f"unknown kind {s.kind}")
        return self

    def with_config(self, **changes: Any) -> Definition:
        return replace(self, **changes).validated()

    def ordered_specials(self) -> list[Special]:
        return sorted(self.specials, key=lambda s: s.order)

    def kinds(self, wanted: bool | str | list[str] | None) -> set[str]:
        """True: all kinds.  False: priority, and unknown too unless the definition comes from the JSON tokenizer format."""
        if wanted is True:
            return set(KINDS)
        if wanted is None or wanted is False:
            return {"priority"} if self.source == "tokenizers" else {"priority", "unknown"}
        chosen = {wanted} if isinstance(wanted, str) else set(wanted)
        if not chosen <= set(KINDS):
            raise DefinitionError(f"unknown kinds {sorted(chosen - set(KINDS))}")
        return chosen

    def unknown_id(self) -> int | None:
        return next((s.id for s in self.ordered_specials() if s.kind == "unknown"), None)

    def exported(self) -> list[tuple[int, bytes]]:
        """The vocabulary as tools list it: by (rank, id), (score, id) or (id, bytes)."""
        if self.model == "unigram":
            return [x for _, x in sorted(zip(self.scores, self.vocab, strict=True), key=lambda p: (p[0], p[1][0]))]
        return sorted(self.vocab) if self.model == "wordpiece" else list(self.vocab)

    def to_json(self) -> str:
        body = asdict(self)
        body["vocab"] = [[i, b.hex()] for i, b in self.vocab]
        for s in body["specials"]:
            s["bytes"] = s["bytes"].hex()
        return json.dumps(body, ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> Definition:
        body = json.loads(text)
        body["vocab"] = tuple((i, bytes.fromhex(b)) for i, b in body["vocab"])
        body["specials"] = tuple(Special(**s | {"bytes": bytes.fromhex(s["bytes"])}) for s in body["specials"])
        for name in ("normalization", "split", "processing", "decoding"):
            body[name] = tuple(Step(**s) for s in body[name])
        for name in ("scores", "fallback"):
            body[name] = tuple(body[name])
        for name in ("meta", "templates"):
            body[name] = tuple(tuple(x) for x in body.get(name, ()))
        return cls(**body).validated()

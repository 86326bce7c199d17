"""Model providers: the only code that runs outside Spark's expressions.

A provider is a zero-argument factory, called once per task, that returns a function:

* embedder: `list[str] -> sequence of vectors`
* text model: `(prompt, payload) -> str`, where payload is the JSON inside the prompt

Real models are passed in by the user. The stand-ins here are deterministic, so SQL
can reproduce their results.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from functools import cache

import numpy as np

Embedder = Callable[[list[str]], Sequence[Sequence[float]]]
TextModel = Callable[[str, str], str]


class _Buckets(dict):
    """Bucket of a token, computed once; forgets everything when it grows too large."""

    _REMEMBERED = 1 << 20

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, token: str) -> int:
        if len(self) >= self._REMEMBERED:
            self.clear()
        digest = hashlib.md5(token.encode("utf-8"), usedforsecurity=False).digest()
        # Empty tokens get a bucket of their own, behind the others.
        slot = int.from_bytes(digest[:4], "big") % self.dim if token else self.dim
        self[token] = slot
        return slot


@cache
def _buckets(dim: int) -> _Buckets:
    """One for all tasks of a worker, so that a task of few texts need not hash every token anew."""
    return _Buckets(dim)


class HashedTokenEmbedder:
    """Counts of tokens hashed into `dim` buckets by the first four md5 bytes.

    Tokens are what lies between single spaces.
    """

    def __init__(self, dim: int = 64):
        self.dim = dim

    def __call__(self) -> Embedder:
        buckets = _buckets(self.dim)

        def embed(texts: list[str]) -> np.ndarray:
            out = np.empty((len(texts), self.dim))
            for row, text in enumerate(texts):
                slots = list(map(buckets.__getitem__, text.split(" ")))
                out[row] = np.bincount(slots, minlength=self.dim + 1)[: self.dim]
            return out

        return embed


class KeywordClassifier:
    """Answers a batch with the category of the first rule whose keyword an item contains."""

    def __init__(self, rules: Sequence[tuple[str, str]], default: str):
        self.rules, self.default = tuple(rules), default

    def _category(self, text: str) -> str:
        return next((c for keyword, c in self.rules if keyword in text), self.default)

    def __call__(self) -> TextModel:
        def answer(prompt: str, payload: str) -> str:
            return json.dumps(
                [
                    {"id": item["id"], "category": self._category(item["summary"])}
                    for item in json.loads(payload)
                ],
                ensure_ascii=False,
            )

        return answer


class FirstHitAnswerer:
    """Answers with the text of the best hit and refers to every hit in order."""

    def __call__(self) -> TextModel:
        def answer(prompt: str, payload: str) -> str:
            context = json.loads(payload)
            references = [
                {
                    "news_id": item.get("news_id"),
                    "title": (item.get("meta_data") or {}).get("title"),
                    "publisher": (item.get("meta_data") or {}).get("publisher"),
                }
                for item in context
            ]
            return json.dumps(
                {"summary": context[0].get("chunk_text"), "references": references},
                ensure_ascii=False,
            )

        return answer


class Unsteady:
    """Another text model that fails now and then, by the length of the prompt, in the way
    named there: error, empty, one of the texts given, or, for None, not at all."""

    def __init__(self, provider: Callable[[], TextModel], outcomes: Sequence[str | None]):
        self.provider, self.outcomes = provider, tuple(outcomes)

    def __call__(self) -> TextModel:
        model = self.provider()

        def answer(prompt: str, payload: str) -> str:
            outcome = self.outcomes[len(prompt) % len(self.outcomes)]
            if outcome == "error":
                raise RuntimeError("the model is away")
            if outcome == "empty":
                return ""
            return model(prompt, payload) if outcome is None else outcome

        return answer


class TextIds:
    """Another text model whose references name their articles by text."""

    def __init__(self, provider: Callable[[], TextModel]):
        self.provider = provider

    def __call__(self) -> TextModel:
        model = self.provider()

        def answer(prompt: str, payload: str) -> str:
            result = json.loads(model(prompt, payload))
            for reference in result["references"]:
                reference["news_id"] = str(reference["news_id"])
            return json.dumps(result, ensure_ascii=False)

        return answer

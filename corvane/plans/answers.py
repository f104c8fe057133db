"""Answer generation with a pluggable model. The default is a named stand-in that quotes its context; it is no model."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

Completer = Callable[[str, str, str], str]


def quoting_stub(stage: str, question: str, context: str) -> str:
    """Deterministic and local: the first sentence of the context that shares most words with the question."""
    if stage == "critique":
        return ""
    asked = set(question.lower().split())
    sentences = [s.strip() for s in context.replace("\n", ". ").split(". ") if s.strip()]
    return max(sentences, key=lambda s: len(asked & set(s.lower().split())), default="")


def with_retries(complete: Completer, attempts: int = 5, transient: tuple[type[Exception], ...] = (TimeoutError, ConnectionError), most: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> Completer:
    """The model asked again after transient failures, with waits that double up to most seconds."""

    def ask(stage: str, question: str, context: str) -> str:
        for i in range(attempts):
            try:
                return complete(stage, question, context)
            except transient:
                if i == attempts - 1:
                    raise
                sleep(min(most, 2.0**i))
        raise ValueError("attempts must be positive")

    return ask


def generate(contexts: DataFrame, complete: Completer = quoting_stub) -> DataFrame:
    """(question_id, answer, pass1, critique, pass2) of (question_id, question, context): draft, critique, rewrite.

    The draft stands if a later stage fails or is empty; the flags tell which stages gave something.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                draft = complete("draft", row["question"], row["context"])
                critique = final = ""
                try:
                    critique = complete("critique", row["question"], f"{row['context']}\n{draft}")
                    final = complete("rewrite", row["question"], f"{row['context']}\n{critique}") if critique else ""
                except Exception:  # a model's failure after the draft leaves the draft
                    pass
                out.append((row["question_id"], final or draft, bool(draft), bool(critique), bool(final)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.string(), *[pa.bool_()] * 3))], ["question_id", "answer", "pass1", "critique", "pass2"])

    return contexts.select("question_id", "question", "context").mapInArrow(run, "question_id string, answer string, pass1 boolean, critique boolean, pass2 boolean")

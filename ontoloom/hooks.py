"""Optional language-model and embedding hooks.  Without one, every operator takes its deterministic path."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Hook = Callable[[list[str]], list[str]]


def null_hook(prompts: list[str]) -> list[str]:
    """Answers nothing."""
    return [""] * len(prompts)


def tolerant_json(text: str | None) -> Any:
    """The JSON value of an answer: the whole text, else a fenced block, else the first braces that parse; {} if there is none."""
    text = (text or "").strip()
    fenced = re.findall(r"```(?:json)?\s*(.*?)```", text, re.S)
    for t in [text, *fenced]:
        try:
            return json.loads(t)
        except ValueError:
            pass
    decoder = json.JSONDecoder()
    for m in re.finditer(r"[{\[]", text):
        try:
            return decoder.raw_decode(text[m.start() :])[0]
        except ValueError:
            pass
    return {}


def ask(prompts: DataFrame, hook: Hook = null_hook, tries: int = 3) -> DataFrame:
    """(prompt_id, answer, failed) of prompts (prompt_id, prompt): one call a batch, tried up to `tries` times; the prompts of a batch whose every call fails have empty answers and are marked, later batches are asked all the same."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            answers = None
            for _ in range(tries):
                try:
                    answers = hook(p.prompt.tolist())
                    break
                except Exception:
                    continue
            yield pd.DataFrame({"prompt_id": p.prompt_id, "answer": [""] * len(p) if answers is None else answers, "failed": answers is None})

    return prompts.select(F.col("prompt_id").cast("string").alias("prompt_id"), "prompt").mapInPandas(run, "prompt_id string, answer string, failed boolean")

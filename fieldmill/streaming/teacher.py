"""A teacher behind a chat-completions address, as a batch backend for mapInPandas."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ANSWER = "_sample_id long, teacher_output string, raw_response string"


@dataclass(frozen=True)
class Teacher:
    """Where a teacher is and how it is asked. Body fields of extra replace those made here."""

    base_url: str
    api_key: str
    model: str
    top_logprobs: int = 10
    max_tokens: int = 512
    token_field: str = "max_tokens"
    temperature: float = 0.0
    timeout: float = 120.0
    tries: int = 3
    pause: float = 5.0
    between: float = 0.0
    json_only: bool = False
    extra: dict = field(default_factory=dict)

    def url(self) -> str:
        """The address of completions: base addresses may end in /v1 or in the whole path already."""
        base = self.base_url.rstrip("/")
        if base.endswith("/chat/completions"):
            return base
        return base + ("/chat/completions" if base.endswith("/v1") else "/v1/chat/completions")

    def body(self, messages: list[dict]) -> dict:
        made = {"model": self.model, "messages": messages, "temperature": self.temperature, "logprobs": True, "top_logprobs": self.top_logprobs, self.token_field: self.max_tokens, **self.extra}
        return made | {"response_format": {"type": "json_object"}} if self.json_only else made

    def ask(self, messages: list[dict]) -> str:
        """The raw answer; after so many failures the last one is raised."""
        request = urllib.request.Request(self.url(), json.dumps(self.body(messages)).encode(), {"Authorization": f"Bearer {self.api_key}", "Content-Type": "application/json"})
        for left in range(self.tries - 1, -1, -1):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                    raw = answer.read().decode()
                json.loads(raw)["choices"][0]["message"]["content"]
                return raw
            except Exception as e:
                if not left:
                    raise RuntimeError(f"no answer from {self.url()} in {self.tries} tries: {e}") from e
                time.sleep(self.pause)
        raise ValueError("tries must be positive")


def completions_url(base: Column) -> Column:
    """Teacher.url of a column of base addresses."""
    end = F.regexp_replace(base, "/+$", "")
    return F.when(end.endswith("/chat/completions"), end).when(end.endswith("/v1"), F.concat(end, F.lit("/chat/completions"))).otherwise(F.concat(end, F.lit("/v1/chat/completions")))


def backend(teacher: Teacher) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """For inline.teacher_rows: frames of _sample_id, instruction, input to frames of ANSWER. The
    answer stays raw; fieldmill.functions.text.message_text and softlabel.logprob_steps read it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False, name=None):
                row = dict(zip(frame.columns, r))
                raw = teacher.ask([{"role": "system", "content": row["instruction"]}, {"role": "user", "content": row["input"]}])
                content = json.loads(raw)["choices"][0]["message"]["content"]
                rows.append((row["_sample_id"], content if isinstance(content, str) else json.dumps(content), raw))
                if teacher.between:
                    time.sleep(teacher.between)
            yield pd.DataFrame(rows, columns=["_sample_id", "teacher_output", "raw_response"])

    return run

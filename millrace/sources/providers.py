"""Providers of what the engine can't compute: embeddings, extraction, tag selection, chat.

Each is a plain function over a list of texts. The defaults are deterministic and offline; remote ones are passed in
their place. They run in Arrow batches on the executors.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Embed = Callable[[list[str]], list[list[float]]]
Chat = Callable[[list[str]], list[str]]

#: Longest text that is embedded; longer ones are cut and end in "...".
EMBEDDED_CHARS = 6000


def hashed_embedding(texts: Sequence[str], size: int = 64) -> list[list[float]]:
    """Unit vectors of hashed character trigrams; equal texts have equal ones, empty texts none."""
    out = []
    for text in texts:
        v = np.zeros(size)
        padded = f" {text.lower()} "
        for i in range(len(padded) - 2) if text.strip() else ():
            h = int.from_bytes(hashlib.blake2b(padded[i : i + 3].encode(), digest_size=8).digest(), "little")
            v[h % size] += 1 if h >> 63 else -1
        length = np.linalg.norm(v)
        out.append((v / length).tolist() if length else [])
    return out


def keyword_extraction(texts: Sequence[str], kind: str, words: dict[str, Sequence[str]]) -> list[str]:
    """The words of a kind that a text holds, comma-separated; nothing for an unknown kind."""
    return [", ".join(w for w in words.get(kind, ()) if w in t) for t in texts]


def echo_chat(prompts: Sequence[str]) -> list[str]:
    """An answer that only depends on the prompt, as JSON in both languages."""
    return [json.dumps({"chinese_response": f"回答 {hashlib.md5(p.encode()).hexdigest()[:8]}", "english_response": f"Answer {hashlib.md5(p.encode()).hexdigest()[:8]}"}, ensure_ascii=False) for p in prompts]


@dataclass
class Providers:
    embed: Embed = hashed_embedding
    chat: Chat = echo_chat
    words: dict[str, Sequence[str]] = field(default_factory=dict)


def embedded(text: Column, embed: Embed = hashed_embedding) -> Column:
    """A column of vectors; a null text has none."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            vectors = embed([(t or "")[:EMBEDDED_CHARS] + ("..." if t and len(t) > EMBEDDED_CHARS else "") for t in s])
            yield pd.Series([v if v else None for v in vectors])

    return run(text)


def extracted(text: Column, kind: str, words: dict[str, Sequence[str]]) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(keyword_extraction([t or "" for t in s], kind, words))

    return run(text)


def one_by_one(call: Callable[[list[str]], Sequence], texts: Sequence[str], size: int = 5) -> list[tuple]:
    """(result, error) of each text: `size` texts go to the provider at once, and those of a batch that fails one by one,
    so that one bad text costs only its own result."""
    out: list[tuple] = []
    for i in range(0, len(texts), size):
        some = list(texts[i : i + size])
        try:
            got = list(call(some))
            if len(got) != len(some):
                raise ValueError(f"{len(got)} results of {len(some)}")
            out += [(x, None) for x in got]
        except Exception as e:  # noqa: BLE001  any failure of a provider is a row's result
            out += one_by_one(call, some, 1) if len(some) > 1 else [(None, f"{type(e).__name__}: {e}")]
    return out


def answered(prompts: DataFrame, prompt: str, chat: Chat = echo_chat, column: str = "answer", size: int = 5) -> DataFrame:
    """prompts with the answers; one that fails is null and its error stands beside it. `size` go to the provider at once."""

    @F.pandas_udf("struct<answer:string,error:string>")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(one_by_one(chat, s.tolist(), size), columns=["answer", "error"])

    return prompts.withColumn("_r", run(F.col(prompt))).withColumns({column: F.col("_r.answer"), "error": F.col("_r.error")}).drop("_r")


#: Calls of a turn as a column.
CALLS = "struct<content:string,tool_calls:array<struct<id:string,name:string,arguments:string>>,error:string>"


def with_tools(prompts: DataFrame, prompt: str, chat: Callable[[list[str], list[dict]], Sequence[dict]], tools: list[dict], size: int = 5) -> DataFrame:
    """prompts with a struct `turn`: what a model says that is offered tools, the calls it makes, or the error.

    chat(prompts, tool schemas) -> {content, tool_calls: [{id, name, arguments (JSON)}]} for each prompt.
    """

    @F.pandas_udf(CALLS)
    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for said, error in one_by_one(lambda some: chat(some, tools), s.tolist(), size):
            own = said or {}
            calls = [{"id": c.get("id"), "name": c["name"], "arguments": c.get("arguments") or "{}"} for c in own.get("tool_calls") or []]
            rows.append((own.get("content"), calls, error))
        return pd.DataFrame(rows, columns=["content", "tool_calls", "error"])

    return prompts.withColumn("turn", run(F.col(prompt)))


def both_languages(answer: Column) -> Column:
    """Struct of the Chinese, the English and the combined answer of a function call's JSON."""
    from ..functions.text import lenient_json

    r = lenient_json(answer, "struct<chinese_response:string,english_response:string>")
    combined = F.concat_ws("\n\n---\n\n", r["chinese_response"], r["english_response"])
    return F.struct(r["chinese_response"].alias("chinese"), r["english_response"].alias("english"), combined.alias("combined"))


def called_once(chat: Callable[[list[dict]], Sequence[dict]], messages: list[dict], reminder: str, attempts: int = 3) -> dict | None:
    """The one tool call of a model's turn; if it makes none or several it is reminded, up to `attempts` turns; else None."""
    log = [dict(m) for m in messages]
    for k in range(attempts):
        calls = chat(log)
        if len(calls) == 1:
            return calls[0]
        if k + 1 < attempts:
            log[-1]["content"] = f"{log[-1].get('content') or ''}\n{reminder}"
    return None


def parse_arguments(text: str | None) -> dict:
    """Arguments of a tool call; none if they aren't an object of JSON."""
    try:
        value = json.loads(text or "{}")
    except ValueError:
        return {}
    return value if isinstance(value, dict) else {}




@dataclass
class LocalBatches:
    """Batch jobs as a remote service has them (submit, status, results), run here by a chat function: the interface
    that a remote one implements too."""

    chat: Chat = echo_chat
    jobs: dict[str, dict] = field(default_factory=dict)

    def submit(self, lines: Sequence[str]) -> str:
        job = f"batch-{len(self.jobs) + 1:04d}"
        self.jobs[job] = {"status": "submitted", "lines": list(lines), "request_counts": {"total": len(lines), "completed": 0, "failed": 0}}
        return job

    def status(self, job: str) -> dict:
        """The job's state; asking for it is what lets the job go on."""
        own = self.jobs[job]
        if own["status"] == "submitted":
            own["results"] = [self._result(json.loads(line)) for line in own["lines"]]
            failed = sum('"error": {' in r for r in own["results"])
            own |= {"status": "completed", "request_counts": {"total": len(own["lines"]), "completed": len(own["lines"]) - failed, "failed": failed}}
        return {k: own[k] for k in ("status", "request_counts")}

    def results(self, job: str) -> list[str]:
        if self.status(job)["status"] not in ("completed", "downloaded"):
            raise ValueError(f"{job} isn't completed")
        self.jobs[job]["status"] = "downloaded"
        return self.jobs[job]["results"]

    def _result(self, request: dict) -> str:
        prompt = request["body"]["messages"][-1]["content"]
        try:
            text = self.chat([prompt])[0]
        except Exception as e:  # noqa: BLE001  a request that fails is one failed result
            return json.dumps({"custom_id": request["custom_id"], "error": {"message": str(e)}}, ensure_ascii=False)
        usage = {"prompt_tokens": len(prompt.split()), "completion_tokens": len(text.split())}
        return json.dumps({"custom_id": request["custom_id"], "response": {"body": {"model": request["body"]["model"], "choices": [{"message": {"content": text}}], "usage": usage}}}, ensure_ascii=False)

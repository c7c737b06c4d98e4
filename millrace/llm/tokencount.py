"""Token counts by a whole-token shortcut.

A sentencepiece BPE model never merges across a place that no vocabulary piece spans. `TokenCounter` reads
from the vocabulary which places these are and proves, once per worker, which vocabulary strings encode alone
as one token. A text is cut at those places into pre-tokens; a pre-token that is such a string counts one,
only the others are merged by the library, each distinct one once while it stays in the bounded cache.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import doc_columns, map_batches

#: sentencepiece writes a space as this, and takes it in a text for a space as well.
META = "▁"
#: Distinct pre-tokens whose counts a worker keeps.
CACHE = 500_000


class TokenCounter(dict):
    """Pre-token (without the one leading space) -> number of its tokens; misses are merged by the library."""

    def __init__(self, model_path: str) -> None:
        import sentencepiece

        super().__init__()
        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        kinds = (self.sp.is_control, self.sp.is_unknown, self.sp.is_byte, self.sp.is_unused)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size()) if not any(k(i) for k in kinds)]
        spans = any(re.search(f"[^{META}]{META}", p) for p in pieces)
        #: Cutting before each run of spaces is exact only if no piece holds a space after another character
        #: and the model keeps a text's spaces and characters as they are.
        self.cuts = not spans and all(self._decodes(t) for t in ("a  b\nc d", " \n a", "Ａé é", "a\t b "))
        self.line_cuts = self.cuts and not any("\n" in p and len(p) > 1 for p in pieces)
        self.line_cost = len(self.sp.encode("\n", num_threads=1)) - 1  # without the space put before a text
        self.whole = self.proved([p[1:] for p in pieces if p.startswith(META) and META not in p[1:]]) if self.cuts else {}
        self.whole[""] = 1  # a lone space
        self.update(self.whole)

    def _decodes(self, text: str) -> bool:
        """Whether the model keeps a text's spaces and characters as they are."""
        return self.sp.decode(self.sp.encode(text, num_threads=1)) == text

    def proved(self, strings: list[str]) -> dict[str, int]:
        """Those strings that the library, given them alone, encodes as one token."""
        return {s: 1 for s, ids in zip(strings, self.sp.encode(strings, num_threads=1), strict=True) if s and len(ids) == 1}

    def __missing__(self, pre: str) -> int:
        if len(self) > CACHE:
            self.clear()
            self.update(self.whole)
        n = len(self.sp.encode(pre, num_threads=1))
        if len(pre) <= 64:
            self[pre] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.cuts:
            return len(self.sp.encode(text, num_threads=1))
        text = text.replace(META, " ")
        if not self.line_cuts or "\n" not in text:
            return self._line(" " + text)
        first, *rest = text.split("\n")
        return self._line(" " + first) + self.line_cost * len(rest) + sum(self._line(x) for x in rest if x)

    def _line(self, line: str) -> int:
        """Tokens of what follows a newline, or of a first line with the space that the library puts before it."""
        cut = line.find(" ")
        head, rest = (line, "") if cut < 0 else (line[:cut], line[cut:])
        n = self["\n" + head] - 1 - self.line_cost if head else 0
        if not rest:
            return n
        pres = [x[1:] for x in re.findall(" +[^ ]*", rest)] if "  " in rest or rest[-1] == " " else rest[1:].split(" ")
        return n + sum(map(self.__getitem__, pres))


@lru_cache(maxsize=2)
def counter(model_path: str) -> TokenCounter:
    return TokenCounter(model_path)


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have 0 bytes and 0 tokens; repeated rows and null ids stay as they are; doc_id is an integer, other columns
    are not looked at; an empty table gives an empty result.
    """

    def batch(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        count = counter(model_path).count
        n = pa.array([count(t) for t in rows.column("text").to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("n_bytes"), n], ["doc_id", "n_bytes", "n_tokens"])

    rows = doc_columns(docs, "doc_id", "text").withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    out = map_batches(rows, batch, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))

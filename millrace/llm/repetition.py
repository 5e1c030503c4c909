"""Quality rules by repetition coverage: how much of a text stands inside repeated word runs and lines.

Rolling hashes of several run lengths are made in numpy per text; a place is covered when a run that holds it
occurs at least twice. Coverage is measured in code points of words.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, types as T

from millrace.llm.rows import SPACES, WordHashes, mixed, per_text

_CONTINUATION = bytes(range(0x80, 0xC0))
_NOT_COUNTED = SPACES.encode() + _CONTINUATION
_SYMBOLS = b"#*$%&|<>"
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Limits:
    """Highest shares of word characters that a kept text may have.

    ``top``: inside the single most frequent run of 2, 3 or 4 words. ``repeated``: inside any repeated run of 5 to
    10 words. ``lines`` and ``line_chars``: lines equal to an earlier one, by count and by characters.
    """

    min_words: int = 50
    top: dict[int, float] = field(default_factory=lambda: {2: 0.20, 3: 0.18, 4: 0.16})
    repeated: dict[int, float] = field(
        default_factory=lambda: {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
    )
    lines: float = 0.30
    line_chars: float = 0.20


def _covered(starts: np.ndarray, n: int, words: int) -> np.ndarray:
    """Which of ``words`` places lie within ``n`` of a flagged start."""
    edge = np.zeros(words + 1, np.int32)
    edge[: len(starts)] += starts
    edge[n : n + len(starts)] -= starts
    return np.cumsum(edge[:words]) > 0


def _repeats(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each run whether its code occurs twice or more, and where the most frequent code stands."""
    order = np.argsort(codes, kind="stable")
    ranked = codes[order]
    new = np.empty(len(ranked), bool)
    new[0] = True
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(ranked)))
    many = np.empty(len(codes), bool)
    many[order] = np.repeat(count > 1, count)
    best = int(np.argmax(count))
    top = order[first[best] : first[best] + count[best]] if count[best] > 1 else order[:0]
    return many, top


class Reader:
    """Measures one text (UTF-8)."""

    def __init__(self, limits: Limits) -> None:
        self.limits, self.hashes = limits, WordHashes()

    def lines(self, text: bytes) -> tuple[int, int, int]:
        """Lines with a word, those equal to an earlier one, and the word characters of the latter."""
        seen: set[bytes] = set()
        n = again = chars = 0
        for line in text.split(b"\n"):
            if line.strip():
                n += 1
                if line in seen:
                    again += 1
                    chars += len(line.translate(None, _NOT_COUNTED))
                else:
                    seen.add(line)
        return n, again, chars

    def __call__(self, text: bytes) -> tuple:
        words = text.split()
        n = len(words)
        word_chars = len(text.translate(None, _NOT_COUNTED))
        symbols = len(text) - len(text.translate(None, _SYMBOLS))
        n_lines, n_dup_lines, dup_line_chars = self.lines(text)
        shares = {"lines": n_dup_lines / n_lines if n_lines else 0.0, "line_chars": dup_line_chars / max(1, word_chars)}
        n_repeat = 0
        if n >= 2:
            word_codes = mixed(self.hashes.of(words))
            multibyte = len(text.translate(None, _CONTINUATION)) != len(text)
            if multibyte:
                lengths = np.fromiter((len(w.translate(None, _CONTINUATION)) for w in words), np.int64, n)
            else:
                lengths = np.fromiter(map(len, words), np.int64, n)
            codes = word_codes
            for size in range(2, max([3, *self.limits.top, *self.limits.repeated]) + 1):
                if size > n:
                    break
                codes = mixed(codes[:-1] * _STEP + word_codes[size - 1 :])  # of the run before, one word longer
                many, top = _repeats(codes)
                if size == 3:
                    n_repeat = int(_covered(many, 3, n).sum())
                if size in self.limits.top:
                    flags = np.zeros(len(codes), bool)
                    flags[top] = True
                    shares[f"top{size}"] = float(lengths[_covered(flags, size, n)].sum()) / max(1, word_chars)
                if size in self.limits.repeated:
                    shares[f"run{size}"] = float(lengths[_covered(many, size, n)].sum()) / max(1, word_chars) if many.any() else 0.0
                if not many.any():
                    break  # a longer repeated run would hold a shorter one
        base_failed = n < self.limits.min_words or 100 * n_repeat > 50 * n
        failed = [k for k, v in shares.items() if v > self._limit(k)]
        return n, word_chars, symbols, n_dup_lines, n_repeat, base_failed, not base_failed and not failed, failed

    def _limit(self, name: str) -> float:
        if name in ("lines", "line_chars"):
            return getattr(self.limits, name)
        return (self.limits.top if name.startswith("top") else self.limits.repeated)[int(name[3:])]


FIELDS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("word_chars", T.LongType()),
        T.StructField("n_symbols", T.LongType()),
        T.StructField("n_dup_lines", T.LongType()),
        T.StructField("n_repeat_words", T.LongType()),
        T.StructField("base_failed", T.BooleanType()),
        T.StructField("kept", T.BooleanType()),
        T.StructField("failed_rules", T.ArrayType(T.StringType())),
    ]
)


def rate(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", limits: Limits | None = None) -> DataFrame:
    """``keep`` and the measures and verdict of every row; no shuffle.

    NULL and empty texts have no words, so they fail the base rule. Rows are judged one by one: repeated rows and
    NULL ids change nothing. Columns that are not in ``keep`` are left out.
    """
    limits = limits or Limits()
    return per_text(docs, lambda: Reader(limits), FIELDS, keep, text)

"""Encode to and decode from the pieces of a merge-type SentencePiece model, by backtracking.

A text is the encoding's token sequence exactly when every two adjacent tokens stay apart if they are merged anew
on their own. So the encoder takes the longest piece that starts at a place (Aho-Corasick finds all of them in one
pass), checks it against the token before it, falls back to the next shorter piece, and remembers in a bitfield the
places from which no sequence leads on. White space starts a chunk, since no piece holds white space behind another
character; chunks are encoded alone and the short ones remembered.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence

import ahocorasick
import numpy as np
import sentencepiece
from pyspark.sql import DataFrame, types as T

from millrace.llm.rows import per_text

#: Chunks and token pairs remembered by one task. A full table of chunks becomes the older one and a new one starts;
#: a full table of pairs starts anew. It bounds memory only: a chunk takes about 350 bytes, in two tables. Where a task
#: also returns the ids, less is left for them.
CACHED, CACHED_WITH_IDS, CACHED_LENGTH = 250_000, 100_000, 48
_SPACE = "▁"
_NEVER = float("-inf")
_PAIR = 1 << 24  # above every token number


class _Chunks(dict):
    """The ids of a chunk, joined by commas, their number, and the bytes they decode to."""

    def __init__(self, codec: Codec) -> None:
        super().__init__()
        self.codec, self.older = codec, {}

    def __missing__(self, chunk: str) -> tuple[str, int, bytes]:
        made = self.older.get(chunk) or self._made(chunk)
        if len(chunk) <= CACHED_LENGTH:
            if len(self) >= self.codec.cached:
                self.older = dict(self)
                self.clear()
            self[chunk] = made
        return made

    def _made(self, chunk: str) -> tuple[str, int, bytes]:
        codec = self.codec
        ids = codec.chunk_ids(chunk)
        return ",".join([codec.names[i] for i in ids]), len(ids), codec.raw(ids)


class Codec:
    """Pieces, scores and byte pieces are read from the model file; the encoding and decoding are done here."""

    def __init__(self, path: str, cached: int = CACHED) -> None:
        self.cached = cached
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        self.length = [len(p) for p in self.pieces]
        self.names = [str(i) for i in range(size)]
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.bytes: dict[int, int] = {}
        self.texts: list[bytes | None] = []
        for i in range(size):
            piece = self.pieces[i]
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.texts.append(None)
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.texts.append(b"")
            else:
                self.ids[piece], self.score[piece] = i, model.get_score(i)
                self.texts.append(piece.replace(_SPACE, " ").encode())
        self.byte_of = {i: bytes([b]) for b, i in self.bytes.items()}
        if any(_SPACE in p.lstrip(_SPACE) for p in self.ids):
            raise ValueError("a piece holds white space inside: chunks cannot start at white space")
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            self.automaton.add_word(piece, self.ids[piece])
        self.automaton.make_automaton()
        # The next shorter token that starts a piece: another piece, or the first character.
        self.shorter: list[int | None] = [None] * size
        for piece, i in self.ids.items():
            if len(piece) > 1:
                heads = (piece[:k] for k in range(len(piece) - 1, 1, -1))
                self.shorter[i] = next((self.ids[h] for h in heads if h in self.ids), None)
                if self.shorter[i] is None:
                    self.shorter[i] = self._char(piece[0])
        lone = "".join(c for c in map(chr, range(1, 32)) if not any(c in p for p in self.ids))
        apart = re.escape(lone)
        self.chunks = re.compile(f"{_SPACE}+[^{_SPACE}{apart}]*|[^{_SPACE}{apart}]+" + (f"|[{apart}]" if lone else ""))
        self._pairs: dict[int, bool] = {}
        self.chunk = _Chunks(self)

    def merge(self, text: str) -> list[str]:
        """Plain merging of a short text: always the best-scored pair, the leftmost of equals."""
        parts, score = list(text), self.score.get
        pairs = [score(a + b, _NEVER) for a, b in zip(parts, parts[1:])]
        while pairs:
            best = max(pairs)
            if best == _NEVER:
                break
            at = pairs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = score(parts[at - 1] + parts[at], _NEVER)
            if at < len(pairs):
                pairs[at] = score(parts[at] + parts[at + 1], _NEVER)
        return parts

    def apart(self, left: int, right: int) -> bool:
        """Whether two adjacent tokens stay as they are when merged anew; ``left`` is -1 at the start."""
        key = left * _PAIR + right
        known = self._pairs.get(key)
        if known is None:
            token = self._text(right)
            before = [self._text(left)] if left >= 0 else []
            known = self.merge("".join([*before, token])) == [*before, token]
            if len(self._pairs) >= self.cached:
                self._pairs.clear()
            self._pairs[key] = known
        return known

    def _text(self, token: int) -> str:
        return self.pieces[token] if token < self.size else chr(token - self.size)

    def _char(self, char: str) -> int:
        """The token of one character: its piece, or a number past all ids if it has none."""
        return self.ids.get(char, self.size + ord(char))

    def _longest(self, chunk: str, at: int) -> int:
        for end, token in self.automaton.iter_long(chunk, at):
            return token if end - self.length[token] + 1 == at else self._char(chunk[at])
        return self._char(chunk[at])

    def tokens(self, chunk: str) -> list[int]:
        """The tokens of a chunk; a character without a piece is a token of its own."""
        length, shorter, known, n = self.length, self.shorter, self._pairs, len(chunk)
        longest = {end - length[token] + 1: token for end, token in self.automaton.iter_long(chunk)}
        failed: bytearray | None = None  # a bit for each place
        taken: list[int] = []
        at, before = 0, -1
        token = longest.get(0)
        if token is None:
            token = self._char(chunk[0])
        while True:
            end = at + (length[token] if token < self.size else 1)
            if (known.get(before * _PAIR + token) or self.apart(before, token)) and not (
                failed and failed[end >> 3] >> (end & 7) & 1
            ):
                taken.append(token)
                if end == n:
                    return taken
                at, before = end, token
                token = longest.get(at)
                if token is None:
                    token = self._longest(chunk, at)
                continue
            token = shorter[token] if token < self.size else None
            while token is None:  # no token leads on from here
                if failed is None:
                    failed = bytearray((n >> 3) + 1)
                failed[at >> 3] |= 1 << (at & 7)
                last = taken.pop()
                at -= length[last] if last < self.size else 1
                before = taken[-1] if taken else -1
                token = shorter[last] if last < self.size else None

    def chunk_ids(self, chunk: str) -> list[int]:
        tokens = self.tokens(chunk)
        if max(tokens) < self.size:
            return tokens
        out: list[int] = []
        for token in tokens:
            out += [token] if token < self.size else [self.bytes[b] for b in chr(token - self.size).encode()]
        return out

    def split(self, text: str) -> list[str]:
        return self.chunks.findall(_SPACE + text.replace(" ", _SPACE)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for c in self.split(text) for i in self.chunk_ids(c)]

    def raw(self, ids: Sequence[int]) -> bytes:
        return b"".join(self.byte_of[i] if self.texts[i] is None else self.texts[i] for i in ids)

    def decode(self, ids: Sequence[int]) -> str:
        """The text of any ids: white space restored, the prefix dropped, bytes that make no character replaced."""
        raw = self.raw(ids)
        if ids and self.texts[ids[0]] is not None and raw.startswith(b" "):
            raw = raw[1:]
        return raw.decode("utf-8", "replace")

    def parts(self, raw: bytes) -> tuple[int, str, bytes]:
        """Number of ids, the ids joined by commas, and the decoded text."""
        found = list(map(self.chunk.__getitem__, self.split(raw.decode("utf-8", "replace"))))
        return sum([f[1] for f in found]), ",".join([f[0] for f in found]), b"".join([f[2] for f in found])[1:]

    def digest(self, raw: bytes) -> tuple[int, str, str]:
        """Number of ids, and the digests of the ids joined by commas and of the decoded text."""
        n, ids, decoded = self.parts(raw)
        return n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()


DIGEST = T.StructType(
    [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
)
ENCODED = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])


def _codec(path: str, cached: int) -> Codec:
    """The one codec of a worker; another path or size takes its place."""
    if _CODECS.get("of") != (path, cached):
        _CODECS.clear()
        _CODECS.update({"of": (path, cached), "codec": Codec(path, cached)})
    return _CODECS["codec"]


_CODECS: dict = {}


def digests(
    docs: DataFrame, model: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text", cached: int = CACHED
) -> DataFrame:
    """``keep``, n_tokens, ids_sha256 and decoded_sha256 of every row; no shuffle.

    ``model`` is a file that every executor can open. NULL and empty texts have no ids. Rows are read one by one, so
    repeated rows and NULL ids change nothing; very long texts are read chunk by chunk. ``cached`` chunks are remembered
    by a task.
    """
    return per_text(docs, lambda: _codec(model, cached).digest, DIGEST, keep, text)


def encoded(
    docs: DataFrame, model: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text", cached: int = CACHED_WITH_IDS
) -> DataFrame:
    """``keep``, the ids themselves and the text they decode to."""

    def make():
        codec = _codec(model, cached)

        def read(raw: bytes) -> tuple:
            n, ids, decoded = codec.parts(raw)
            return np.fromstring(ids, np.int32, sep=",") if n else [], decoded.decode("utf-8", "replace")

        return read

    return per_text(docs, make, ENCODED, keep, text)

"""Byte-level BPE encoding and decoding by longest matches and backtracking.

The bytes of a piece are mapped to Latin-1 characters, one Aho-Corasick pass finds the longest
token at each place, and the encoder goes left to right: it takes the longest token that may stand
after the one before it, tries shorter ones, and steps back when none fits. Two tokens may stand
side by side when merging their joined bytes gives those two again; this is memoised. It is decided
on the merge trees: the parts along the right edge of the first token and the left edge of the second
meet while merging, and the pair breaks if two of them have a merge that comes before the merges
that take them into their own tokens. A sequence in which every neighbouring pair is compatible is
the one the merge rules make, so the ids equal those of repeated merging by rank, in time linear in
the piece.

Every match of the splitting pattern is encoded by itself, without special tokens.

Defined cases: a null or empty text has no tokens and decodes to no bytes; texts of any length are
encoded whole; rows are independent, so ties, repeated rows and null ids pass through as they are;
an empty table gives an empty result; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterator
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import kept, slices

#: Pieces that one generation of a worker's cache keeps, and the longest one kept: memory stays bounded.
CACHE_PIECES = 100_000
CACHE_CHARS = 48
#: Longer texts are split piece by piece instead of into one list.
LONG_TEXT = 1 << 20


def load_ranks(path: str) -> list[bytes]:
    """Tokens by rank from a file of ``base64 rank`` lines; ranks must be 0, 1, 2 and so on."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def _ranges(kind: str) -> str:
    """The characters below 256 of a class, as the inside of a bracket expression."""
    return "".join(f"\\x{c:02x}" for c in range(256) if regex.fullmatch(kind, chr(c)))


def narrow_pattern(pattern: str) -> re.Pattern | None:
    """The pattern for texts whose characters are all below 256, with its classes spelled out for the
    faster standard module; None if it has classes other than those handled here."""
    out, inside = [], False
    for part in regex.findall(r"\\[pP]\{\w+\}|\\.|.", pattern, regex.DOTALL):
        if part in ("[", "]"):
            inside = part == "["
        if part.startswith((r"\p", r"\s")):
            part = _ranges(part) if inside else f"[{_ranges(part)}]"
        elif part == r"\S" and not inside:
            part = f"[^{_ranges(r'\s')}]"
        elif part[0] == "\\" and part[1].isalnum():
            return None
        out.append(part)
    return re.compile("".join(out))


class Pieces(dict):
    """Piece to id bytes, in two generations: a full one becomes the old one, from which pieces in use come back."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            found = self.encode(piece.encode())
            ids = struct.pack(f"<{len(found)}I", *found)
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_PIECES:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Bpe:
    """Encoder and decoder for one vocabulary."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens = tokens
        self.ranks, self.sizes = {t: i for i, t in enumerate(tokens)}, [len(t) for t in tokens]
        self.pattern, self.narrow = regex.compile(pattern), narrow_pattern(pattern)
        self.matcher = ahocorasick.Automaton()
        for i, t in enumerate(tokens):
            self.matcher.add_word(t.decode("latin-1"), i)
        self.matcher.make_automaton()
        #: For each token the longest token that is a proper prefix of it; -1 if there is none.
        self.shorter = [next((self.ranks[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.ranks), -1) for t in tokens]
        self._pairs: dict[int, bool] = {}
        self._edges: tuple[dict, dict] = ({}, {})
        self._pieces = Pieces(self.encode_piece)

    def merged(self, raw: bytes, parts_left: int = 1) -> list[bytes]:
        """The merge rules applied literally until ``parts_left`` parts are left; used on single tokens' bytes."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > parts_left:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], len(self.ranks)))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def edge(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """The parts of the token along its left (0) or right (1) edge, largest first, each with the rank
        of the merge that takes it into the next larger one (none for the token itself)."""
        known = self._edges[side].get(token)
        if known is None:
            raw = self.tokens[token]
            known = [(raw, len(self.ranks))]
            if len(raw) > 1:
                halves = self.merged(raw, 2)
                if len(halves) == 2:
                    half, *rest = self.edge(self.ranks[halves[side]], side)
                    known = [*known, (half[0], token), *rest]
            self._edges[side][token] = known
        return known

    def compatible(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left``; ``left`` of -1 stands for the start."""
        if len(self._pairs) > 2 * CACHE_PIECES:
            self._pairs.clear()
            for edges in self._edges:
                edges.clear()
        if left < 0:
            known = len(self.merged(self.tokens[right])) == 1
        else:  # of equal merges the left one comes first
            none, rank = len(self.ranks), self.ranks.get
            known = not any(
                (m := rank(a + b, none)) < until_a and m <= until_b and m < none
                for a, until_a in self.edge(left, 1) for b, until_b in self.edge(right, 0)
            )
        self._pairs[left * len(self.tokens) + right] = known
        return known

    def encode_piece(self, raw: bytes) -> list[int]:
        whole = self.ranks.get(raw)
        if whole is not None:  # a piece that is a token is that token
            return [whole]
        text, known, size = raw.decode("latin-1"), self._pairs.get, len(self.tokens)
        # longest matches one after the other; many pieces need no step back
        out = [token for _, token in self.matcher.iter_long(text)]
        last = -1
        for token in out:
            fits = known(last * size + token)
            if not (self.compatible(last, token) if fits is None else fits):
                return self._backtracked(text)
            last = token
        return out

    def _backtracked(self, text: str) -> list[int]:
        n, size, sizes, shorter, known = len(text), len(self.tokens), self.sizes, self.shorter, self._pairs.get
        longest = [-1] * n
        for end, token in self.matcher.iter(text):
            longest[end - sizes[token] + 1] = token  # for one start, later ends are longer
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token, last = 0, longest[0], -1
        while at < n:
            while token >= 0:
                end = at + sizes[token]
                if not dead[end]:
                    fits = known(last * size + token)
                    if self.compatible(last, token) if fits is None else fits:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at, last = end, token
                token = longest[at] if at < n else -1
            elif out:  # nothing fits here: give up this place and the token that led to it
                dead[at] = 1
                token = out.pop()
                at -= sizes[token]
                last = out[-1] if out else -1
                token = shorter[token]
            else:
                raise ValueError("the vocabulary does not cover every byte")
        return out

    def pattern_for(self, text: str) -> re.Pattern:
        if self.narrow is not None:
            try:
                text.encode("latin-1")
                return self.narrow
            except UnicodeEncodeError:
                pass
        return self.pattern

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        pattern, known = self.pattern_for(text), self._pieces.__getitem__
        if len(text) <= LONG_TEXT:
            return b"".join(map(known, pattern.findall(text)))
        found, out = (m.group() for m in pattern.finditer(text)), []
        while part := list(islice(found, 100_000)):
            out.append(b"".join(map(known, part)))
        return b"".join(out)

    def decode(self, ids: bytes | None) -> bytes:
        if not ids:
            return b""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``token_ids``: the ids of every whole text as little-endian unsigned 32-bit integers.

    The vocabulary is read on the driver and broadcast (one file of fixed size). A worker keeps its encoder for its next task
    of this operator and drops it when it takes one of another.
    """
    tokens = df.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))
    narrow = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = kept("bpe", (id(tokens.value), pattern), lambda: Bpe(tokens.value, pattern))
        for batch in batches:
            for part in slices(batch, "text"):
                ids = pa.array([bpe.encode(t) for t in part.column("text").to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("id"), ids], ["id", "token_ids"])

    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"id {kind}, token_ids binary").withColumnRenamed("id", id_col)


def decode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """``id_col``, ``ids_col`` and ``decoded``: the bytes that the ids stand for."""
    tokens = df.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))
    narrow = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("token_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = tokens.value
        for batch in batches:
            for part in slices(batch, "token_ids"):
                raw = [b"".join(map(vocab.__getitem__, np.frombuffer(x, "<u4").tolist())) if x else b"" for x in part.column("token_ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("token_ids"), pa.array(raw, pa.binary())], ["id", "token_ids", "decoded"])

    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"id {kind}, token_ids binary, decoded binary").withColumnsRenamed({"id": id_col, "token_ids": ids_col})


def round_trip(df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of the whole text encoded and decoded again."""
    both = decode(encode(df, vocabulary, pattern, id_col, text_col), vocabulary, id_col)
    return both.select(
        F.col(id_col),
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

"""Operator 8: SentencePiece encoding and decoding by a merge-type prefix table.

A byte-pair encoding of a text is valid exactly if each pair of neighbouring tokens is: if encoding the two alone gives
just these two. So every prefix of a chunk has one last token: the one token that ends there, is its own encoding and is
compatible with the last token of the prefix before it. An Aho-Corasick automaton gives the tokens that end at each
place, the pair test picks the right one, and the ids are recovered backwards from the table of last tokens. No merge
queue runs over the text; work is linear in the text for pieces of bounded length.

Characters without a piece never merge; they become byte tokens. Pieces of spaces alone tie in score, so their order of
merging is by place; a chunk's leading spaces are therefore encoded by length (see Codec.run).
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
import struct

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, pieces

#: Chunk encodings that a Python worker remembers, twice over (see pieces.Memo), and pair tests; those start anew when full.
MEMO = 150_000
PAIRS = 400_000


class Codec:
    """Encoder and decoder of a BPE model file with byte fallback, identity normalisation and a dummy prefix."""

    def __init__(self, path: str):
        import sentencepiece  # reads the model file: pieces, scores and kinds; it encodes nothing here

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size, self.bos, self.eos, self.unk = sp.vocab_size(), sp.bos_id(), sp.eos_id(), sp.unk_id()
        self.piece = [sp.id_to_piece(i) for i in range(self.size)]
        special = {i for i in range(self.size) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        of_byte = {i: int(self.piece[i][1:-1], 16) for i in range(self.size) if sp.is_byte(i)}
        self.byte = [next((i for i, v in of_byte.items() if v == b), self.unk) for b in range(256)]
        self.ids = {self.piece[i]: i for i in range(self.size) if i not in special and i not in of_byte}
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.apart = pieces.separable(self.ids)
        self.own = [i not in special and i not in of_byte for i in range(self.size)]
        plain = [p for p in self.ids if set(p) != {pieces.SPACE}]
        # The order of merges must not depend on the place but for spaces: equal scores elsewhere would need the queue.
        self.unique = len({self.score[p] for p in plain if len(p) > 1}) == sum(len(p) > 1 for p in plain)
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if p == pieces.SPACE or set(p) != {pieces.SPACE}:
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.bytes = [b"" if i in special else bytes([of_byte[i]]) if i in of_byte else p.replace(pieces.SPACE, " ").encode() for i, p in enumerate(self.piece)]
        self.bytes[self.unk] = " ⁇ ".encode()
        self.pairs: dict[int, bool] = {}
        self.runs: dict[int, list[int]] = {}
        self.memo = pieces.Memo(self.chunk, MEMO)
        letters = "".join(re.escape(p) for p in self.ids if len(p) == 1)
        self.strange = re.compile(f"([^{letters}])")

    def merge(self, symbols: list[str]) -> list[str]:
        """Merges neighbours, best score first and leftmost first, until none has a piece. For pair tests and runs."""
        left, right = list(range(-1, len(symbols) - 1)), [*range(1, len(symbols)), -1]
        queue: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (p := symbols[a] + symbols[b]) in self.score:
                heapq.heappush(queue, (-self.score[p], a, b, p))

        for a in range(len(symbols) - 1):
            offer(a, a + 1)
        while queue:
            _, a, b, p = heapq.heappop(queue)
            if right[a] != b or symbols[a] + symbols[b] != p or not symbols[b]:
                continue
            symbols[a], symbols[b] = p, ""
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [x for x in symbols if x]

    def fits(self, a: int, b: int) -> bool:
        """Whether tokens a and b, side by side, are the encoding of their text. a = size: b alone."""
        k = a * (self.size + 1) + b
        got = self.pairs.get(k)
        if got is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            first = [] if a == self.size else [self.piece[a]]
            got = self.pairs[k] = self.merge(list("".join(first) + self.piece[b])) == [*first, self.piece[b]]
        return got

    def run(self, n: int) -> list[int]:
        """The encoding of n spaces that join nothing else: whatever stands after them has merged before, by its score."""
        if n not in self.runs:
            if len(self.runs) > 10_000:
                self.runs.clear()
            self.runs[n] = [self.ids[x] for x in self.merge([pieces.SPACE] * n)]
        return self.runs[n]

    def known(self, text: str) -> list[int]:
        """The encoding of a text whose characters all have pieces: fills the table of last tokens, then walks it back."""
        n = len(text)
        last, width = [-1] * (n + 1), [0] * (n + 1)  # of each prefix: its last token, and that token's characters
        last[0] = self.size
        pairs, row = self.pairs, self.size + 1
        for end, (i, k) in self.automaton.iter(text):
            end += 1
            if last[end] < 0:
                before = last[end - k]
                if before >= 0:
                    ok = pairs.get(before * row + i)
                    if ok or ok is None and self.fits(before, i):
                        last[end], width[end] = i, k
        out = []
        while n:
            out.append(last[n])
            n -= width[n]
        out.reverse()
        return out

    def word(self, text: str) -> list[int]:
        """The encoding of any text in which spaces, if any, come first and but one. Characters without a piece stand apart."""
        out: list[int] = []
        for part in self.strange.split(text):
            if len(part) == 1 and part not in self.ids:
                out += [self.byte[b] for b in part.encode()]
            elif part:
                out += self.known(part)
        return out

    def chunk(self, text: str) -> bytes:
        """The ids of a chunk (see pieces.chunks), little-endian."""
        if text[:1] == "\n":
            ids = self.word(text)
        else:
            body = text.lstrip(" ")
            spaces = len(text) - len(body)
            ids = self.word(pieces.SPACE + body) if body else self.run(spaces + 1)
            if body and spaces:
                # A last space that joined no character merges with the others.
                ids = self.run(spaces + 1) + ids[1:] if ids[0] == self.ids[pieces.SPACE] else self.run(spaces) + ids
        return _packer(len(ids))(*ids)

    def encode(self, text: str) -> bytes:
        """The ids without begin and end, as little-endian unsigned 32-bit integers."""
        # The model reads U+2581 as a space.
        return b"".join(map(self.memo.__getitem__, pieces.chunks(text.replace(pieces.SPACE, " "))))

    def decode(self, ids: bytes) -> bytes:
        """The text in UTF-8. Begin and end give nothing; bytes that are no UTF-8 give U+FFFD each."""
        got = np.frombuffer(ids, "<u4").tolist()
        first = next((i for i in got if i not in (self.bos, self.eos)), None)
        out = b"".join(map(self.bytes.__getitem__, got))
        if first is not None and self.own[first] and self.piece[first].startswith(pieces.SPACE):
            out = out[1:]
        try:
            out.decode()
        except UnicodeDecodeError:
            out = out.decode("utf-8", "surrogateescape").translate(_LONE).encode()
        return out


_packer = functools.cache(lambda n: struct.Struct(f"<{n}I").pack)
_LONE = {0xDC00 + b: 0xFFFD for b in range(128, 256)}


@functools.cache
def codec(path: str) -> Codec:
    """Loaded once a worker. Models that the method can't encode exactly are refused, not approximated."""
    c = Codec(path)
    if not (c.apart and c.unique):
        raise ValueError("pieces that cross spaces, or tied scores: the prefix table can't reproduce this model")
    return c


SCHEMA = "n_tokens bigint, ids binary, decoded string"


def encode_decode(docs: DataFrame, path: str, digests: bool = False) -> DataFrame:
    """doc_id with n_tokens, ids (little-endian unsigned 32-bit, begin and end included) and the text decoded from them.

    digests: ids_sha256 and decoded_sha256 in place of ids and decoded, taken in the same task, so the ids of a corpus needn't
    leave it. Null text counts as empty: begin and end only, decoded to the empty text. One output row an input row.
    """

    def run(batches):
        c = codec(path)
        begin, end = (np.array([x], "<u4").tobytes() for x in (c.bos, c.eos))
        for b in common.sliced(batches):
            n, ids, out = [], [], []
            for t in b.column(1):
                i = begin + c.encode(t.as_py() or "") + end
                d = c.decode(i)
                n.append(len(i) // 4)
                ids.append(hashlib.sha256(i).hexdigest() if digests else i)
                out.append(hashlib.sha256(d).hexdigest() if digests else d.decode())
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string() if digests else pa.binary()), pa.array(out, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    names = ["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]
    kinds = f"doc_id bigint, n_tokens bigint, {names[2]} {'string' if digests else 'binary'}, {names[3]} string"
    return common.take(docs).select("doc_id", F.col("text")).mapInArrow(run, kinds)

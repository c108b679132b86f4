"""SentencePiece BPE encoding by backtracking, and decoding.

The vocabulary of a merge-type (BPE) model is read once a task. A text becomes
word-like segments that no merge can cross; each segment is encoded by
backtracking over Aho-Corasick matches: the longest piece that is compatible with
the piece before it is taken, and a bitfield keeps the positions that turned out
to lead nowhere. Two pieces are compatible when merging their characters anew,
by the model's scores, gives the same two pieces; verdicts and short segments
are memoised in bounded tables, which a task empties when it ends, as its Python worker
lives on.

Defined results: null text counts as empty, and an empty text has no ids; rows
are never dropped, repeated rows give repeated results; columns other than the
new ones pass through, columns of the same names as the new ones are replaced.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, list_array, map_arrow, map_texts

SPACE = "▁"
LONGEST_KEPT = 64
NEVER = float("-inf")


def _invalid_bytes(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


class BacktrackingCodec:
    """Encoder and decoder of one BPE model file with byte fallback and no normalisation."""

    def __init__(self, model: str):
        import codecs

        codecs.register_error("each_byte", _invalid_bytes)
        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        size = sp.get_piece_size()
        self.score: dict[str, float] = {}
        self.id_of: dict[str, int] = {}
        self.byte_id: dict[int, int] = {}
        self.surface: list[bytes] = []
        self.plain = np.zeros(size, dtype=bool)
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[1:-1], 16)
                self.byte_id[value] = i
                self.surface.append(bytes([value]))
            elif sp.is_control(i):
                self.surface.append(b"")
            elif sp.is_unknown(i):
                self.surface.append(" ⁇ ".encode())
            else:
                self.surface.append(piece.replace(SPACE, " ").encode())
                self.plain[i] = True
                if not sp.is_unused(i):
                    self.id_of[piece] = i
                    self.score[piece] = sp.get_score(i)
        self.piece_of = {i: p for p, i in self.id_of.items()}
        self.known = {p for p in self.id_of if len(p) == 1}
        self.control = {i for i in range(size) if sp.is_control(i)}
        self.crossing = any(SPACE in p.lstrip(SPACE) for p in self.id_of)
        if self.crossing:
            raise ValueError("pieces with a space inside need another segmentation")
        self.matches = ahocorasick.Automaton()
        for piece, i in self.id_of.items():
            if len(piece) == 1 or self.merged(piece) == [piece]:
                self.matches.add_word(piece, (len(piece) - 1, i))
        self.matches.make_automaton()
        self.length = [len(self.piece_of.get(i, "")) for i in range(size)]
        self.shorter = [0] * size  # the longest piece that is a proper beginning of a piece; 0 (unknown): none
        for piece, i in self.id_of.items():
            self.shorter[i] = next((self.id_of[piece[:k]] for k in range(len(piece) - 1, 0, -1) if piece[:k] in self.matches), 0)
        # No piece goes from a word character to another kind of character, but for the loose ones; so segments end there.
        loose = "_" + "".join(sorted({a for p in self.id_of for a, b in zip(p, p[1:], strict=False) if a.isalnum() and not b.isalnum()}))
        self.split = re.compile(rf"\n|{SPACE}*(?:[^\w{SPACE}\n]+|[{loose}]+)*[^\W{loose}]*")
        self.compatible = Memo(self._compatible, 500_000)
        self.short = Memo(self._segment_bytes, 100_000)
        self.words = Memo(self._word_bytes, 400_000)
        self.raw = [np.int32(i).tobytes() for i in range(size)]

    def merged(self, text: str) -> list[str]:
        """Merges characters pair by pair: the best score first, the leftmost of equals."""
        parts, score = list(text), self.score.get
        found = [score(a + b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        while found and (best := max(found)) != NEVER:
            k = found.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del found[k]
            if k:
                found[k - 1] = score(parts[k - 1] + parts[k], NEVER)
            if k < len(found):
                found[k] = score(parts[k] + parts[k + 1], NEVER)
        return parts

    def _compatible(self, pair: tuple[int, int]) -> bool:
        left, right = self.piece_of[pair[0]], self.piece_of[pair[1]]
        return self.merged(left + right) == [left, right]

    def _backtrack(self, text: str) -> list[int]:
        """The only sequence of pieces over known characters whose neighbours are all compatible."""
        n = len(text)
        longest = [0] * n
        for end, (back, piece) in self.matches.iter(text):
            longest[end - back] = piece  # matches come by their ends, so the longest stays
        compatible, shorter, length = self.compatible, self.shorter, self.length
        failed, dirty = bytearray(n // 8 + 1), False
        ids: list[int] = []
        at, piece = 0, longest[0]
        while True:
            while piece:
                end = at + length[piece]
                if (not ids or compatible[ids[-1], piece]) and not (dirty and failed[end >> 3] >> (end & 7) & 1):
                    break
                piece = shorter[piece]
            if piece:
                ids.append(piece)
                if end == n:
                    return ids
                at, piece = end, longest[end]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                dirty = True
                last = ids.pop()
                at -= length[last]
                piece = shorter[last]

    def _segment_bytes(self, segment: str) -> bytes:
        raw = self.raw
        if self.known.issuperset(segment):
            return b"".join(map(raw.__getitem__, self._backtrack(segment))) if segment else b""
        done: list[bytes] = []
        start = 0
        for k, c in enumerate(segment):
            if c not in self.known:
                if k > start:
                    done += map(raw.__getitem__, self._backtrack(segment[start:k]))
                done += (raw[self.byte_id[b]] for b in c.encode())
                start = k + 1
        if start < len(segment):
            done += map(raw.__getitem__, self._backtrack(segment[start:]))
        return b"".join(done)

    def _spaced_bytes(self, text: str) -> bytes:
        """Of a text whose spaces are written as in the pieces."""
        words, short = self.words, self.short
        return b"".join([self._segment_bytes(s) if len(s) > LONGEST_KEPT else words[s[1:]] if s[:1] == SPACE else short[s] for s in self.split.findall(text)])

    def _word_bytes(self, word: str) -> bytes:
        """Of what stands between two single spaces, the one before it included; a line break stands for that space.

        Segments that begin with a space are kept here only, as the words they would be.
        """
        text = word if word[:1] == "\n" else SPACE + word
        whole = self.split.match(text)
        return self._segment_bytes(text) if whole.end() == len(text) else self._spaced_bytes(text)

    def forget(self) -> None:
        """Empties the tables."""
        for table in (self.compatible, self.short, self.words):
            table.forget()

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype=np.int32)
        apart = text.replace("\n", " \n") if "\n" in text else text
        if apart[0] == " " or "  " in apart or SPACE in text:
            found = self._spaced_bytes(SPACE + text.replace(" ", SPACE))
        else:
            found = b"".join(map(self.words.__getitem__, apart.split(" ")))
        return np.frombuffer(found, dtype=np.int32)

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.surface.__getitem__, ids.tolist()))
        if raw[:1] == b" ":
            first = next((i for i in ids.tolist() if i not in self.control), None)
            if first is not None and self.plain[first]:
                raw = raw[1:]
        return raw.decode("utf-8", "each_byte")


@lru_cache(maxsize=2)
def codec(model: str) -> BacktrackingCodec:
    return BacktrackingCodec(model)


def encode(df: DataFrame, model: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the ids of each text (array<int>); model is a path that every worker can read."""

    def make():
        c = codec(model)

        def work(texts: list[str]) -> list[pa.Array]:
            found = [c.encode(t) for t in texts]
            return [list_array(np.concatenate([np.zeros(0, np.int32), *found]), [len(x) for x in found], pa.int32())]

        return work

    return map_texts(df, make, f"`{ids}` array<int>", text, lambda: codec(model).forget())


def decode(df: DataFrame, model: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds the text of each sequence of ids (null: empty)."""
    kept = [c for c in df.columns if c != decoded]
    schema = df.select(*kept).schema.add(decoded, "string")
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(f"`{ids}`"), F.array().cast("array<int>")).alias("__ids"))

    def run(batches):
        c = codec(model)
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            texts = pa.array([c.decode(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], names=[*batch.schema.names[:-1], decoded])

    return map_arrow(source, run, schema)


def encode_decode(df: DataFrame, model: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds ids and the text decoded from them, in one pass over the rows."""

    def make():
        c = codec(model)

        def work(texts: list[str]) -> list[pa.Array]:
            found = [c.encode(t) for t in texts]
            return [list_array(np.concatenate([np.zeros(0, np.int32), *found]), [len(x) for x in found], pa.int32()), pa.array([c.decode(x) for x in found], pa.string())]

        return work

    return map_texts(df, make, f"`{ids}` array<int>, `{decoded}` string", text, lambda: codec(model).forget())


def digests(df: DataFrame, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Per row: doc_id, the number of ids, and SHA-256 of the ids and of the decoded text."""
    return df.select(
        "doc_id",
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids).cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col(decoded), 256).alias("decoded_sha256"),
    )

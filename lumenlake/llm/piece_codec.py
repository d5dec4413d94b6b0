"""Merge-type (BPE) piece encoding by a prefix table, and decoding.

A text is encoded as a row of pieces in which every two neighbours are compatible:
merging their joint string gives exactly these two pieces. That row is unique, and
so is the last piece of every prefix. The table holds that piece for each prefix:
an automaton reports the pieces that end there, and the one compatible with the
last piece of the prefix before it is the answer. Ids are then read backwards.

Texts are cut where no piece can cross (before blanks, around characters without a
piece), and the ids of such a stretch are remembered per worker, so a frequent word
is worked out once.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The mark that stands for a blank in pieces.
MARK = "▁"
# Remembered stretches and pairs per worker; beyond it the memory starts anew.
MEMORY = 400_000
# Rows per Arrow batch on the way back.
ROWS = 500

_SCHEMA = "doc_id long, ids array<int>, text string"


def _one_byte(error: UnicodeError) -> tuple[str, int]:
    """Each invalid byte becomes one replacement character."""
    return "�", error.start + 1


codecs.register_error("piece_byte", _one_byte)


class PieceCodec:
    """Encoder and decoder for one merge-type model file."""

    def __init__(self, model_file: str):
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.normalize = model.normalize
        # Blank to mark, one mark in front, nothing else: then plain string work does it.
        self.plain = model.normalize(" a  b\tﬁ ") == f"{MARK}{MARK}a{MARK}{MARK}b\tﬁ{MARK}"
        self.score: dict[str, float] = {}
        self.id_of: dict[str, int] = {}
        self.surface: list[bytes] = []
        byte_ids = [0] * 256
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            if model.is_unused(i):
                raise ValueError("models with unused pieces are not supported")
            if model.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
                self.surface.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i):
                self.surface.append(b"")
            elif model.is_unknown(i):
                self.unknown = i
                self.surface.append(" ⁇ ".encode())
            else:
                self.score[piece] = model.get_score(i)
                self.id_of[piece] = i
                self.surface.append(piece.replace(MARK, " ").encode())
        self.byte_ids = byte_ids if all(byte_ids) else None
        self.blank_first = {i for piece, i in self.id_of.items() if piece.startswith(MARK)}
        self.automaton = ahocorasick.Automaton()
        for piece in self.score:
            self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        inside = {c for piece in self.score for c in piece}
        crossing = any(a != MARK and b == MARK for piece in self.score for a, b in zip(piece, piece[1:]))
        loose = "".join(c for c in "\n\t\r" if c not in inside)
        one = f"[{loose}]|" if loose else ""
        # Without crossing pieces each blank run starts a stretch of its own.
        self.stretches = None if crossing else re.compile(f"{one} *[^ {loose}]+| +")
        self.pairs: dict[tuple[str, str], bool] = {}
        self.known: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """Pieces of a short string by repeated best merges, the leftmost of equals first."""
        symbols = list(text)
        score = self.score
        while len(symbols) > 1:
            best, at = None, 0
            for i in range(len(symbols) - 1):
                s = score.get(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def compatible(self, left: str, right: str) -> bool:
        """Do the merges of both strings together never cross the border between them?"""
        pair = (left, right)
        fits = self.pairs.get(pair)
        if fits is None:
            if len(self.pairs) >= MEMORY:
                self.pairs.clear()
            fits = self.pairs[pair] = self.merged(left + right) == ([left, right] if left else [right])
        return fits

    def last_pieces(self, text: str) -> list[str]:
        """For each prefix of `text`, the last piece of its encoding; the empty prefix has none."""
        last: list[str] = [""] * (len(text) + 1)
        done = 0
        for end, piece in self.automaton.iter(text):
            while done < end:
                done += 1
                last[done] = last[done] or text[done - 1]
            if not last[end + 1] and self.compatible(last[end + 1 - len(piece)], piece):
                last[end + 1] = piece
        while done < len(text):
            # Nothing that ends here is a piece in this place: a character of its own.
            done += 1
            last[done] = last[done] or text[done - 1]
        return last

    def stretch_ids(self, text: str) -> bytes:
        """Ids of one stretch, as 32-bit integers; read from the end of the prefix table."""
        last, at, found = self.last_pieces(text), len(text), []
        while at:
            piece = last[at]
            i = self.id_of.get(piece)
            if i is not None:
                found.append(i)
            elif self.byte_ids is not None:
                found.extend(self.byte_ids[b] for b in reversed(piece.encode()))
            elif not found or found[-1] != self.unknown:
                found.append(self.unknown)
            at -= len(piece)
        return np.array(found[::-1], np.int32).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        if not text:
            return np.empty(0, np.int32)
        if self.plain:
            spaced = " " + text.replace(MARK, " ")
        else:
            spaced = self.normalize(text).replace(MARK, " ")
        known, parts = self.known, []
        for stretch in self.stretches.findall(spaced) if self.stretches else [spaced]:
            ids = known.get(stretch)
            if ids is None:
                if len(known) >= MEMORY:
                    known.clear()
                ids = self.stretch_ids(stretch.replace(" ", MARK))
                if len(stretch) < 64:
                    known[stretch] = ids
            parts.append(ids)
        return np.frombuffer(b"".join(parts), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: surfaces in order, bytes read as UTF-8, without the blank put in front."""
        text = b"".join(map(self.surface.__getitem__, ids.tolist())).decode("utf-8", "piece_byte")
        return text[1:] if len(ids) and int(ids[0]) in self.blank_first else text


@lru_cache(maxsize=2)
def codec(model_file: str) -> PieceCodec:
    """The codec of a model file, kept per worker."""
    return PieceCodec(model_file)


def encode_decode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, text): ids of each whole text, without begin or end ids, and the text they decode to.

    Ids and text equal those of the sentencepiece library for merge-type models
    (every pair whose joint string is a piece may merge, best score first), with or
    without byte fallback. A null or empty text has no ids and decodes to "". Rows
    stay as they are, repeated ones and null ids included; other columns are
    ignored. `model_file` must exist where tasks run. Memory per worker is bounded by
    the model, `MEMORY` remembered stretches and the batch in work.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = codec(model_file)
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                batch = whole.slice(first, ROWS)
                ids = [pieces.encode(text or "") for text in batch.column("text").to_pylist()]
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(i) for i in ids], out=offsets[1:])
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id"),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids), pa.int32())),
                    pa.array([pieces.decode(i) for i in ids], pa.string()),
                ], names=["doc_id", "ids", "text"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _SCHEMA)


def digests(coded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encoded and decoded documents."""
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )

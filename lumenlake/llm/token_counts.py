"""Token counts of a unigram vocabulary, by dynamic programming along a trie of pre-tokens.

The distinct pre-tokens of a batch are walked in sorted order, which is the order of
a depth-first walk of their trie: the forward scores of a shared prefix are worked
out once, and each pre-token's count is read at its end. Counts of pre-tokens are
remembered per worker, so most batches only meet new words.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
# A pre-token: a blank run and the word after it, or a line break.
PRETOKEN = re.compile(r"\n| *[^ \n]+| +")
# Remembered pre-tokens per worker; beyond it the memory starts anew.
MEMORY = 400_000

_SCHEMA = "doc_id long, n_pretokens long, n_tokens long, log_prob double"


class UnigramTrie:
    """Best segmentations under log probabilities 1 / (rank + 1), normalised, of the pieces in file order."""

    def __init__(self, model_file: str):
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        kept = [model.id_to_piece(i) for i in range(model.vocab_size())
                if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        total = math.log(sum(1 / (rank + 1) for rank in range(len(kept))))
        self.score = {piece: -math.log(rank + 1) - total for rank, piece in enumerate(kept)}
        # A character without a piece falls back to its bytes, each worth less than any piece.
        self.byte_score = min(self.score.values()) - 10
        self.longest = max(map(len, kept))
        self.known: dict[str, tuple[int, float]] = {}

    def extend(self, text: str, best: list[float], count: list[int], depth: int) -> None:
        """Forward scores of the prefixes of `text` longer than `depth`; shorter ones are in place."""
        del best[depth + 1:], count[depth + 1:]
        score, longest = self.score, self.longest
        for end in range(depth + 1, len(text) + 1):
            n_bytes = len(text[end - 1].encode())
            top, tokens = best[end - 1] + n_bytes * self.byte_score, count[end - 1] + n_bytes
            for start in range(max(0, end - longest), end):
                s = score.get(text[start:end])
                if s is not None:
                    s += best[start]
                    # Of equal scores the segmentation with fewer tokens counts.
                    if s > top or (s == top and count[start] + 1 < tokens):
                        top, tokens = s, count[start] + 1
            best.append(top)
            count.append(tokens)

    def learn(self, pretokens: set[str]) -> None:
        """Counts and scores of pre-tokens, one trie walk for all of them."""
        best, count, before = [0.0], [0], ""
        for word in sorted(w.replace(" ", MARK) for w in pretokens):
            depth, most = 0, min(len(word), len(before))
            while depth < most and word[depth] == before[depth]:
                depth += 1
            self.extend(word, best, count, depth)
            self.known[word.replace(MARK, " ")] = (count[-1], best[-1])
            before = word

    def count(self, texts: list[str]) -> list[tuple[int, int, float]]:
        """(pre-tokens, tokens, log probability) of each text."""
        split = [PRETOKEN.findall(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        if len(self.known) >= MEMORY:
            self.known.clear()
        fresh = set().union(*split).difference(self.known) if split else set()
        self.learn(fresh)
        found = []
        for pretokens in split:
            values = list(map(self.known.__getitem__, pretokens))
            found.append((len(values), sum(v[0] for v in values), math.fsum(v[1] for v in values)))
        for word in fresh:
            if len(word) > 64:
                del self.known[word]
        return found


@lru_cache(maxsize=2)
def trie(model_file: str) -> UnigramTrie:
    """The vocabulary and its remembered pre-tokens, kept per worker."""
    return UnigramTrie(model_file)


def count_tokens(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pretokens, n_tokens, log_prob) of each whole text under a unigram vocabulary.

    The vocabulary is the pieces of `model_file` in file order with Zipf weights; no
    piece crosses a pre-token. A null or empty text counts 0. Rows stay as they are,
    repeated ones and null ids included; other columns are ignored. Memory per worker is
    bounded by `MEMORY` remembered pre-tokens and those of the texts in work.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unigrams = trie(model_file)
        for whole in batches:
            for first in range(0, whole.num_rows, 500):
                batch = whole.slice(first, 500)
                n, tokens, score = zip(*unigrams.count([t or "" for t in batch.column("text").to_pylist()]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(tokens, pa.int64()), pa.array(score, pa.float64())],
                    names=["doc_id", "n_pretokens", "n_tokens", "log_prob"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _SCHEMA)

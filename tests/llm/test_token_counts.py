"""Token counts of whole texts against a plain best-path search."""

import math
import random

import public_tokenizers

from lumenlake.llm.token_counts import MARK, UnigramTrie

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def pretokens(text):
    """A line break alone, or blanks and the word behind them, where a text begins with a blank of its own."""
    out, chars = [], " " + text.replace(MARK, " ") if text else ""
    for c in chars:
        if c == "\n" or not out or out[-1] == "\n" or (c == " " and not out[-1].endswith(" ")):
            out.append(c)
        else:
            out[-1] += c
    return out


def best_path(word, score, byte_score):
    """(tokens, score) of the best segmentation; of equal scores the one with fewer tokens."""
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(word)
    for end in range(1, len(word) + 1):
        n = len(word[end - 1].encode())
        options = [(best[end - 1][0] + n * byte_score, -(best[end - 1][1] + n))]
        options += [(score[word[s:end]] + best[s][0], -(best[s][1] + 1)) for s in range(end) if word[s:end] in score]
        top = max(options)
        best[end] = (top[0], -top[1])
    return best[-1][1], best[-1][0]


def test_whole_texts_equal_plain_search():
    rng = random.Random(11)
    model = UnigramTrie(MODEL)
    pieces = [p.replace(MARK, " ") for p in rng.sample(sorted(model.score), 400)]
    texts = ["", " ", "\n", "  \n ", "a", " a  b\n\nc "]
    for _ in range(250):
        parts = [rng.choice([rng.choice(pieces), rng.choice(["\n", " ", "  ", "\t", "é", "漢", "😀", MARK, "the", "\x00"])]) for _ in range(rng.randrange(25))]
        texts.append("".join(parts))
    got = model.count(texts)
    for text, (n_pretokens, n_tokens, log_prob) in zip(texts, got):
        words = pretokens(text)
        paths = [best_path(w.replace(" ", MARK), model.score, model.byte_score) for w in words]
        assert (n_pretokens, n_tokens) == (len(words), sum(n for n, _ in paths)), repr(text)
        assert log_prob == math.fsum(s for _, s in paths), repr(text)

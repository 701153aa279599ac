"""Token counts by count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary pieces that end at each character; dynamic programming keeps, for
each place, the best score of a segmentation up to it and that segmentation's number of tokens, and nothing else. The
rules are those of a unigram tokenizer with byte fallback: a space becomes U+2581 and begins a word, a text begins with
one, its own or one more, pieces don't cross words; of equal scores the longest last piece wins; a character that no piece covers costs the
lowest score less 10, runs of such characters join to one unknown, and an unknown counts a token for each UTF-8 byte
(one token without byte pieces).

The pieces and scores come from a public vocabulary file, whose path is a parameter. That file's tokenizer merges pairs;
here its pieces and their stored scores serve as a unigram vocabulary, so counts are those of the unigram tokenizer with
that vocabulary and not of the merging one.
"""

from __future__ import annotations

import uuid
from collections import Counter
from functools import partial

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docloom.llm._split import append_columns

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
COUNTED = T.StructType([T.StructField("n_tokens", T.LongType())])
MARK = "▁"
_WORDS_KEPT, _WORD_KEPT = 1 << 20, 64


def read_vocabulary(path: str = VOCABULARY) -> list[tuple[str, float]]:
    """(piece, score) in the order of ids; control pieces keep their place with their names."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class UnigramCounter:
    """Counts tokens of texts. Words of usual length are counted once and kept, up to _WORDS_KEPT of them."""

    def __init__(self, vocabulary: list[tuple[str, float]]) -> None:
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), float(score)))
        if vocabulary:
            self.automaton.make_automaton()
        self.unknown = min((s for _, s in vocabulary), default=0.0) - 10.0
        known = {p for p, _ in vocabulary}
        self.single = {p for p in known if len(p) == 1}
        self.bytes = all(f"<0x{b:02X}>" in known for b in range(256))
        self.empty = not vocabulary
        self.kept: dict[str, int] = {}

    def _word(self, word: str) -> int:
        """Tokens of one word, U+2581 included."""
        if not self.single.issuperset(word):
            return self._word_with_unknowns(word)
        best = [0.0] + [-np.inf] * len(word)
        tokens = [0] * (len(word) + 1)
        for end, (length, score) in self.automaton.iter(word):  # of pieces with one end, the longest comes first
            at = end + 1 - length
            if (s := best[at] + score) > best[end + 1]:
                best[end + 1] = s
                tokens[end + 1] = tokens[at] + 1
        return tokens[-1]

    def _word_with_unknowns(self, word: str) -> int:
        n = len(word)
        best = [0.0] + [-np.inf] * n
        tokens = [0] * (n + 1)
        open_ = [False] * (n + 1)  # the best way here ends in an unknown, which the next unknown joins
        ends: list = [()] * n
        if not self.empty:
            for end, match in self.automaton.iter(word):
                ends[end] = (*ends[end], match)  # longest first
        for end in range(n):
            to, single = end + 1, False
            top, count, unknown = -np.inf, 0, False
            for length, score in ends[end]:
                at = to - length
                single |= length == 1
                if (s := best[at] + score) > top:
                    top, count, unknown = s, tokens[at] + 1, False
            if not single and (s := best[end] + self.unknown) > top:
                cost = len(word[end].encode("utf-8", "replace")) if self.bytes else int(not open_[end])
                top, count, unknown = s, tokens[end] + cost, True
            best[to], tokens[to], open_[to] = top, count, unknown
        return tokens[n]

    def count(self, text: str | None) -> int:
        """Tokens of a whole text; 0 for null and empty ones."""
        if not text:
            return 0
        total, kept = 0, self.kept
        text = text.replace(MARK, " ")
        for word, times in Counter((text[1:] if text[0] == " " else text).split(" ")).items():
            n = kept.get(word)
            if n is None:
                n = self._word(MARK + word)
                if len(word) <= _WORD_KEPT:
                    if len(kept) >= _WORDS_KEPT:
                        kept.clear()
                    kept[word] = n
            total += n * times
        return total


_COUNTERS: dict[str, UnigramCounter] = {}


def count_tokens(docs: DataFrame, vocabulary: list[tuple[str, float]] | str = VOCABULARY, text: str = "text") -> DataFrame:
    """docs with n_tokens of every whole text; null and empty texts have 0.

    Repeated rows get equal counts. Other columns pass through; a column named n_tokens is replaced. The vocabulary (a
    file's path or pieces with scores) is read on the driver, and sent to tasks; it is some tens of thousands of pieces.
    """
    pieces = read_vocabulary(vocabulary) if isinstance(vocabulary, str) else vocabulary
    if len(pieces) > 2_000_000:
        raise ValueError("a vocabulary of over 2,000,000 pieces isn't sent to tasks")
    sent = docs.sparkSession.sparkContext.broadcast(pieces)

    key = uuid.uuid4().hex

    def compute(sent, column: pa.Array) -> dict:
        if (counter := _COUNTERS.get(key)) is None:
            _COUNTERS.clear()
            counter = _COUNTERS[key] = UnigramCounter(sent.value)
        return {"n_tokens": [counter.count(column[i].as_py()) for i in range(len(column))]}

    return append_columns(docs, text, partial(compute, sent), COUNTED)

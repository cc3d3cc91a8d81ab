"""Token counts under a unigram vocabulary, by dynamic programming on a trie.

The best score of a segmentation that ends at a place depends only on what stands before it, so pre-tokens that begin
alike share it. Each task puts its distinct pre-tokens in a trie; a node keeps the forward (best) score and the token
count of its prefix, computed once when the node is made, and a terminal's count is kept for its pre-token. The trie
is bounded and starts anew when full. Counts add up inside each row, so nothing is shuffled.

Scores are those of a Zipf law over the ranks of a public piece vocabulary: the piece of rank r has probability in
proportion to 1 / r. (The file's own scores are merge ranks, which are no log probabilities.) A character without a
piece falls back to one token for each of its UTF-8 bytes. Of segmentations with equal scores the shorter counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvameter.llm.common import slices

#: Fixed value: what the vocabulary writes for the white space before a word.
SPACE = "▁"


def piece_path() -> str:
    """Where this machine keeps the public piece vocabulary; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_pieces(path: str) -> dict[str, float]:
    """Log probability of each piece of a sentencepiece file, without its control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    total = math.log(sum(1 / (r + 1) for r in range(len(plain))))
    return {model.id_to_piece(i): -math.log(r + 1) - total for r, i in enumerate(plain)}


class Trie:
    """Pre-tokens with shared forward scores. ``most`` bounds its nodes."""

    def __init__(self, pieces: dict[str, float], most: int = 1_000_000) -> None:
        self.pieces, self.most = pieces, most
        #: Every ending of a piece, with the score of those that are pieces: where it has no entry, no piece is longer.
        self.endings: dict[str, float | None] = {p[i:]: None for p in pieces for i in range(len(p))} | pieces
        self.byte = min(pieces.values(), default=-1.0) - 1.0
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.score, self.tokens = [0.0], [0]
        self.counts: dict[str, int] = {}

    def _forward(self, word: str, end: int, scores: list[float], tokens: list[int], path: list[int] | range) -> tuple[float, int]:
        """Best score and its token count for word[:end]; ``path`` has the places of the shorter prefixes."""
        best, fewest = -math.inf, 0
        get = self.endings.get
        for start in range(end - 1, -1, -1):
            found = get(word[start:end], self)
            if found is self:
                break
            if found is not None:
                at = path[start]
                total = scores[at] + found
                if total > best or total == best and tokens[at] + 1 < fewest:
                    best, fewest = total, tokens[at] + 1
        if word[end - 1] not in self.pieces:
            at, n = path[end - 1], len(word[end - 1].encode("utf-8", "replace"))
            if scores[at] + n * self.byte > best:
                best, fewest = scores[at] + n * self.byte, tokens[at] + n
        return best, fewest

    def count(self, word: str) -> int:
        """Tokens of one pre-token."""
        known = self.counts.get(word)
        if known is not None:
            return known
        if len(word) > 256:  # shares too little to be kept
            scores, tokens = [0.0], [0]
            for end in range(1, len(word) + 1):
                s, n = self._forward(word, end, scores, tokens, range(end))
                scores.append(s)
                tokens.append(n)
            return tokens[-1]
        if len(self.score) > self.most:
            self.clear()
        node, path = 0, [0]
        for end, c in enumerate(word, 1):
            key = (node, c)
            down = self.child.get(key)
            if down is None:
                down = self.child[key] = len(self.score)
                s, n = self._forward(word, end, self.score, self.tokens, path)
                self.score.append(s)
                self.tokens.append(n)
            node = down
            path.append(node)
        self.counts[word] = self.tokens[node]
        return self.tokens[node]


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, n_pretokens) for each row of ``docs`` (doc_id, text); other columns are ignored.

    A pre-token is a run of characters that are not white space, with the space before it. Null and empty texts have
    no tokens; repeated rows are counted each; texts of any length are counted whole; no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(read_pieces(vocabulary))
        for batch in slices(batches, "text"):
            words = [[] if t is None else t.split() for t in batch.column(1).to_pylist()]
            known = {w: trie.count(SPACE + w) for w in {w for row in words for w in row}}
            tokens = [sum(map(known.__getitem__, row)) for row in words]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(tokens, pa.int64()), pa.array(list(map(len, words)), pa.int64())],
                ["doc_id", "n_tokens", "n_pretokens"],
            )

    columns = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return columns.mapInArrow(run, "doc_id long, n_tokens long, n_pretokens long")

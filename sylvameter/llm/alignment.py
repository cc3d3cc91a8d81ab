"""Aligning the tokens of two tokenizers by the bytes they own, and how well ids of one stand for ids of the other.

Each token owns a run of the bytes of its text. ``np.repeat`` of the token numbers by their byte lengths gives, for each
tokenizer, an array with the owner of every byte. Where the pair of owners changes, another overlap begins; where both
owners change at once, both tokenizers cut, and the tokens between two cuts are a group. The last tokens of a group end
together: they are linked.

One pass encodes and aligns every text. What is stored for each document are figures and its linked id pairs, each once
with its number. The counts of all pairs add up on the map side, so that a pair of every document is exchanged once by
task. To bring the counts back to the documents, the most frequent pairs (a bounded number) are broadcast; the others,
rare by what they are, are joined by exchange. Sums per document add up before their exchange too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvameter.llm.common import own_exchange, slices, unused
from sylvameter.llm.tokencount import SPACE
from sylvameter.llm.tokens import ids_bytes, read_encoding
from sylvameter.session import materialise

#: Bytes of text that are encoded together, and bytes whose owners are held at once.
BATCH, WINDOW = 2 << 20, 4 << 20
#: Fixed value: how the piece vocabulary writes a byte.
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")
FIGURES = ("n_a", "n_b", "n_groups", "n_overlaps", "n_links")


class ByteLevel:
    """Byte-level BPE from a rank file. A space is put before every text; strings of special tokens are plain text."""

    def __init__(self, path: str) -> None:
        self.encoding = read_encoding(path)
        self.pieces = [self.encoding.decode_single_token_bytes(i) for i in range(self.encoding.n_vocab)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(ids_bytes(self.encoding, " " + t), np.uint32).astype(np.int64) for t in texts]


class Pieces:
    """Pieces of a sentencepiece file, which puts the space before a text itself."""

    def __init__(self, path: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

        def owned(piece: str) -> bytes:
            byte = _BYTE_PIECE.fullmatch(piece)
            return bytes([int(byte[1], 16)]) if byte else piece.replace(SPACE, " ").encode()

        self.pieces = [owned(self.model.id_to_piece(i)) for i in range(self.model.get_piece_size())]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int64) for ids in self.model.encode(texts, num_threads=1)]


def byte_owners(ends: np.ndarray, start: int, stop: int) -> np.ndarray:
    """For the bytes from ``start`` to ``stop`` the number of the token that owns each; ``ends`` has the tokens' ends."""
    first, last = np.searchsorted(ends, (start, stop - 1), side="right")
    lengths = np.diff(np.minimum(ends[first : last + 1], stop), prepend=start)
    return np.repeat(np.arange(first, last + 1), lengths)


def owner_changes(ends_a: np.ndarray, ends_b: np.ndarray, window: int = WINDOW) -> tuple[int, np.ndarray, np.ndarray]:
    """The number of overlaps (runs of one pair of owners), and the last A token and the last B token of each group.

    Both arrays of ends are of the same bytes, none of them empty; the end of the text ends both.
    """
    size = int(ends_a[-1])
    overlaps, last_a, last_b = 1, [], []
    for start in range(0, size - 1, window):
        stop = min(start + window + 1, size)  # one byte of the next window, to see a change between them
        a, b = byte_owners(ends_a, start, stop), byte_owners(ends_b, start, stop)
        change_a, change_b = a[1:] != a[:-1], b[1:] != b[:-1]
        overlaps += int(np.count_nonzero(change_a | change_b))
        cut = np.flatnonzero(change_a & change_b)
        last_a.append(a[cut])
        last_b.append(b[cut])
    return overlaps, np.concatenate([*last_a, [len(ends_a) - 1]]), np.concatenate([*last_b, [len(ends_b) - 1]])


@dataclass
class Alignment:
    """Ids of both sides, the number of overlaps, and the numbers of the last token on each side of every group."""

    a: np.ndarray
    b: np.ndarray
    overlaps: int
    last_a: np.ndarray
    last_b: np.ndarray


class Aligner:
    """Both vocabularies with the tables that the alignment of every text needs."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.sides = ByteLevel(path_a), Pieces(path_b)
        self.lengths = [np.fromiter(map(len, s.pieces), np.int64, len(s.pieces)) for s in self.sides]
        #: How ids are written: within a group and at the end of its side, for A and then for B.
        self.written = [b"%d%s" % (i, after) for s, end in zip(self.sides, (b"|", b";"), strict=True) for after in (b",", end) for i in range(len(s.pieces))]

    def align(self, texts: list[str]) -> Iterator[Alignment | None]:
        """The alignment of each text; None where it is empty or the tokens of a side do not spell it."""
        for text, *ids in zip(texts, *(s.encode(texts) for s in self.sides), strict=True):
            data = b" " + text.encode()
            if not text or any(b"".join(map(s.pieces.__getitem__, x.tolist())) != data for s, x in zip(self.sides, ids, strict=True)):
                yield None
            else:
                ends = [np.cumsum(n[x]) for n, x in zip(self.lengths, ids, strict=True)]
                yield Alignment(*ids, *owner_changes(*ends))

    def groups_text(self, found: Alignment) -> str:
        """``a1,a2|b1;a3|b2,b3``: the ids of every group in order."""
        place = np.empty(len(found.a) + len(found.b), np.int64)
        at = 0  # where the writings of this side begin
        for i, (ids, last, other) in enumerate(((found.a, found.last_a, found.last_b), (found.b, found.last_b, found.last_a))):
            # before a token of A stand the B tokens of earlier groups, before one of B also the A tokens of its own
            before = other + 1 if i else np.append(0, other[:-1] + 1)
            closes = np.zeros(len(ids), bool)
            closes[last] = True
            place[np.arange(len(ids)) + np.repeat(before, np.diff(last, prepend=-1))] = at + ids + closes * len(self.sides[i].pieces)
            at += 2 * len(self.sides[i].pieces)
        return b"".join(map(self.written.__getitem__, place.tolist()))[:-1].decode()


def _links(found: list[Alignment | None]) -> pa.Array:
    """For each text its linked id pairs, each once, with its number."""
    keys, numbers, sizes = [], [], [0]
    for x in found:
        pairs, n = np.unique(x.a[x.last_a] << 32 | x.b[x.last_b], return_counts=True) if x else (np.empty(0, np.int64),) * 2
        keys.append(pairs)
        numbers.append(n)
        sizes.append(len(pairs))
    key = np.concatenate(keys)
    fields = {"a": key >> 32, "b": key & 0xFFFFFFFF, "n": np.concatenate(numbers)}
    pairs = pa.StructArray.from_arrays([pa.array(v.astype(np.int32)) for v in fields.values()], list(fields))
    return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pairs)


def align_tokens(docs: DataFrame, path_a: str, path_b: str, *carried: str) -> DataFrame:
    """The ``carried`` columns of each row of ``docs`` (text) with its alignment.

    n_a, n_b: tokens of either side; n_groups: between cuts; n_overlaps: pairs of tokens that share a byte; n_links:
    pairs of tokens that end together; groups: the ids of each group, as text; links: array of (a, b, n), the linked id
    pairs and how many links hold them. A null or empty text, and one that the tokens of a side do not spell (its
    white-space marks or unknown characters come out changed), has zeros, an empty text of groups and no links. Texts of
    any length are aligned whole, repeated rows each, and other columns are ignored.
    """
    n = len(carried)
    kept = docs.select(*[F.col(f"`{c}`") for c in carried], F.col("text").cast("string").alias(unused("text", list(carried))))
    figures = ", ".join(f"{c} long" for c in FIGURES)
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema.fields[:n])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(path_a, path_b)
        for batch in slices(batches, n, BATCH):
            found = list(aligner.align([t or "" for t in batch.column(n).to_pylist()]))
            rows = [(len(x.a), len(x.b), len(x.last_a), x.overlaps, len(x.last_a)) if x else (0,) * 5 for x in found]
            columns = [pa.array(v, pa.int64()) for v in zip(*rows, strict=True)]
            texts = pa.array([aligner.groups_text(x) if x else "" for x in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(n)] + columns + [texts, _links(found)], [*carried, *FIGURES, "groups", "links"])

    return kept.mapInArrow(run, f"{kinds}{figures}, groups string, links array<struct<a: int, b: int, n: int>>")


def link_counts(aligned: DataFrame) -> DataFrame:
    """a, b, count (links of the whole corpus that hold the pair) and best: whether no other A id has more with this B id."""
    counts = materialise(aligned.select(F.inline("links")).groupBy("a", "b").agg(F.sum("n").alias("count")))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def judge_links(aligned: DataFrame, row: str, counts: DataFrame, most_pairs: int = 1_000_000) -> DataFrame:
    """``row``, n_best and count_sum for each row of ``aligned`` with links, from the rows of ``link_counts``.

    About ``most_pairs`` pairs are broadcast at most, the most frequent; all others are joined by exchange.
    """
    pair = F.shiftleft(F.col("a").cast("long"), 32).bitwiseOR(F.col("b").cast("long")).alias("pair")
    counts = materialise(counts.select(pair, "count", "best"))
    links = aligned.select(F.col(row), F.inline("links")).select(F.col(row), pair, "n")
    n_pairs = counts.count()
    if n_pairs <= most_pairs:
        met = links.join(F.broadcast(counts), "pair")
    else:
        least = counts.select(F.percentile_approx("count", 1 - most_pairs / n_pairs, 100_000)).first()[0]
        often, seldom = counts.where(F.col("count") > least), counts.where(F.col("count") <= least)
        rest = links.join(F.broadcast(often.select("pair")), "pair", "left_anti")
        columns = (row, "n", "count", "best")
        met = links.join(F.broadcast(often), "pair").select(*columns).union(rest.join(own_exchange(seldom, "pair"), "pair").select(*columns))
    return met.groupBy(row).agg(
        F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).cast("long").alias("n_best"),
        F.sum(F.col("n") * F.col("count")).alias("count_sum"),
    )


def align_corpus(docs: DataFrame, path_a: str, path_b: str, most_pairs: int = 1_000_000) -> DataFrame:
    """doc_id, FIGURES, n_best, count_sum and groups_sha256 for each row of ``docs`` (doc_id, text).

    n_best: links of pairs that are the most frequent of their B id, ties included; count_sum: the counts of all its
    links added up. Rows without tokens have zeros and an empty groups_sha256. See ``align_tokens`` for odd rows; a null
    id stays null, and no rows give no rows.
    """
    row = unused("row", docs.columns)
    aligned = align_tokens(docs.select(F.col("doc_id").cast("long"), "text", F.monotonically_increasing_id().alias(row)), path_a, path_b, "doc_id", row)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    held = materialise(aligned.select(row, "doc_id", *FIGURES, digest, "links"))
    judged = judge_links(held, row, link_counts(held), most_pairs)
    sums = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")]
    return held.drop("links").join(judged, row, "left").select("doc_id", *FIGURES, *sums, "groups_sha256")

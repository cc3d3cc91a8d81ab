"""Packing documents into training sequences by minimum bin slack.

A document longer than a sequence fills whole sequences by itself; what remains of it is one piece. Remaining pieces
wait in a pool that is counted by length. Each window (sequence) takes the longest waiting piece and then the multiset
of other lengths whose sum comes closest to the room left: a subset-sum over a bitset, one step for each length and
binary share of its count, stopped once the room is met exactly, and backtracked to counts. A plan is repeated while its lengths
last. Where no multiset meets the room, one more piece is cut to meet it, so only the last windows of a task can be
short; those are cut at powers of two, at which a sequence needs no padding.

Each task packs its own rows in one pass and holds the ids of a bounded pool, so nothing is shuffled and packing grows
with the input. Sequence numbers carry the number of the input partition, and so are unique, and the same again when a
lost task is repeated.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvameter.llm.common import slices
from sylvameter.llm.tokens import read_added, read_encoding, whole_ids_bytes

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length in ``counts`` to take so that their sum is the largest that is at most ``room``."""
    whole = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if 0 < x <= room), reverse=True):
        left, share = min(counts[length], room // length), 1
        while left and not reach >> room & 1:
            share = min(share, left)
            steps.append((length, share, reach))
            reach |= reach << (length * share) & whole
            left -= share
            share *= 2
        if reach >> room & 1:
            break
    at, taken = reach.bit_length() - 1, defaultdict(int)
    for length, share, before in reversed(steps):
        if not before >> at & 1:
            taken[length] += share
            at -= length * share
    return dict(taken)


class Packer:
    """Pieces go in by ``add``; ``rows`` of SCHEMA come out. ``pool`` bounds the ids (in tokens) that wait."""

    def __init__(self, first_sequence: int, capacity: int = 2048, pool: int = 1 << 21) -> None:
        self.capacity, self.pool, self.next = capacity, pool, first_sequence
        self.waiting: dict[int, deque] = {}
        self.lengths: list[int] = []  # of waiting pieces, ascending, each once
        self.tokens = 0
        self.rows: list[tuple] = []

    def _put(self, piece: tuple) -> None:
        n = len(piece[2]) // 4
        if n not in self.waiting:
            self.waiting[n] = deque()
            insort(self.lengths, n)
        self.waiting[n].append(piece)
        self.tokens += n

    def _take(self, n: int) -> tuple:
        queue = self.waiting[n]
        piece = queue.popleft()
        if not queue:
            del self.waiting[n]
            del self.lengths[bisect_left(self.lengths, n)]
        self.tokens -= n
        return piece

    def _emit(self, pieces: list[tuple]) -> None:
        """One sequence of ``pieces`` (doc_id, start, ids, doc_tokens)."""
        at = 0
        for doc_id, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc_id, start, n, zlib.crc32(ids), total, self.next, at))
            at += n
        self.next += 1

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total, size = len(ids) // 4, self.capacity * 4
        end = len(ids) - len(ids) % size
        for at in range(0, end, size):
            self._emit([(doc_id, at // 4, ids[at : at + size], total)])
        if end < len(ids):
            self._put((doc_id, end // 4, ids[end:], total))
        if self.tokens > self.pool:
            self.pack(self.pool // 2)

    def pack(self, down_to: int = 0) -> None:
        """Fill windows until at most ``down_to`` tokens wait; 0 also closes the last, short windows."""
        while self.tokens > max(down_to, self.capacity - 1):
            longest = self.lengths[-1]
            counts = {n: len(q) for n, q in self.waiting.items()}
            counts[longest] -= 1
            room = self.capacity - longest
            plan = best_fill(counts, room)
            plan[longest] = plan.get(longest, 0) + 1
            slack = self.capacity - sum(n * k for n, k in plan.items())
            times = 1 if slack else min(len(self.waiting[n]) // k for n, k in plan.items())
            for _ in range(times):
                if self.tokens <= down_to:
                    break
                pieces = [self._take(n) for n, k in plan.items() for _ in range(k)]
                if slack:  # the rest is longer than the slack, or it would have been taken
                    pieces.append(self._cut(slack))
                self._emit(pieces)
        if not down_to:
            while self.tokens:
                room, pieces = 1 << (self.tokens.bit_length() - 1), []
                while room:
                    n = self.lengths[max(0, bisect_left(self.lengths, room + 1) - 1)]
                    pieces.append(self._take(n) if n <= room else self._cut(room))
                    room -= len(pieces[-1][2]) // 4
                self._emit(pieces)

    def _cut(self, n: int) -> tuple:
        """The first ``n`` ids of the shortest waiting piece with more than ``n``; its rest waits on."""
        doc_id, start, ids, total = self._take(self.lengths[bisect_left(self.lengths, n + 1)])
        self._put((doc_id, start + n, ids[4 * n :], total))
        return doc_id, start, ids[: 4 * n], total


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """Pack every row of ``docs`` (doc_id, text) into sequences of at most ``capacity`` ids; rows of SCHEMA, by piece.

    ``tokenizer`` is the path of a rank file, the same on all executors. Null and empty texts have the end id alone.
    Repeated rows are packed each on its own, a null doc_id stays null, other columns are ignored, a text of any
    length is packed whole, and no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, added = read_encoding(tokenizer), read_added(tokenizer)
        end = end_id.to_bytes(4, "little")
        context = TaskContext.get()
        packer = Packer((context.partitionId() if context else 0) << 40, capacity)
        kinds = pa.schema([(x.split()[0], pa.int64()) for x in SCHEMA.split(", ")])

        def rows() -> pa.RecordBatch:
            columns = list(zip(*packer.rows, strict=True)) or [[]] * len(kinds)
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], schema=kinds)

        for batch in slices(batches, "text"):
            for doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                packer.add(doc_id, whole_ids_bytes(encoding, added, text or "") + end)
            if len(packer.rows) > 5000:
                yield rows()
        packer.pack()
        yield rows()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)

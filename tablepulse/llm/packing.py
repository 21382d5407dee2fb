"""Vector bin packing by the dot-product heuristic.

An example demands tokens, one segment and loss-bearing tokens; a sequence has limits on all three. Sequences
are filled one at a time: of all examples that still fit, the next is the one whose demand has the greatest
dot product with what the sequence has left, both as shares of the limits, and limits weighted by the square of how
much all waiting examples demand of them (the scarce one decides). Examples of equal demand are interchangeable, so they are kept as counted kinds and a choice costs as much as there are kinds.

Documents are cut into pieces that take as many tokens, and as many loss-bearing ones, as a sequence may hold.

Tasks pack what they encode, in pools of a bounded size, and hand nothing to one another: no shuffle, and no
key can be hot. What remains of a pool in an unfilled sequence goes into the next pool.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import ship
from .bpe import default_path, encoder
from .words import pieces

#: Tokens in the examples that are packed together in a task.
POOL_TOKENS = 1 << 20
PIECES = "doc_id long, start long, length long, loss_tokens long, doc_tokens long, sequence_id long, offset long, segment int, padded_length long, ids binary"


@dataclass(frozen=True)
class Limits:
    tokens: int = 1024
    segments: int = 256
    loss_tokens: int = 1024

    def __post_init__(self):
        if min(self.tokens, self.segments, self.loss_tokens) < 1:
            raise ValueError("limits are 1 or more")


def pack(demands: np.ndarray, limits: Limits) -> tuple[list[list[int]], list[list[int]]]:
    """Indexes of examples by sequence: of those that are full, and of those that could hold more.

    ``demands``: a row of (tokens, loss_tokens) for each example, each within the limits. A sequence is full
    if no example was left that fits, and the rest is under a sixteenth of the tokens.
    """
    cap = np.array([limits.tokens, limits.segments, limits.loss_tokens], np.float64)
    kinds, of = np.unique(demands, axis=0, return_inverse=True) if len(demands) else (np.zeros((0, 2), np.int64), np.zeros(0, np.int64))
    waiting: list[list[int]] = [[] for _ in kinds]
    for i in range(len(demands) - 1, -1, -1):
        waiting[of.reshape(-1)[i]].append(i)
    need = np.column_stack([kinds[:, 0], np.ones(len(kinds), np.int64), kinds[:, 1]]).astype(np.int64)
    share = need / cap
    left_of = np.array([len(w) for w in waiting])
    full, part = [], []
    while len(need):
        rest, chosen = cap.astype(np.int64), []
        weight = left_of @ share
        weight = (weight / weight.max()) ** 2
        while True:
            fits = np.flatnonzero((need <= rest).all(axis=1))
            if not len(fits):
                break
            best = fits[np.argmax(share[fits] @ (rest / cap * weight))]
            times = max(1, min(len(waiting[best]), int((rest // np.maximum(need[best], 1)).min()))) if len(fits) == 1 else 1
            for _ in range(times):
                chosen.append(waiting[best].pop())
            rest = rest - times * need[best]
            left_of[best] -= times
            if not left_of[best]:
                keep = left_of > 0
                need, share, left_of = need[keep], share[keep], left_of[keep]
                waiting = [w for w, k in zip(waiting, keep) if k]
        (full if len(need) or rest[0] * 16 < limits.tokens else part).append(chosen)
    return full, part


def cut_document(total: int, prompt: int, limits: Limits) -> Iterator[tuple[int, int, int]]:
    """(start, length, loss-bearing tokens) of the pieces of a document of ``total`` tokens, of which the first
    ``prompt`` bear no loss."""
    at = 0
    while at < total:
        free = max(0, prompt - at)
        n = min(total - at, limits.tokens, free + limits.loss_tokens)
        yield at, n, max(0, n - free)
        at += n


def _task(batches: Iterator[pa.RecordBatch], limits: Limits, path: str, end_id: int, pool_tokens: int) -> Iterator[pa.RecordBatch]:
    ids, sizes = encoder(path).ids, encoder(path).sizes
    end = np.array([end_id], "<u4")
    sequence = TaskContext.get().partitionId() << 40
    pool: list[tuple] = []
    held = 0
    rows: dict[str, list] = defaultdict(list)

    def put(chosen: list[tuple]) -> None:
        nonlocal sequence
        offset = 0
        for k, (doc_id, start, n, loss, total, piece) in enumerate(chosen):
            for name, value in zip(PIECES.replace(",", "").split()[::2], (doc_id, start, n, loss, total, sequence, offset, k, limits.tokens, piece)):
                rows[name].append(value)
            offset += n
        sequence += 1

    def batch() -> pa.RecordBatch:
        kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
        fields = [f.split() for f in PIECES.split(", ")]
        out = pa.RecordBatch.from_arrays([pa.array(rows[n], kinds[k]) for n, k in fields], names=[n for n, _ in fields])
        rows.clear()
        return out

    def packed(last: bool) -> None:
        nonlocal pool, held
        full, part = pack(np.array([(p[2], p[3]) for p in pool], np.int64).reshape(-1, 2), limits)
        for s in full + part if last else full:
            put([pool[i] for i in s])
        pool = [] if last else [pool[i] for s in part for i in s]
        held = sum(p[2] for p in pool)

    for b in pieces(batches, "text"):
        for doc_id, text, prompt in zip(b["doc_id"].to_pylist(), b["text"], b["prompt_bytes"].to_pylist()):
            own = np.append(ids(text.as_py()), end).astype("<u4")
            total = len(own)
            n_prompt = 0
            if prompt > 0:
                size = sizes[own[: min(total - 1, prompt)]]  # an id is a byte at least
                n_prompt = int(np.searchsorted(np.cumsum(size) - size, prompt))
            for start, n, loss in cut_document(total, n_prompt, limits):
                item = (doc_id, start, n, loss, total, own[start : start + n].tobytes())
                if n == limits.tokens:
                    put([item])
                else:
                    pool.append(item)
                    held += n
            if len(rows["doc_id"]) >= 8192:
                yield batch()
        while held > pool_tokens:
            before = held
            packed(False)
            yield batch()
            if held > before // 2:
                packed(True)
    packed(True)
    if rows:
        yield batch()


def pack_documents(docs: DataFrame, limits: Limits = Limits(), tokenizer: str | None = None, end_id: int = 0, pool_tokens: int = POOL_TOKENS, prompt_bytes: Column | None = None) -> DataFrame:
    """Sequences of encoded documents, one row per piece.

    A document is its ids and ``end_id``; null and empty texts are ``end_id`` alone. It is cut into pieces by
    ``cut_document``, and all pieces are packed. ``prompt_bytes``: how many UTF-8 bytes of a text are its prompt
    (null or negative: none); ids that begin there bear no loss, all others and ``end_id`` do. Columns: doc_id, start, length, loss_tokens, doc_tokens, sequence_id (unique,
    not gapless), offset, segment, padded_length, ids (little-endian unsigned 32-bit numbers). Repeated rows
    are packed each for itself, and a null doc_id stays null. An empty table gives no pieces. Other columns are
    ignored.
    """
    ship(docs.sparkSession)
    path = tokenizer or default_path()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.lit(0) if prompt_bytes is None else prompt_bytes, F.lit(0)).cast("long").alias("prompt_bytes"))
    return rows.mapInArrow(lambda batches: _task(batches, limits, path, end_id, pool_tokens), PIECES)

"""Language-model scoring: exact word statistics, and a causal self-attention model on subword ids.

1. One pass over the documents: a batch of texts is encoded, each distinct word once (a word's ids do not depend on
   its neighbours), and written down as word numbers and the ids of its distinct words. It sends each distinct word
   with its count in training once to the range of hashes that counts it, and gets the exact count back.
2. The model (``attention``): the tree of ids and its odds come from the exact counts of all training ids. In each of
   ``ROUNDS`` rounds tasks learn from their next batches, all from the same start; what they have changed is put
   together by sums, in groups of a bounded size. Every id of every training
   document is learned from, once where there are enough of them.
3. A batch, the counts of its words and the model come together: overlapping windows score every id once, and the
   word statistics are summed by document.

Words counted, ids learned from and batches written all grow with the corpus.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import attention
from ._common import cut, ship
from .bpe import default_path, encoder
from .packed import pack48, ranges, unpack48
from .words import SPACES, bounds, hashes, pieces, utf8

#: Documents whose crc32(doc_id) leaves this remainder are held out.
FOLDS, HELD_OUT = 7, 2
ROUNDS = 4
#: Tasks go over their batches of a round again, up to ``MOST_PASSES`` times, where training has fewer ids than this.
LEAST_IDS, MOST_PASSES = 4_000_000, 16
#: Parameters are put together in so many parts, and those of so many tasks at a time.
PARTS, TOGETHER = 8, 32
#: Distinct words of one range of hashes, about.
RANGE_WORDS = 1 << 20

#: Bytes of the texts that a task holds at a time.
BATCH_BYTES = 2 << 20

_FACTS = "batch long, turn int, kind int, r int, data binary"
_MESSAGES = "batch long, kind int, r int, data binary"
_WORDS, _UNITS, _DOCS, _TOTAL = range(4)
_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


class _Batch:
    """Words and subword ids of a batch of texts."""

    def __init__(self, texts: pa.Array, path: str):
        data, at = utf8(texts)
        starts, ends, self.at = bounds(data, at, SPACES)
        self.types, first, self.word = np.unique(hashes(data, starts, ends, SPACES), return_index=True, return_inverse=True)
        raw = data.tobytes().lower()
        words = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
        self.unit_ids, self.unit_at = _encode(words, path)


def sequences(unit_ids: np.ndarray, unit_at: np.ndarray, word: np.ndarray, word_at: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, given as numbers of words, each with ``end`` after it, and where each begins."""
    begin, stop = unit_at[word], unit_at[word + 1]
    _, index = ranges(begin, stop)
    before = np.concatenate([[0], np.cumsum(stop - begin)])[word_at]
    at = before + np.arange(len(before))
    out = np.full(at[-1], end, np.int64)
    inside = np.ones(at[-1], bool)
    inside[at[1:] - 1] = False
    out[inside] = unit_ids[index]
    return out, at


def _spaced(path: str) -> np.ndarray:
    """Of each id: whether its bytes begin with a blank."""
    e = encoder(path)
    if not hasattr(e, "spaced"):
        e.spaced = np.array([e.engine.decode_single_token_bytes(i)[:1] == b" " for i in range(e.engine.max_token_value + 1)])
    return e.spaced


def _encode(words: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each word with a blank before it, and where each word's begin."""
    engine, spaced = encoder(path).engine, _spaced(path)
    ids, at = [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
    held = 0
    for i in range(0, len(words), 8192):
        part = words[i : i + 8192]
        try:
            got = engine.encode_to_numpy((b" " + b" ".join(part)).decode("utf-8", "replace"), disallowed_special=()).astype(np.int64)
            begins = np.flatnonzero(spaced[got])
        except ValueError:  # too long a run of such white space as the next line tells of
            begins = ()
        if len(begins) != len(part):  # words with white space of other scripts in them
            each = [encoder(path).plain(" " + w.decode("utf-8", "replace")).astype(np.int64) for w in part]
            got, begins = np.concatenate(each), np.cumsum([0, *map(len, each)])[:-1]
        ids.append(got)
        at.append(np.append(begins[1:], len(got)) + held)
        held += len(got)
    return np.concatenate(ids), np.concatenate(at)


def _by_range(types: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    r = (types >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(types), np.int64)
    edges = np.append(np.flatnonzero(np.diff(r, prepend=-1)), len(r))
    return [(int(r[i]), i, j) for i, j in zip(edges.tolist(), edges[1:].tolist())]


def _low(types: np.ndarray, bits: int) -> np.ndarray:
    width = min(48, 64 - bits)
    return (types >> np.uint64(64 - bits - width)) & np.uint64((1 << width) - 1)


def _end(path: str) -> int:
    return encoder(path).engine.max_token_value + 1


def _gather(batches: Iterator[pa.RecordBatch], bits: int, path: str) -> Iterator[pa.RecordBatch]:
    """Facts of the documents of one task."""
    end = _end(path)
    small = "<u4" if end > 0xFFFF else "<u2"
    units, task, turn = np.zeros(end + 1, np.int64), TaskContext.get().partitionId(), 0
    for batch in pieces(batches, "text", BATCH_BYTES):
        b, key = _Batch(batch["text"], path), (task << 32) + turn
        held = batch["held_out"].to_numpy(zero_copy_only=False)
        learned = b.word[np.repeat(~held, np.diff(b.at))]
        counts = np.bincount(learned, minlength=len(b.types))
        per_unit = np.repeat(counts, np.diff(b.unit_at))
        units += np.bincount(b.unit_ids, per_unit, end + 1).astype(np.int64)
        units[end] += int((~held).sum())
        low = _low(b.types, bits)
        rows = [(key, turn, _WORDS, k, pickle.dumps((pack48(low[i:j]), counts[i:j].astype("<u4").tobytes()))) for k, i, j in _by_range(b.types, bits)]
        own = batch["doc_id"]
        ids = (own.fill_null(0).to_numpy(), own.is_null().to_numpy(zero_copy_only=False), held)
        rows.append((key, turn, _DOCS, key % (1 << 20), pickle.dumps((*ids, b.at, b.word.astype("<u4"), b.unit_ids.astype(small), np.diff(b.unit_at).astype("<u4")), protocol=5)))
        yield _fact_batch(rows)
        turn += 1
    seen = np.flatnonzero(units)
    if len(seen):
        yield _fact_batch([(-1, -1, _UNITS, 0, pickle.dumps((seen, units[seen])))])


def _opened(data: bytes, end: int) -> tuple:
    """Of a batch: doc_ids, which of them are null, which texts are held out, where their words begin, the words; ids
    of all texts and where each begins."""
    doc_ids, null, held, word_at, word, unit_ids, lengths = pickle.loads(data)
    ids, at = sequences(unit_ids, np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]), word, word_at, end)
    return doc_ids, null, held, word_at, word, ids, at


def _fact_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()))], names=["batch", "turn", "kind", "r", "data"])


def _answer(table: pa.Table) -> pa.Table:
    """Of one range: to each batch the training counts of the words that it sent; and how many distinct words and
    words in all training has here."""
    sent = [(batch, *pickle.loads(d.as_py())) for batch, d in zip(table["batch"].to_pylist(), table["data"])]
    low = [unpack48(p) for _, p, _ in sent]
    every = np.concatenate(low)
    count = np.concatenate([np.frombuffer(c, "<u4") for _, _, c in sent]).astype(np.int64)
    order = np.argsort(every, kind="stable")
    sorted_low = every[order]
    first = np.flatnonzero(np.diff(sorted_low, prepend=sorted_low[:1] + np.uint64(1)) != 0)
    total = np.add.reduceat(count[order], first)
    back = np.empty(len(every), np.int64)
    back[order] = np.repeat(total, np.diff(np.append(first, len(every))))
    r, out, at = table["r"][0].as_py(), [], 0
    for (batch, _, _), own in zip(sent, low):
        c = back[at : at + len(own)]
        out.append((batch, _WORDS, r, pickle.dumps((np.minimum(c, 255).astype(np.uint8).tobytes(), c[c >= 255].astype("<u8").tobytes()))))
        at += len(own)
    out.append((-1, _TOTAL, r, pickle.dumps((int((total > 0).sum()), int(total.sum())))))
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["batch", "kind", "r", "data"])


def _totals(answers: DataFrame) -> tuple[int, int]:
    """Distinct words and all words of training, without ends."""

    def open_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [pickle.loads(d.as_py()) for d in b["data"]]
            yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], pa.int64()) for k in (0, 1)], names=["types", "tokens"])

    row = answers.where(F.col("kind") == _TOTAL).select("data").mapInArrow(open_, "types long, tokens long").agg(F.sum("types"), F.sum("tokens")).first()
    return row[0] or 0, row[1] or 0


def _unit_counts(facts: DataFrame, n: int) -> np.ndarray:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for b in batches:
            for d in b["data"]:
                ids, counts = pickle.loads(d.as_py())
                total[ids] += counts
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])

    out = np.zeros(n, np.int64)
    counted = facts.where(F.col("kind") == _UNITS).select("data").mapInArrow(rows, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    for r in counted.collect():  # an id of the tokenizer a row
        out[r["id"]] = r["n"]
    return out


def _changes(before: tuple[np.ndarray, np.ndarray], m: dict, past: dict, task: int) -> Iterator[pa.RecordBatch]:
    """What a task has changed, in parts: of each parameter that it touched the sum of squared gradients that came
    to it, and that times its change."""
    moved, came = attention.flat(m) - before[0], attention.flat(past) - before[1]
    edges = np.linspace(0, len(moved), PARTS + 1).astype(np.int64)
    for p, (a, b) in enumerate(zip(edges, edges[1:])):
        at = np.flatnonzero(came[a:b] > 0)
        yield _part(p, task, at, came[a:b][at], (came[a:b] * moved[a:b])[at])


def _part(p: int, slot: int, at: np.ndarray, came: np.ndarray, moved: np.ndarray) -> pa.RecordBatch:
    data = pickle.dumps((at.astype("<u4").tobytes(), came.astype("<f4").tobytes(), moved.astype("<f4").tobytes()))
    return pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([slot], pa.int64()), pa.array([data], pa.binary())], names=["part", "slot", "data"])


def _add(table: pa.Table) -> pa.Table:
    """The changes of some tasks in one part as those of one."""
    got = [pickle.loads(d.as_py()) for d in table["data"]]
    at = np.concatenate([np.frombuffer(x, "<u4") for x, _, _ in got]).astype(np.int64)
    sums = [np.bincount(at, np.concatenate([np.frombuffer(g[k], "<f4") for g in got])) for k in (1, 2)]
    seen = np.flatnonzero(sums[0]) if len(at) else at
    return pa.Table.from_batches([_part(table["part"][0].as_py(), table["slot"][0].as_py(), seen, sums[0][seen], sums[1][seen])])


def fit(facts: DataFrame, end: int, rounds: int = ROUNDS) -> tuple[dict[str, np.ndarray], attention.Tree]:
    """The model, learned by tasks from batches of their own and put together after each round.

    A parameter moves by the mean of what the tasks have moved it by, weighted by the squared gradients that each has
    seen: one that few tasks touch keeps the whole of their change. Sums of squared gradients go on over all tasks.
    """
    spark = facts.sparkSession
    counts = _unit_counts(facts, end + 1)
    tree = attention.Tree(counts)
    model = attention.start(tree, end + 1)
    passes = max(1, min(MOST_PASSES, LEAST_IDS // max(1, int(counts.sum()))))
    now, past = attention.flat(model), np.full(attention.flat(model).shape, attention.PAST, np.float32)
    held = facts.where(F.col("kind") == _DOCS)
    size = held.agg(F.count("*"), F.max("turn")).first()
    n_batches, rounds = size[0], min(rounds, (size[1] or 0) + 1)
    for k in range(rounds if n_batches else 0):
        sent = spark.sparkContext.broadcast((now, past, tree))

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            *before, own_tree = sent.value
            m, own_past = (attention.unflat(x, end + 1) for x in before)

            def blocks():
                again = []  # of a small corpus only
                for b in batches:
                    for d in b["data"]:
                        data = d.as_py()
                        again += [data] * (passes > 1)
                        _, _, out, _, _, ids, at = _opened(data, end)
                        yield from attention.training_blocks(ids, at, end, ~out)
                for data in again * (passes - 1):
                    _, _, out, _, _, ids, at = _opened(data, end)
                    yield from attention.training_blocks(ids, at, end, ~out)

            if attention.train(m, own_past, own_tree, blocks()):
                yield from _changes(before, m, own_past, TaskContext.get().partitionId())

        changed = held.where(F.col("turn") % rounds == k).select("data").mapInArrow(learn, "part int, slot long, data binary")
        tasks = n_batches
        while tasks > TOGETHER:
            changed = changed.withColumn("slot", F.floor(F.col("slot") / TOGETHER)).groupBy("part", "slot").applyInArrow(_add, "part int, slot long, data binary")
            tasks = -(-tasks // TOGETHER)
        edges = np.linspace(0, len(now), PARTS + 1).astype(np.int64)
        for r in changed.groupBy("part").applyInArrow(_add, "part int, slot long, data binary").collect():  # the parts of one model
            at, came, moved = pickle.loads(r["data"])
            at = np.frombuffer(at, "<u4") + edges[r["part"]]
            came, moved = np.frombuffer(came, "<f4"), np.frombuffer(moved, "<f4")
            now[at] += moved / came
            past[at] += came
        sent.unpersist()
    return attention.unflat(now, end + 1), tree


def _sum_up(table: pa.Table, path: str, sent, n_all: int, n_types: int, n_ends: int) -> pa.Table:
    """Of one batch: the scores of its documents."""
    values, tree = sent.value
    end = _end(path)
    replies = {}
    for kind, r, d in zip(table["kind"].to_pylist(), table["r"].to_pylist(), table["data"]):
        if kind == _DOCS:
            doc_ids, null, held, word_at, word, ids, at = _opened(d.as_py(), end)
        else:
            small, large = pickle.loads(d.as_py())
            c = np.frombuffer(small, np.uint8).astype(np.int64)
            c[c == 255] = np.frombuffer(large, "<u8").astype(np.int64)
            replies[r] = c
    count = np.concatenate([replies[r] for r in sorted(replies)]) if replies else np.zeros(0, np.int64)
    value = np.log10((count + 1) / (n_all + n_types + 1))
    n_words = np.diff(word_at)
    known = np.concatenate([[0], np.cumsum((count > 0)[word])])[word_at]
    base = np.bincount(np.repeat(np.arange(len(doc_ids)), n_words), value[word], len(doc_ids)) + np.log10((n_ends + 1) / (n_all + n_types + 1))
    score = attention.score(attention.unflat(values, end + 1), tree, ids, at, end) / np.log(10)
    return pa.Table.from_arrays(
        [pa.array(doc_ids, pa.int64(), mask=null), pa.array(held), pa.array(n_words + 1, pa.int64()), pa.array(np.diff(known) + (n_ends > 0), pa.int64()), pa.array(base), pa.array(score)],
        names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
    )


def score_documents(docs: DataFrame, tokenizer: str | None = None, rounds: int = ROUNDS) -> DataFrame:
    """Each row of ``docs`` (doc_id, text) with its scores.

    Tokens are words and one end per text; A-Z are folded. n_known: tokens that training has. train_tokens: all
    tokens of training. base_score: log10 of the add-one unigram of tokens. score: log10 of the model's
    probability of the text's subword ids and its end. Null and empty texts are an end alone. Rows without a
    doc_id are learned from. Repeated rows count as often as they occur. Without training documents all counts
    are 0 and the model is as it starts. An empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    path = tokenizer or default_path()
    end = _end(path)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("held_out", held)
    volume = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(F.when(~F.col("held_out"), 1)).alias("train")).first()
    n_ends = volume["train"]
    bits = min(30, max(0, ceil((volume["bytes"] or 0) / 30 / RANGE_WORDS) - 1).bit_length())
    facts = cut(rows.mapInArrow(lambda b: _gather(b, bits, path), _FACTS), "facts", "zstd")
    asked = facts.where(F.col("kind") == _WORDS).select("batch", "r", "data")
    answers = cut(asked.groupBy("r").applyInArrow(_answer, _MESSAGES), "answers")
    n_types, n_all = _totals(answers)
    n_types, n_all = n_types + (n_ends > 0), n_all + n_ends
    model, tree = fit(facts, end, rounds)
    sent = spark.sparkContext.broadcast((attention.flat(model), tree))
    known = facts.where(F.col("kind") == _DOCS).select("batch", "kind", "r", "data").unionByName(answers.where(F.col("kind") == _WORDS))
    scored = known.groupBy("batch").applyInArrow(lambda t: _sum_up(t, path, sent, n_all, n_types, n_ends), _SCORES)
    return scored.withColumn("train_tokens", F.lit(n_all).cast("long"))

"""Benchmark decontamination with training suffix arrays.

Every batch of training documents is a shard with a suffix array of its own: positions of words in the order of
all the words that follow. Every suffix of the benchmark's items is binary-searched in it. The suffixes of the
shard that agree with a test suffix in a whole window are an interval of the array; they are the places where the
window stands verbatim. Where two neighbours in the common order of both are compared to their ends, the longest
match of each place follows, since no other test suffix can agree with it further than its nearest ones.

Intervals of different windows do not overlap, so no place is looked at twice for one length of windows however
often words repeat; items come into it as sets. Two suffixes are compared by hashes of prefixes, in a number of
steps that grows with the logarithm of their length. Only words of the benchmark can be part of a match, so other
words end a suffix.

The benchmark is the stated query set: tasks build it into blocks of a bounded number of words, each of which is
broadcast and takes one pass over the training texts; those stay where they are, and nothing of them is shuffled.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from ._common import cut, remove, ship, without
from .packed import ranges
from .words import MARKS, mix, pieces, word_hashes

WINDOW = 10
#: Words of the benchmark in one block, about: some 100 bytes each.
BLOCK_WORDS = 1 << 20
#: Bytes of texts in a shard, at least and at most: about as many words as the block has.
SHARD_BYTES = (2 << 20, 8 << 20)
#: (place in the shard, window) pairs that are turned into (document, item) pairs at a time.
PAIRS = 1 << 20
SPAN = "start:int,length:int,item_ids:array<string>,item_start:int,doc_start:int,match_length:int"
FOUND = f"n_words long, items array<string>, matches array<struct<{SPAN}>>"
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Sequence:
    """Words (numbers from 1 on, 0 ends a suffix) of which suffixes can be compared in few steps."""

    def __init__(self, words: np.ndarray):
        self.words = np.append(words, 0).astype(np.int64)
        #: Where the suffix of each place ends: at the next 0.
        zero = np.flatnonzero(self.words == 0)
        self.end = zero[np.searchsorted(zero, np.arange(len(self.words)))]
        # sums of word * base ** place, modulo 2 ** 64: a run's sum, shifted to place 0, is its hash
        self.power = np.full(len(self.words) + 1, _BASE)
        self.power[0] = 1
        np.cumprod(self.power, out=self.power)
        self.total = np.zeros(len(self.words) + 1, np.uint64)
        part = mix(self.words.view(np.uint64))
        part *= self.power[:-1]
        np.cumsum(part, out=self.total[1:])

    def room(self, at: np.ndarray) -> np.ndarray:
        """Words from each place to the end of its suffix."""
        return self.end[at] - at


def common(a: Sequence, i: np.ndarray, b: Sequence, j: np.ndarray, most: np.ndarray | None = None) -> np.ndarray:
    """How many words the suffixes ``i`` of ``a`` and ``j`` of ``b`` have in common (``most`` of them at most)."""
    low, high = np.zeros(len(i), np.int64), np.minimum(a.room(i), b.room(j))
    if most is not None:
        high = np.minimum(high, most)
    n = max(len(a.power), len(b.power))
    power = a.power if len(a.power) == n else b.power
    while len(open_ := np.flatnonzero(low < high)):
        middle = (low[open_] + high[open_] + 1) // 2
        x, y = i[open_], j[open_]
        left = (a.total[x + middle] - a.total[x]) * power[np.maximum(y - x, 0)]
        right = (b.total[y + middle] - b.total[y]) * power[np.maximum(x - y, 0)]
        same = left == right
        low[open_] = np.where(same, middle, low[open_])
        high[open_] = np.where(same, high[open_], middle - 1)
    return low


def suffix_array(words: Sequence, places: np.ndarray) -> np.ndarray:
    """``places`` in the order of the suffixes there (a suffix that ends is before all that go on). Ranks by the
    first k words give ranks by the first 2 k."""
    rank = words.words.copy()
    end, k, order = words.end, 1, None
    live = np.flatnonzero(rank)
    while True:
        after = np.where(live + k < end[live], rank[np.minimum(live + k, len(rank) - 1)], 0)
        order = np.lexsort((after, rank[live]))
        first, second = rank[live][order], after[order]
        fresh = np.cumsum(np.append(True, (np.diff(first) != 0) | (np.diff(second) != 0))) if len(order) else np.zeros(0, np.int64)
        rank[live[order]] = fresh
        k *= 2
        if not len(order) or fresh[-1] == len(order) or k >= (end[live] - live).max():
            break
    return places[np.argsort(rank[places], kind="stable")]


class Block:
    """Distinct item texts of a part of the benchmark: their words, their suffixes in order, and the ids of their items."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        h, at = word_hashes(pa.array([t for _, t in items], pa.large_string()), MARKS)
        groups: dict[bytes, int] = {}
        ids: list[set[str]] = []
        texts = []
        for i, (item_id, _) in enumerate(items):
            words = h[at[i] : at[i + 1]]
            if len(words):
                g = groups.setdefault(words.tobytes(), len(groups))
                if g == len(texts):
                    texts.append(words)
                    ids.append(set())
                if item_id is not None:
                    ids[g].add(item_id)
        self.item_ids = [sorted(x) for x in ids]
        self.vocabulary = np.unique(np.concatenate(texts)) if texts else np.zeros(0, np.uint64)
        n = np.array([len(t) for t in texts], np.int64)
        words = np.concatenate([np.append(np.searchsorted(self.vocabulary, t) + 1, 0) for t in texts]) if texts else np.zeros(0, np.int64)
        self.words = Sequence(words)
        begins = np.concatenate([[0], np.cumsum(n + 1)])
        group, start = ranges(np.zeros(len(n), np.int64), n)
        places = begins[group] + start
        order = suffix_array(self.words, places)
        group_of = np.searchsorted(begins, np.arange(len(self.words.words)), "right") - 1
        #: Every test suffix in order: its place, item and start, and how many words a match of it has at least (0: it is too short).
        self.place, self.group = order, group_of[order]
        self.start = order - begins[self.group]
        whole = n[self.group] if len(n) else np.zeros(0, np.int64)
        self.least = np.where(whole >= window, np.where(whole - self.start >= window, window, 0), np.where(self.start == 0, whole, 0))

    def __bool__(self) -> bool:
        return bool(len(self.item_ids))


class Found:
    """What a block has in the documents of a batch."""

    def __init__(self, n_words: int):
        self.hit = np.zeros(n_words, bool)
        #: Of each place: the longest match that begins there, its item's ids and where in the item.
        self.length, self.start = np.zeros(n_words, np.int64), np.zeros(n_words, np.int64)
        self.ids = np.full(n_words, -1, np.int64)
        self.lists: list[list[str]] = []
        #: Items as (document, number in ``lists``).
        self.items: list[np.ndarray] = []

    def add(self, block: Block, h: np.ndarray, at: np.ndarray) -> None:
        if not len(h) or not block:
            return
        word = np.searchsorted(block.vocabulary, h)
        word[word == len(block.vocabulary)] = 0
        word = np.where(block.vocabulary[word] == h, word + 1, 0)
        doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
        # a document ends in a 0 of its own: word k of document d is at k + d
        full = np.zeros(len(h) + len(at), np.int64)
        full[np.arange(len(h)) + doc] = word
        run = Sequence(full)
        shortest = int(block.least[block.least > 0].min())
        where = np.arange(len(h)) + doc
        # suffixes shorter than any window end no search; whole runs are ranked where one of them is long enough
        long = where[(word > 0) & (run.room(where) >= shortest)]
        if not len(long):
            return
        stretch = np.concatenate([[0], np.cumsum(full == 0)])
        keep = np.zeros(int(stretch[-1]) + 1, bool)
        keep[stretch[long]] = True
        run.words = np.where(keep[stretch], run.words, 0)
        array = suffix_array(run, long)
        back = np.zeros(len(full) + 1, np.int64)
        back[where] = np.arange(len(h))
        base = len(self.lists)
        self.lists += block.item_ids
        test = self._windows(run, array, block, doc, back, base)
        self._longest(run, array, block, test, back, base)

    def _windows(self, run: Sequence, array: np.ndarray, block: Block, doc: np.ndarray, back: np.ndarray, base: int) -> np.ndarray:
        """Hit words and items; the test suffixes whose window stands in the shard."""
        test = np.flatnonzero(block.least)
        least = block.least[test]
        # test suffixes that begin with the same window are neighbours; the first stands for all
        same = np.zeros(len(test), bool)
        same[1:] = (np.diff(least) == 0) & (common(block.words, block.place[test[1:]], block.words, block.place[test[:-1]], least[1:]) >= least[1:])
        head, own = np.flatnonzero(~same), np.cumsum(~same) - 1
        begin, end = (_insertion(run, array, block, test[head], after, least[head]) for after in (False, True))
        there = (end > begin)[own]
        number = np.cumsum(end > begin) - 1
        test, own = test[there], number[own[there]]
        begin, end, least = (x[end > begin] for x in (begin, end, least[head]))
        if not len(test):
            return test
        which, index = ranges(begin, end)
        first, words = back[array[index]], least[which]
        n = len(self.hit) + 1
        self.hit |= np.cumsum(np.bincount(first, minlength=n) - np.bincount(first + words, minlength=n))[:-1] > 0
        # the window itself is a match, if no longer one is found
        order = np.argsort(words, kind="stable")
        order = order[words[order] > self.length[first[order]]]
        some = test[np.flatnonzero(np.diff(own, prepend=-1))][which[order]]
        place = first[order]
        self.length[place], self.start[place], self.ids[place] = words[order], block.start[some], base + block.group[some]
        # documents of each window, and items of each window, as sets; then their pairs, a part at a time
        docs, groups = int(doc[-1]) + 1, len(block.item_ids)
        spots = np.unique(which * docs + doc[first])
        of_window, of_doc = spots // docs, spots % docs
        members = np.unique(own * groups + block.group[test])
        edges = np.searchsorted(members, np.arange(len(begin) + 1) * groups)
        count = np.cumsum(np.diff(edges)[of_window])
        parts = np.unique(np.append(np.searchsorted(count, np.arange(PAIRS, int(count[-1]) + 1, PAIRS), "right"), len(of_window)))
        pairs, at = np.zeros(0, np.int64), 0
        for to in parts.tolist():
            spot, k = ranges(edges[of_window[at:to]], edges[of_window[at:to] + 1])
            pairs = np.union1d(pairs, of_doc[at:to][spot] * groups + members[k] % groups)
            at = to
        self.items.append(np.column_stack([pairs // groups, pairs % groups + base]))
        return test

    def _longest(self, run: Sequence, array: np.ndarray, block: Block, test: np.ndarray, back: np.ndarray, base: int) -> None:
        """Of each place of the shard: the longer match of those with the test suffixes before and after it."""
        before = _insertion(run, array, block, test, False)
        index = np.searchsorted(before, np.arange(len(array)), "right")
        best, of = np.zeros(len(array), np.int64), np.zeros(len(array), np.int64)
        for side in (index - 1, index):
            there = np.flatnonzero((side >= 0) & (side < len(test)))
            t = test[side[there]]
            n = common(run, array[there], block.words, block.place[t])
            n = np.where(n >= block.least[t], n, 0)
            better = n > best[there]
            best[there[better]], of[there[better]] = n[better], t[better]
        place = back[array]
        better = best > self.length[place]
        place, best, of = place[better], best[better], of[better]
        self.length[place], self.start[place], self.ids[place] = best, block.start[of], base + block.group[of]

    def columns(self, at: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """Of each document: the ids of its items, and its spans of hit words with the longest match in each."""
        docs = len(at) - 1
        pairs = np.concatenate(self.items) if self.items else np.zeros((0, 2), np.int64)
        pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
        edges = np.searchsorted(pairs[:, 0], np.arange(docs + 1))
        items = [sorted({x for k in pairs[a:b, 1].tolist() for x in self.lists[k]}) for a, b in zip(edges, edges[1:])]
        doc = np.repeat(np.arange(docs), np.diff(at))
        change = np.append(True, (np.diff(self.hit.astype(np.int8)) != 0) | (np.diff(doc) != 0)) if len(doc) else np.zeros(0, bool)
        begin = np.flatnonzero(change)
        end = np.append(begin[1:], len(doc))[: len(begin)]
        begin, end = begin[self.hit[begin]], end[self.hit[begin]]
        rows: list[list[dict]] = [[] for _ in range(docs)]
        for a, b in zip(begin.tolist(), end.tolist()):
            d, k = int(doc[a]), a + int(np.argmax(self.length[a:b]))
            first = int(at[d])
            rows[d].append({"start": a - first, "length": b - a, "item_ids": self.lists[self.ids[k]], "item_start": int(self.start[k]), "doc_start": k - first, "match_length": int(self.length[k])})
        span = pa.struct([("start", pa.int32()), ("length", pa.int32()), ("item_ids", pa.list_(pa.string())), ("item_start", pa.int32()), ("doc_start", pa.int32()), ("match_length", pa.int32())])
        return pa.array(items, pa.list_(pa.string())), pa.array(rows, pa.list_(span))


def _insertion(run: Sequence, array: np.ndarray, block: Block, test: np.ndarray, after: bool, depth: np.ndarray | None = None) -> np.ndarray:
    """Binary search of test suffixes in a shard's array: how many suffixes come before each, or (``after``) are not
    after it. With ``depth`` only so many words count."""
    low, high = np.zeros(len(test), np.int64), np.full(len(test), len(array), np.int64)
    while len(open_ := np.flatnonzero(low < high)):
        middle = (low[open_] + high[open_]) // 2
        p, t = array[middle], block.place[test[open_]]
        n = common(run, p, block.words, t, None if depth is None else depth[open_])
        order = np.sign(run.words[p + n] - block.words.words[t + n])
        if depth is not None:
            order = np.where(n >= depth[open_], 0, order)
        right = order <= 0 if after else order < 0
        low[open_] = np.where(right, middle + 1, low[open_])
        high[open_] = np.where(right, high[open_], middle)
    return low


def benchmark_blocks(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The benchmark in blocks (data: a pickled ``Block``), built by tasks and written to the shared folder. Equal
    texts are in one block."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # a word and what parts it from the next are two bytes at least
    words = items.select(F.sum(F.octet_length("text") / 2 + 1)).first()[0] or 0

    def build(rows: pa.Table) -> pa.Table:
        return pa.table({"data": pa.array([pickle.dumps(Block(list(zip(rows["item_id"].to_pylist(), rows["text"].to_pylist())), window))], pa.binary())})

    block = F.pmod(F.xxhash64("text"), F.lit(max(1, -(-int(words) // block_words))))
    return cut(items.distinct().withColumn("block", block).groupBy("block").applyInArrow(build, "data binary"), "blocks")


def _pass(base: DataFrame, data: bytes, window: int) -> DataFrame:
    sent = base.sparkSession.sparkContext.broadcast(data)
    schema = StructType(base.schema.fields + _parse_datatype_string(FOUND).fields)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pickle.loads(sent.value)
        most = min(SHARD_BYTES[1], max(SHARD_BYTES[0], 16 * len(block.place)))
        for batch in pieces(batches, "text", most):
            h, at = word_hashes(batch["text"], MARKS)
            found = Found(len(h))
            found.add(block, h, at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.diff(at), pa.int64()), *found.columns(at)], names=[*batch.schema.names, "n_words", "items", "matches"])

    return base.mapInArrow(local, schema)


def _joined(spans: Column) -> Column:
    """Spans of several passes as spans that do not touch: each with the longest of their matches (the first of equals)."""
    kind = f"array<struct<{SPAN}>>"

    def step(done: Column, s: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        apart = (F.size(done) == 0) | (last["start"] + last["length"] < s["start"])
        best = F.when(s["match_length"] > last["match_length"], s).otherwise(last)
        end = F.greatest(last["start"] + last["length"], s["start"] + s["length"])
        both = F.struct(last["start"].alias("start"), (end - last["start"]).alias("length"), *(best[c].alias(c) for c in ("item_ids", "item_start", "doc_start", "match_length")))
        return F.when(apart, F.concat(done, F.array(s))).otherwise(F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(both))).cast(kind)

    return F.aggregate(F.sort_array(spans), F.array().cast(kind), step)


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Each row of ``docs`` with ``n_words``, ``items`` and ``matches``.

    A window is ``window`` words of an item, or a whole item of fewer words. items: the ids (as strings, sorted,
    null ids left out) of the items of which a window stands in the document. matches: the spans of words (start,
    length) that windows cover, each with the longest verbatim match of it: the ids of the items with that text,
    where it begins there and in the document, and its words. Items and documents without words match nothing. Null
    texts have no words. Repeated rows match alike; an empty benchmark matches nothing, an empty table gives an
    empty result. Input columns named like a result's are replaced. A benchmark of several blocks takes as many
    passes, each of which is written to the shared folder.
    """
    ship(docs.sparkSession)
    blocks = benchmark_blocks(benchmark, window, block_words)
    base = without(docs, "n_words", "items", "matches")
    out = None
    for row in blocks.toLocalIterator():  # one block at a time
        if out is None:
            out = _pass(base, row["data"], window)
            continue
        before = cut(out.withColumnsRenamed({"items": "__items", "matches": "__matches"}).drop("n_words"), "pass")
        out = _pass(before, row["data"], window)
        out = out.withColumns({"items": F.array_sort(F.array_union("items", "__items")), "matches": _joined(F.concat("matches", "__matches"))}).drop("__items", "__matches")
    remove(blocks)
    return out if out is not None else _pass(base, pickle.dumps(Block([], window)), window)


def hit_words(matches: Column) -> Column:
    """Words of the document inside of any window of the benchmark."""
    return F.aggregate(matches, F.lit(0).cast("long"), lambda a, m: a + m["length"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, unchanged (also in columns named like those of ``find_contamination``), in which no
    window of the benchmark stands."""
    text = F.col("text").cast("string")
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), text.alias("text"))
    return find_contamination(own, benchmark, window).where(F.size("matches") == 0).select("__row.*")

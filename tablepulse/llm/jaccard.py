"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is its set of word shingles. Documents with equal sets are one class; classes link when their sets
are similar enough. A pair at the threshold shares so many shingles that, in one order of all shingles, rare
ones first, the first n - need + l shingles of either hold l common ones at least. Each class picks its own l:
a longer prefix meets more others, but fewer of them often enough; the sums of shingle frequencies over the
prefix estimate both. Two classes are verified if their prefixes share the lesser l of the two.

How it is laid out:

1. One pass over the texts. A batch of documents sends each distinct shingle once to the range of hashes that
   counts it (so a shingle of a third of all documents arrives once per batch), as a few bytes of a packed block.
   Shingles that a single document of the whole table has go no further; the others return to their batch.
2. A class that shares less than the threshold's part of its shingles with anything links with nothing and is
   done. The others get their prefixes.
3. Classes that may share l prefix shingles are brought together. Prefix shingles of few classes are counted by
   pair; the classes of a frequent one are joined to the least of them, so that its pairs are never sent.
4. What came together (connected components) is laid out in blocks of a bounded size. There, shared prefix shingles
   of any two are counted; pairs with l of them are candidates, and only candidates are verified, whole sets against
   whole sets. A component larger than a block is split by size of sets, since sets of too different sizes can't
   link, and then by hash; any two of its blocks that can hold a pair meet once. Of links only counts and spanning
   edges leave a block.

Shingles are compared by at least 48 bits of a 64-bit hash. Ranges of hashes hold about as many shingles at every
size of the table; what a batch sends to a range gets smaller as ranges get more (from 200 shingles at 0.2 TB of
text to a few at 20 TB, where a message's own 60 bytes weigh more than its shingles).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import cut, join_spread, remove, ship
from .graph import components
from .packed import pack48, unpack48
from .words import SPACES, mix, pieces, shingles, word_hashes

SHINGLE = 5
#: Least similarity, in hundredths.
PERCENT = 75
#: Shingles of one range of hashes, about.
RANGE_SHINGLES = 1 << 20
#: Prefix shingles of more classes than this are not paired.
PAIRED_CLASSES = 32
#: Classes and shingles of a block.
BLOCK_CLASSES = 1024
BLOCK_SHINGLES = 2 << 20
#: Lengths l to choose from.
MATCHES = (1, 2, 3, 4, 6, 8, 12, 16)
_SENT = "r int, batch long, docs boolean, data binary"
_DOCS = "doc_id long, key long, n long, s1 long, s2 long, shingles binary, prefix array<long>, matches int"
_LINKS = "node long, links long, root long, split boolean"


def least_overlap(n: int, percent: int = PERCENT) -> int:
    """Shingles that a set of ``n`` shares with any set it links with, at least."""
    return -(-percent * n // 100)


def _width(bits: int) -> int:
    """Bits of a shingle's hash beside those that tell its range."""
    return min(48, 64 - bits)


def _message(packed: bytes, *rest: np.ndarray) -> bytes:
    return b"".join([len(packed).to_bytes(4, "little"), packed, *(x.tobytes() for x in rest)])


def _opened(data: bytes) -> tuple[np.ndarray, bytes]:
    n = int.from_bytes(data[:4], "little")
    return unpack48(data[4 : 4 + n]), data[4 + n :]


def _send(batches: Iterator[pa.RecordBatch], bits: int, size: int) -> Iterator[pa.RecordBatch]:
    task, k = TaskContext.get().partitionId(), 0
    for batch in pieces(batches, "text"):
        for i in range(0, batch.num_rows, 32768):
            yield _send_batch(batch.slice(i, 32768), (task << 32) + k, bits, size)
            k += 1


def _send_batch(batch: pa.RecordBatch, key: int, bits: int, size: int) -> pa.RecordBatch:
    h, at = word_hashes(batch["text"], SPACES)
    n = np.zeros(batch.num_rows, np.int64)
    sums = np.zeros((batch.num_rows, 2), np.uint64)
    of = np.full(batch.num_rows, -1, np.int64)
    classes: dict[tuple, int] = {}
    sets = []
    for i in range(batch.num_rows):
        s = shingles(h[at[i] : at[i + 1]], size)
        n[i] = len(s)
        if n[i]:
            sums[i] = s.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(s ^ np.uint64(0xA5A5A5A5)))
            of[i] = classes.setdefault((int(n[i]), *sums[i].tolist()), len(classes))
            if of[i] == len(sets):
                sets.append(s)
    del h
    every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    width = _width(bits)
    every >>= np.uint64(64 - bits - width)
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets]) if sets else np.zeros(0, np.int32)
    del sets
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    del order
    first = np.flatnonzero(np.diff(every, prepend=every[:1] + np.uint64(1)) != 0) if len(every) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(every)))
    alone = count == 1
    ref = np.where(alone, owner[first], 0xFFFF).astype("<u2")
    shared = np.repeat(~alone, count)
    r = (every[first] >> np.uint64(width)).astype(np.int64)
    edges = np.append(np.flatnonzero(np.diff(r, prepend=-1)), len(r))
    low = every[first] & np.uint64((1 << width) - 1)
    rows = []
    for a, b in zip(edges.tolist(), edges[1:].tolist()):
        rows.append((int(r[a]), key, False, _message(pack48(low[a:b]), ref[a:b], count[a:b][~alone[a:b]].astype("<u4"))))
    ids = batch["doc_id"]
    table = (ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), batch["key"].to_numpy(), n, sums, of, every[shared], owner[shared].astype(np.uint16))
    rows.append((key % (1 << bits), key, True, pickle.dumps(table, protocol=5)))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.bool_(), pa.binary()))], names=["r", "batch", "docs", "data"])


def _count(table: pa.Table) -> pa.Table:
    """Of one range: the shingles with more than one class, back to the batches that sent them."""
    out, low, ref, count, sender = [], [], [], [], []
    senders = []
    r = table["r"][0].as_py()
    for batch, docs, data in zip(table["batch"].to_pylist(), table["docs"].to_pylist(), table["data"]):
        if docs:
            out.append((r, batch, True, data.as_py()))
            continue
        own, rest = _opened(data.as_py())
        refs = np.frombuffer(rest, "<u2", len(own))
        c = np.ones(len(refs), np.int64)
        c[refs == 0xFFFF] = np.frombuffer(rest, "<u4", offset=2 * len(own))
        low.append(own)
        ref.append(refs)
        count.append(c)
        sender.append(np.full(len(refs), len(senders), np.int32))
        senders.append(batch)
    if low:
        low, ref, count, sender = map(np.concatenate, (low, ref, count, sender))
        order = np.argsort(low, kind="stable")
        sorted_low = low[order]
        first = np.flatnonzero(np.diff(sorted_low, prepend=sorted_low[:1] + np.uint64(1)) != 0)
        total = np.add.reduceat(count[order], first)
        df = np.empty(len(low), np.int64)
        df[order] = np.repeat(total, np.diff(np.append(first, len(low))))
        many = df > 1
        edges = np.searchsorted(sender, np.arange(len(senders) + 1))
        for i, batch in enumerate(senders):
            own = slice(edges[i], edges[i + 1])
            m = many[own]
            if m.any():
                d = df[own][m]
                small = np.minimum(d, 255).astype(np.uint8)
                out.append((r, batch, False, _message(pack48(low[own][m]), ref[own][m].astype("<u2"), small, d[d >= 255].astype("<u8"))))
    kinds = (pa.int32(), pa.int64(), pa.bool_(), pa.binary())
    columns = list(zip(*out)) if out else [()] * 4
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["r", "batch", "docs", "data"])


def choose_prefix(n: int, df: np.ndarray, percent: int = PERCENT) -> tuple[int, int]:
    """(l, how many of the shared shingles are in the prefix) for a class of ``n`` shingles, of which the
    shared ones have frequencies ``df`` in ascending order; all others stand before them.

    A prefix meets sum(df - 1) others. At l common shingles each, sum / l of them at most have to be verified,
    at a cost that grows with the set; the l of least cost is taken.
    """
    need, alone = least_overlap(n, percent), n - len(df)
    meets = np.concatenate([[0], np.cumsum(df - 1)])
    best = None
    for k in MATCHES:
        if k > need:
            break
        live = n - need + k - alone
        cost = meets[live] * (1 + n / (50 * k))
        if best is None or cost < best[0]:
            best = (cost, k, live)
    return best[1], best[2]


def _assemble(table: pa.Table, percent: int, width: int) -> pa.Table:
    """Of one batch: its documents, the first of each class that may link with its shared shingles and prefix."""
    known, low, ref, df = None, [], [], []
    for r, docs, data in zip(table["r"].to_pylist(), table["docs"].to_pylist(), table["data"]):
        if docs:
            known = pickle.loads(data.as_py())
            continue
        own, rest = _opened(data.as_py())
        low.append(own + np.uint64(r << width))
        ref.append(np.frombuffer(rest, "<u2", len(own)))
        d = np.frombuffer(rest, np.uint8, len(own), 2 * len(own)).astype(np.int64)
        d[d == 255] = np.frombuffer(rest, "<u8", offset=3 * len(own)).astype(np.int64)
        df.append(d)
    ids, null, keys, n, sums, of, shared, owner = known
    empty = np.zeros(0, np.int64)
    low, ref, df = (np.concatenate(x) if x else empty.astype(t) for x, t in ((low, np.uint64), (ref, np.uint16), (df, np.int64)))
    local = np.flatnonzero(ref == 0xFFFF)
    local = local[np.argsort(low[local])]
    frequency = df[local][np.searchsorted(low[local], shared)] if len(shared) else empty
    alone = ref != 0xFFFF
    value, cls, df = np.concatenate([low[alone], shared]), np.concatenate([ref[alone], owner]).astype(np.int64), np.concatenate([df[alone], frequency])
    order = np.lexsort((value, df, cls))
    value, cls, df = value[order], cls[order], df[order]
    edges = np.searchsorted(cls, np.arange(of.max(initial=-1) + 2))
    blob, prefix, matches, seen = [None] * len(n), [None] * len(n), [None] * len(n), set()
    for i, c in enumerate(of.tolist()):
        if c < 0 or c in seen:
            continue
        seen.add(c)
        a, b = edges[c], edges[c + 1]
        if b - a < least_overlap(int(n[i]), percent):
            continue
        matches[i], live = choose_prefix(int(n[i]), df[a:b], percent)
        prefix[i] = value[a : a + live].view(np.int64)
        blob[i] = np.sort(value[a:b]).astype("<u8").tobytes()
    sums = sums.view(np.int64)
    return pa.Table.from_arrays(
        [pa.array(ids, pa.int64(), mask=null), pa.array(keys), pa.array(n), pa.array(sums[:, 0]), pa.array(sums[:, 1]), pa.array(blob, pa.binary()), pa.array(prefix, pa.list_(pa.int64())), pa.array(matches, pa.int32())],
        names=["doc_id", "key", "n", "s1", "s2", "shingles", "prefix", "matches"],
    )


def _local_roots(link: np.ndarray, node: np.ndarray) -> np.ndarray:
    """The least node that each can reach by ``link``."""
    root = node.copy()
    while True:
        after = root.copy()
        for i in range(0, len(node), 256):
            near = np.where(link[i : i + 256], root[None, :], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max)
            after[i : i + 256] = np.minimum(after[i : i + 256], near)
        if (after == root).all():
            return root
        root = after


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets."""
    value = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    first = np.diff(value, prepend=value[:1] + np.uint64(1)) != 0
    column = np.cumsum(first) - 1
    common = np.bincount(column)[column] > 1
    column, owner = np.unique(column[common], return_inverse=True)[1], owner[common]
    out = np.zeros((len(sets), len(sets)))
    width = max(64, (8 << 20) // max(1, len(sets)))
    for a in range(0, int(column.max(initial=-1)) + 1, width):
        i, j = np.searchsorted(column, [a, a + width])
        x = np.zeros((len(sets), int(column[j - 1]) - a + 1), np.float32)
        x[owner[i:j], column[i:j] - a] = 1
        out += x @ x.T
    return out.astype(np.int64)


def _linked(sets: list[np.ndarray], prefixes: list[np.ndarray], matches: np.ndarray, block: np.ndarray, across: bool, percent: int, n: np.ndarray) -> np.ndarray:
    """Which pairs of classes of ``n`` shingles link (``across``: only pairs of two blocks are looked at). ``sets``
    need not hold shingles that no other class has."""
    candidate = overlaps(prefixes) >= np.minimum(matches[:, None], matches[None, :])
    np.fill_diagonal(candidate, False)
    if across:
        candidate &= block[:, None] != block[None, :]
    link = np.zeros_like(candidate)
    root = _local_roots(candidate, np.arange(len(sets)))
    order = np.argsort(root, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(root[order])) + 1):
        if len(own) > 1:
            both = overlaps([sets[k] for k in own])
            link[np.ix_(own, own)] = 100 * both >= percent * (n[own][:, None] + n[own][None, :] - both)
    return link & candidate


def _verify(table: pa.Table, percent: int) -> pa.Table:
    """Links inside of a block, or between two blocks of a component too large for one."""
    out: list[list] = [[], [], [], []]
    split, i, j = table["split"][0].as_py(), table["i"][0].as_py(), table["j"][0].as_py()
    group = table["component"].to_numpy()
    order = np.argsort(group, kind="stable")
    node, matches, size, block, n = (table[c].to_numpy() for c in ("node", "matches", "size", "block", "n"))
    data, lists = table["shingles"].combine_chunks(), table["prefix"].combine_chunks()
    at, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
    for own in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
        sets = [np.frombuffer(data[int(k)].as_py(), "<u8") for k in own]
        link = _linked(sets, [flat[at[k] : at[k + 1]] for k in own], matches[own], block[own], bool(split and i != j), percent, n[own])
        out[0].append(node[own])
        out[1].append(link @ size[own])
        out[2].append(_local_roots(link, node[own]))
        out[3].append(np.full(len(own), split))
    return pa.Table.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["node", "links", "root", "split"])


def _candidates(classes: DataFrame) -> DataFrame:
    """Edges (u, v) between classes; any two that may share l prefix shingles are connected by them."""
    n_posts = classes.agg(F.sum(F.size("prefix"))).first()[0] or 0
    posts = classes.select("node", "matches", F.explode("prefix").alias("shingle"))
    tokens = posts.groupBy("shingle").agg(F.count("*").alias("m"), F.min("node").alias("head")).where("m > 1")
    posts = join_spread(posts, tokens.withColumn("w", F.col("m")), ["shingle"], "w", n_posts)
    stars = posts.where(F.col("m") > PAIRED_CLASSES).where("node <> head").select(F.col("node").alias("u"), F.col("head").alias("v")).distinct()
    stars = cut(stars, "stars")
    near = components(stars) if stars.limit(1).count() else None
    few = posts.where(F.col("m") <= PAIRED_CLASSES).select("shingle", "node", "matches")
    few = few.join(near, "node", "left") if near is not None else few.withColumn("component", F.lit(None).cast("long"))
    lists = few.groupBy("shingle").agg(F.collect_list(F.struct("node", "matches", F.coalesce("component", "node").alias("of"))).alias("l"))
    # postings that begin with the same class come together, so that their pairs are summed before they are sent
    lists = lists.select("l", F.array_min(F.transform("l", lambda x: x["node"])).alias("head"))
    pairs = lists.repartition("head").mapInArrow(_pairs, "u long, v long, least int, common long")
    pairs = pairs.groupBy("u", "v").agg(F.sum("common").alias("common"), F.min("least").alias("least")).where("common >= least")
    return stars.unionByName(pairs.select("u", "v"))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch["l"]
        at = lists.offsets.to_numpy()
        flat = lists.values
        node, matches, of = (flat.field(k).to_numpy() for k in range(3))
        us, vs, least = [], [], []
        for a, b in zip(at, at[1:]):
            i, j = np.triu_indices(b - a, 1)
            i, j = i + a, j + a
            apart = of[i] != of[j]
            i, j = i[apart], j[apart]
            us.append(np.maximum(node[i], node[j]))
            vs.append(np.minimum(node[i], node[j]))
            least.append(np.minimum(matches[i], matches[j]))
        if not us:
            continue
        u, v, w = np.concatenate(us), np.concatenate(vs), np.concatenate(least)
        if not len(u):
            continue
        order = np.lexsort((v, u))
        u, v, w = u[order], v[order], w[order]
        new = np.flatnonzero(np.append(True, (np.diff(u) != 0) | (np.diff(v) != 0)))
        yield pa.RecordBatch.from_arrays([pa.array(u[new]), pa.array(v[new]), pa.array(w[new], pa.int32()), pa.array(np.diff(np.append(new, len(u))), pa.int64())], names=["u", "v", "least", "common"])


def _blocks(classes: DataFrame, near: DataFrame, percent: int) -> DataFrame:
    """Classes of ``near`` (node, component) once for each two blocks (i, j) of their component that meet."""
    # one more than the width of a band apart, two sizes can't link; the margin is for rounding
    band = F.floor(F.log("n") / F.lit(log(100 / percent) * (1 + 1e-9))).cast("long") if percent < 100 else F.col("n")
    placed = classes.select("node", "n", "size", "shingles", "prefix", "matches").join(near, "node").withColumn("band", band)
    light = classes.select("node", "n").join(near, "node").withColumn("band", band)
    bands = light.groupBy("component", "band").agg(F.count("*").alias("m"), F.sum("n").alias("t"))
    of_component, by_band = Window.partitionBy("component"), Window.partitionBy("component").orderBy("band")
    fit = lambda m, t: F.greatest(F.ceil(m / BLOCK_CLASSES), F.ceil(t / BLOCK_SHINGLES), F.lit(1)).cast("long")
    beside = lambda side, k: F.when(side("band").over(by_band) == F.col("band") + k, side("own").over(by_band)).otherwise(F.lit(0))
    bands = bands.withColumns({"own": fit(F.col("m"), F.col("t")), "split": fit(F.sum("m").over(of_component), F.sum("t").over(of_component)) > 1})
    bands = cut(bands.withColumns({"below": beside(F.lag, -1), "above": beside(F.lead, 1)}), "bands")
    total = bands.agg(F.sum("m")).first()[0] or 0
    placed = join_spread(placed, bands.drop("t"), ["component", "band"], "m", total)
    code = lambda b, k: F.shiftleft(b, 32) + k
    blocks = lambda b, count: F.transform(F.filter(F.sequence(F.lit(0).cast("long"), count), lambda k: k < count), lambda k: code(b, k))
    placed = placed.withColumn("block", F.when(F.col("split"), code(F.col("band"), F.pmod(F.xxhash64("node"), F.col("own")))).otherwise(F.lit(0)))
    others = F.concat(blocks(F.col("band"), F.col("own")), blocks(F.col("band") - 1, F.col("below")), blocks(F.col("band") + 1, F.col("above")))
    meets = placed.withColumn("other", F.explode(F.when(F.col("split"), others).otherwise(F.array(F.lit(0).cast("long")))))
    spread = max(1, total // (BLOCK_CLASSES // 2))
    return meets.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other"), "unit": F.when(F.col("split"), F.col("component")).otherwise(F.pmod(F.xxhash64("component"), F.lit(spread)))})


def _classified(docs: DataFrame, percent: int, size: int) -> DataFrame:
    """(doc_id, key, n_shingles, root, component_id, n_links) for each row of ``docs``: ``key`` is a hash of the
    text, ``root`` a number of the component (null without words)."""
    spark = docs.sparkSession
    ship(spark)
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("key"))
    volume = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(30, max(0, ceil(volume / 6 / RANGE_SHINGLES) - 1).bit_length())
    sent = rows.mapInArrow(lambda b: _send(b, bits, size), _SENT)
    counted = sent.groupBy("r").applyInArrow(_count, _SENT)
    assembled = counted.groupBy("batch").applyInArrow(lambda t: _assemble(t, percent, _width(bits)), _DOCS)
    members = cut(assembled, "members")

    grouped = members.where("n > 0").groupBy("s1", "s2", "n").agg(
        F.min("doc_id").alias("id"), F.count("*").alias("size"), F.first("shingles", True).alias("shingles"), F.first("prefix", True).alias("prefix"), F.first("matches", True).alias("matches")
    )
    # a class is known by a number of its own from here on, whatever its ids
    grouped = cut(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")
    total = grouped.agg(F.sum("size")).first()[0] or 0
    classes = grouped.where("shingles is not null")
    near = components(_candidates(classes))
    found = cut(_blocks(classes, near, percent).groupBy("split", "unit", "i", "j").applyInArrow(lambda t: _verify(t, percent), _LINKS), "links")

    links = found.groupBy("node").agg(F.sum("links").alias("links"), F.min("root").alias("root"))
    parted = found.where("split and node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))
    if parted.limit(1).count():
        joined = components(parted).withColumnRenamed("component", "joined")
        links = links.join(joined, "node", "left").select("node", "links", F.coalesce("joined", "root").alias("root"))
    named = grouped.select("s1", "s2", "n", "size", "node", "id").join(links, "node", "left")
    named = named.select("s1", "s2", "n", "size", "id", F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    named = cut(named, "named")
    least = named.groupBy("root").agg(F.min("id").alias("component_id"), F.count("*").alias("w"))
    named = cut(join_spread(named.drop("id"), least, ["root"], "w", named.count()), "named")
    for done in (found, grouped):
        remove(done)
    full = join_spread(members.where("n > 0").select("doc_id", "key", "n", "s1", "s2"), named, ["s1", "s2", "n"], "size", total)
    full = full.select("doc_id", "key", F.col("n").alias("n_shingles"), "root", "component_id", "n_links")
    none = members.where("n = 0").select("doc_id", "key", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return full.unionByName(none)


def similarity_classes(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for each row of ``docs`` (doc_id, text).

    component_id is the least doc_id that can be reached by links, itself included; n_links counts all other
    rows that the row links with. Rows with equal sets link. Rows without words have no shingles, their own
    doc_id and no links. Null ids are no one's component (null, if no id can be reached). Repeated rows are
    rows; a doc_id that stands for different texts keeps them apart, unless they link. An empty table gives an
    empty result. Other columns are ignored.
    """
    return _classified(docs, percent, size).select("doc_id", "n_shingles", "component_id", "n_links")


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, one of each component: that of the least doc_id (ids before nulls), and where several
    texts have it, of the least hash of the text. Of rows that agree in doc_id and text any one stays. Rows
    without words are in no component and all stay. Rows are told apart by doc_id and text, never by doc_id alone.
    """
    same = ["__null", "__id", "__key"]
    doc_id = F.col("doc_id").cast("long")
    marked = docs.withColumns({"__null": doc_id.isNull(), "__id": F.coalesce(doc_id, F.lit(0)), "__key": F.xxhash64(F.col("text").cast("string"))})
    rows = _classified(docs, percent, SHINGLE).where("root is not null")
    kinds = rows.groupBy("root", F.col("doc_id").isNull().alias("__null"), F.coalesce("doc_id", F.lit(0)).alias("__id"), F.col("key").alias("__key")).agg(F.count("*").alias("m"))
    kinds = cut(kinds, "kinds")
    least = kinds.groupBy("root").agg(F.min(F.struct(*same)).alias("least"), F.count("*").alias("w"))
    judged = cut(join_spread(kinds, least, ["root"], "w", kinds.count()).select(*same, "m", (F.struct(*same) == F.col("least")).alias("stays")), "judged")
    remove(kinds)
    total = judged.agg(F.sum("m")).first()[0] or 0
    kept = join_spread(marked, judged.where("not stays"), same, "m", total, "left_anti")
    again = judged.where("stays and m > 1").drop("stays")
    if again.limit(1).count():
        one = join_spread(kept, again, same, "m", total).dropDuplicates(same).select(*kept.columns)
        kept = join_spread(kept, again, same, "m", total, "left_anti").unionByName(one)
    return kept.select(*docs.columns)

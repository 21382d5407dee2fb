"""The ten operators and the pipeline against brute force, and on awkward inputs."""

import collections
import gzip
import hashlib
import math
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tablepulse.llm import attention, jaccard, lm, packing, sharding, url_filters, warc
from tablepulse.llm import quality as quality_module
from tablepulse.llm.bpe import default_path, encoder
from tablepulse.llm.chat import format_pairs, preference_pairs, swapped_replies
from tablepulse.llm.decontaminate import Block, Found, Sequence, common, decontaminate, find_contamination, hit_words, suffix_array
from tablepulse.llm.graph import components
from tablepulse.llm.lm import score_documents
from tablepulse.llm.packed import pack48, unpack48
from tablepulse.llm.quality import quality
from tablepulse.llm.token_counts import token_counts
from tablepulse.llm.url_filters import url_filter
from tablepulse.llm.words import MARKS, SPACES, word_hashes

LOREM = "the quick brown fox jumps over the lazy dog and runs far away from it while nobody looks at all today".split()


def text(seed, n=40):
    rng = np.random.default_rng(seed)
    return " ".join(f"{LOREM[rng.integers(len(LOREM))]}{rng.integers(30)}" for _ in range(n))


def near(base, k):
    words = base.split()
    words[k % len(words)] = f"changed{k}"
    return " ".join(words)


BASE = text(1, 60)
#: Nulls, empties, repeats, a long text, near copies, ties, white space of all kinds.
TEXTS = [None, "", "  \n\t ", "one", "One", "a b c d", BASE, BASE.upper(), BASE.replace(" ", "\n\t "), *(near(BASE, k) for k in (0, 20, 59)), near(near(BASE, 10), 30), *(text(s) for s in range(2, 9)), text(9, 30000), "dup " * 500, "x\x00y\x1cz é\xa0ü — €", "line\nline\nline\n\nother line here", text(2) + " " + BASE, "#*$%&|<> ### a"]
DOCS = [(i, t) for i, t in enumerate(TEXTS)] + [(6, BASE), (None, BASE), (None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    """With columns named like the operators' own."""
    rows = [(i, t, "en", 5, True, i, "x") for i, t in DOCS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words long, kept boolean, shard long, Matches string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def words(t):
    return (t or "").encode().lower().split()


def test_word_hashes_and_packing():
    h, at = word_hashes(pa.array(["A b", None, "a  B\n"]), SPACES)
    assert at.tolist() == [0, 2, 2, 4] and h[0] == h[2] and h[1] == h[3] and h[0] != h[1]
    long = "w" * 3_000_000
    h, _ = word_hashes(pa.array([long + " " + long.upper() + " v"]), SPACES)
    assert h[0] == h[1] != h[2]
    for v in ([], [0], [5, 5, 9, 1 << 47], sorted(np.random.default_rng(0).integers(0, 1 << 48, 1000).tolist())):
        assert unpack48(pack48(np.array(v, np.uint64))).tolist() == v


# 1


def test_shards_are_gapless_and_even(spark, docs, empty):
    out = sharding.shard(docs, 4).collect()
    assert len(out) == len(DOCS)
    by = collections.defaultdict(list)
    for r in out:
        assert r["size"] == len((r["text"] or "").encode()) + 1
        by[r["shard"]].append(r)
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())
    assert sharding.shard(empty, 4).count() == 0
    hot = spark.range(4000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'same text of all' else concat('t', id, repeat('x', cast(id % 50 as int))) end as text")
    sums = collections.Counter()
    for r in sharding.shard(hot, 8, task_bytes=4096).collect():
        sums[r["shard"]] += r["size"]
    assert len(sums) == 8 and max(sums.values()) - min(sums.values()) <= 0.02 * sum(sums.values()) / 8


def check_shards(rows, shards, slack):
    sums, slots = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        sums[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(sums) == shards and max(sums.values()) - min(sums.values()) <= slack
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_a_hot_text_inside_of_a_shard_is_split(spark):
    rows = spark.range(8000).selectExpr("id as doc_id", "case when id % 40 = 0 then repeat('same text', 5) else concat('t', id, repeat('x', cast(id % 50 as int))) end as text")
    high, low = F.xxhash64("text"), F.col("doc_id")
    keys = rows.select(high.alias("high"), low.alias("low"), sharding.size_of(F.col("text")).alias("size"))
    _, known = sharding.find_splitters(keys, 8, 0.002, 4096)
    assert max(b - a for (_, a, _), (_, b, _) in zip(known, known[1:])) <= 4096
    out = sharding.shard(rows, 8, task_bytes=4096)
    check_shards(out.collect(), 8, 200)
    sizes = out.groupBy(F.spark_partition_id()).agg(F.sum("size")).collect()
    assert max(r[1] for r in sizes) <= 2 * 4096


@pytest.mark.parametrize("doc_id", ["cast(null as long)", "7", "id % 2"])
def test_rows_of_one_key_are_split(spark, doc_id):
    rows = spark.range(3000).selectExpr(f"case when id % 2 = 0 then {doc_id} else id end as doc_id", "case when id % 2 = 0 then repeat('same text', 5) else concat('t', id) end as text").repartition(5)
    out = sharding.shard(rows, 8, task_bytes=2048).collect()
    assert len(out) == 3000
    check_shards(out, 8, 200)
    one = spark.range(100).selectExpr("1 as doc_id", "'x' as text")
    check_shards(sharding.shard(one, 8).collect(), 8, 4)


def test_bucket_of_128_bit_keys():
    rng = np.random.default_rng(3)
    high, low = rng.integers(-2, 3, 500), rng.integers(-5, 5, 500)
    keys = [((int(h) + (1 << 63)) << 64) | (int(x) + (1 << 63)) for h, x in zip(high, low)]
    probes = sorted(set(keys[:40]))
    assert sharding.bucket_of(high, low, probes).tolist() == [sum(p <= k for p in probes) for k in keys]


# 2


@pytest.mark.parametrize(("broadcast_rules", "hot_keys"), [(1000, 4096), (0, 4096), (1000, 3), (0, 1)])
def test_urls(spark, monkeypatch, broadcast_rules, hot_keys):
    """``hot_keys``: all URLs count as frequent, one that has half the rows, or none."""
    monkeypatch.setattr(url_filters, "HOT_KEYS", hot_keys)
    rules = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("b.c", "", "block"), ("x.y", "/p", "allow"), ("x.y", "/p", "block"), (None, "/", "block"), ("", "/", "block")]
    urls = ["http://Example.COM/en/71?q=/en/", "https://a.example.com/en/8", "http://notexample.com/en/7", "http://b.c", "http://a.b.c?x", "http://x.y/p/q", "no scheme", "", None, None, "://", "http://com/en/", "http://a.com./en/", "x://h#/en/", "http://x/a://com/en/", *["http://b.c/hot"] * 12]
    pages = spark.createDataFrame([(i % 5, u, "old", 1) for i, u in enumerate(urls)], "page_id int, url string, Verdict string, extra int")
    table = spark.createDataFrame(rules, "host string, path string, action string")

    def judge(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", rest).groups()
        host = host.lower()
        fit = [(len(h) + len(p), len(h), a == "block", h + p, a) for h, p, a in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=(0, 0, 0, None, "allow"))
        return (u, host, path, best[3], best[4])

    got = url_filter(pages, table, broadcast_rules=broadcast_rules).collect()
    assert sorted((tuple(r[c] for c in ("url", "host", "path", "rule", "verdict")) for r in got), key=str) == sorted(map(judge, urls), key=str)
    assert url_filter(pages, table.where("false")).where("verdict = 'allow' and rule is null").count() == len(urls)
    assert url_filter(pages.where("false"), table).count() == 0


# 3


def brute_classes(rows):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    n = len(rows)
    link = [[i != j and bool(sets[i]) and bool(sets[j]) and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) for j in range(n)] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in np.flatnonzero(link[todo.pop()]).tolist():
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], len(sets[i]), min(ids) if ids else None, sum(link[i])))
    return sorted(out, key=str)


def test_similarity_classes(docs, empty):
    got = [tuple(r) for r in jaccard.similarity_classes(docs).collect()]
    assert sorted(got, key=str) == brute_classes(DOCS)
    assert jaccard.similarity_classes(empty).count() == 0


def test_large_groups_are_split(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PAIRED_CLASSES", 3)
    monkeypatch.setattr(jaccard, "BLOCK_CLASSES", 8)
    rows = [(i, near(near(BASE, i), 7 * i)) for i in range(40)] + [(100 + i, near(text(50, 30), i)) for i in range(6)] + [(200 + i, text(200 + i)) for i in range(20)]
    got = [tuple(r) for r in jaccard.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == brute_classes(rows)


@pytest.mark.parametrize("base", [0, 1 << 62, (1 << 63) - 60, -(1 << 63)])
def test_classes_of_any_ids(spark, base):
    rows = [(base + i, near(text(500, 120), i)) for i in (5, 12, 30)] + [(base + 40 + i, text(600 + i)) for i in range(3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in jaccard.similarity_classes(frame).collect()), key=str) == brute_classes(rows)
    assert {r[0] for r in jaccard.keep_one(frame).collect()} == {base + i for i in (5, 40, 41, 42)}


def test_keep_one_row_of_each_component(spark, empty):
    rows = [(1, BASE, "a"), (1, BASE, "b"), (2, near(BASE, 3), "c"), (2, text(70), "other text of the same id"), (None, BASE, "d"), (None, text(71), "e"), (None, text(71), "f"), (3, None, "g"), (3, None, "h"), (4, text(72), "i"), (4, text(72), "j")]
    got = collections.Counter((r["doc_id"], r["text"]) for r in jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string, n long, root string".replace("n long, ", "")).repartition(3)).collect())
    assert got == {(1, BASE): 1, (2, text(70)): 1, (None, text(71)): 1, (3, None): 2, (4, text(72)): 1}
    assert jaccard.keep_one(empty).count() == 0


def test_sizes_of_a_large_component(spark, monkeypatch):
    """A chain of sets of growing size: blocks by size lose no link."""
    monkeypatch.setattr(jaccard, "PAIRED_CLASSES", 2)
    monkeypatch.setattr(jaccard, "BLOCK_CLASSES", 4)
    whole = text(80, 400).split()
    rows = [(i, " ".join(whole[: 30 + 9 * i])) for i in range(40)] + [(100 + i, near(" ".join(whole[: 30 + 9 * i]), 11)) for i in range(40)]
    got = [tuple(r) for r in jaccard.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == brute_classes(rows)


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (50, 200), (200, 50), (7, 7)]
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 102: 100, 50: 50, 200: 50}


def test_prefix_choice_is_within_bounds():
    for n in (1, 5, 40, 400):
        need = jaccard.least_overlap(n)
        for shared in range(need, n + 1):
            k, live = jaccard.choose_prefix(n, np.sort(np.random.default_rng(shared).integers(2, 50, shared)))
            assert 1 <= k <= need and live == n - need + k - (n - shared) and 1 <= live <= shared


# 4, 5


def test_token_counts(spark, docs, empty):
    e = encoder(default_path())
    lengths = np.array([len(e.tokenizer.encode(t or "", add_special_tokens=False).ids) for _, t in DOCS])
    limits, shares = [0, 3, 10**6], [0.5, 1.0]
    rows = token_counts(docs, limits=limits, shares=shares).collect()
    got = {r["n_tokens"]: r for r in rows if r["kind"] == "length"}
    assert set(got) == set(lengths.tolist())
    for n, r in got.items():
        assert (r["n_docs"], r["docs_ge"], r["tokens_ge"], r["truncated_total"]) == ((lengths == n).sum(), (lengths >= n).sum(), lengths[lengths >= n].sum(), np.minimum(lengths, n).sum())
    assert {r["n_tokens"]: (r["truncated_total"], r["docs_ge"]) for r in rows if r["kind"] == "limit"} == {x: (np.minimum(lengths, x).sum(), (lengths >= x).sum()) for x in limits}
    ordered = np.sort(lengths)
    assert {r["share"]: r["n_tokens"] for r in rows if r["kind"] == "quantile"} == {q: ordered[math.ceil(q * len(ordered)) - 1] for q in shares}
    assert token_counts(docs).where("kind <> 'length'").count() == 0
    assert [(r["n_tokens"], r["truncated_total"]) for r in token_counts(empty, limits=[7], shares=[0.5]).collect()] == [(7, 0)]
    assert token_counts(empty).count() == 0


@pytest.mark.parametrize("t", ["a  b", "a \nb\n\n", " ", "<|endoftext|> x", "a\x1c!\x1c", "a　 b\xa0 c", "don't 12,5 €", "\u2028 x"])
def test_ids_are_the_library_s(t):
    e = encoder(default_path())
    assert e.ids(t).tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("blank", [" ", "\n", "\u3000"])
def test_ids_of_long_white_space(blank):
    e = encoder(default_path())
    t = "a" + blank * 2_000_000 + "x"
    assert e.ids(t).tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids
    if blank == "\u3000":  # no separator of words
        ids, at = lm._encode([b"a", t.encode()], default_path())
        assert ids[at[1] :].tolist() == e.tokenizer.encode(" " + t, add_special_tokens=False).ids


def check_packing(rows, pieces, limits):
    e = encoder(default_path())
    want = collections.Counter((i, tuple(e.tokenizer.encode(t or "", add_special_tokens=False).ids + [0])) for i, t in rows)
    parts = collections.defaultdict(list)
    sequences = collections.defaultdict(list)
    for r in pieces:
        sequences[r["sequence_id"]].append(r)
        parts[(r["doc_id"], r["doc_tokens"], r["start"])].append(np.frombuffer(r["ids"], "<u4").tolist())
    assert sum(len(x) for v in parts.values() for x in v) == sum(len(k[1]) * n for k, n in want.items())
    for (doc, ids), n in want.items():
        for start in {k[2] for k in parts if k[:2] == (doc, len(ids))}:
            assert sum(list(ids[start : start + len(p)]) == p for p in parts[(doc, len(ids), start)]) >= n
    for v in sequences.values():
        v.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in v] == np.cumsum([0, *(r["length"] for r in v)])[:-1].tolist()
        assert sum(r["length"] for r in v) <= limits.tokens and len(v) <= limits.segments and sum(r["loss_tokens"] for r in v) <= limits.loss_tokens
    return len(sequences)


@pytest.mark.parametrize("limits", [packing.Limits(), packing.Limits(64, 3, 40)])
def test_packing(docs, empty, limits):
    check_packing(DOCS, packing.pack_documents(docs, limits, pool_tokens=2000).collect(), limits)
    assert packing.pack_documents(empty, limits).count() == 0


def test_prompts_bear_no_loss(spark):
    limits = packing.Limits(64, 3, 48)
    body = lambda s, n: " ".join(text(s, n).split())
    rows = [(i, f"{body(i, 5 + i % 40)}\n{body(100 + i, 3 + 7 * i % 90)}") for i in range(60)] + [(90, None), (91, "<|endoftext|> x\ny"), (92, "é€ ü\n" + body(7, 50)), (None, "\n")]
    frame = spark.createDataFrame([(i, t, t.index("\n") + 1 if t else None) for i, t in rows], "doc_id long, text string, chars int")
    prompt = F.when(F.instr("text", "\n") > 0, F.octet_length(F.substring_index("text", "\n", 1)) + 1)
    pieces = packing.pack_documents(frame, limits, pool_tokens=3000, prompt_bytes=prompt).collect()
    check_packing(rows, pieces, limits)
    e = encoder(default_path())
    want = {}
    for i, t in rows:
        ids, loss, size = e.tokenizer.encode(t or "", add_special_tokens=False).ids, [], 0
        head = len(t.split("\n")[0].encode()) + 1 if t else 0
        for k in ids:
            loss.append(size >= head)
            size += len(e.tokenizer.id_to_token(k)) if k != 50256 else len("<|endoftext|>")
        want[i] = [*loss, True]
    for r in pieces:
        assert r["loss_tokens"] == sum(want[r["doc_id"]][r["start"] : r["start"] + r["length"]])
    for total, n_prompt in ((1, 0), (64, 64), (65, 0), (500, 499), (500, 100), (5, 900)):
        cut = list(packing.cut_document(total, n_prompt, limits))
        assert [c[0] for c in cut] == np.cumsum([0, *(c[1] for c in cut)])[:-1].tolist() and sum(c[1] for c in cut) == total
        assert all(n <= 64 and loss == max(0, min(n, start + n - n_prompt)) <= 48 for start, n, loss in cut)


def largest_fit(demands, limits):
    """Sequences that the longest piece that still fits is put into each time."""
    need, n = np.column_stack([demands[:, 0], np.ones(len(demands), int), demands[:, 1]]), 0
    need = need[np.lexsort(-need.T[::-1])]
    while len(need):
        rest, n, keep = np.array([limits.tokens, limits.segments, limits.loss_tokens]), n + 1, np.ones(len(need), bool)
        for i, d in enumerate(need):
            if (d <= rest).all():
                rest, keep[i] = rest - d, False
        need = need[keep]
    return n


def test_the_heuristic_weighs_all_limits():
    for limits, low, high, part_loss, share in ((packing.Limits(1000, 4, 500), 20, 500, 0.5, 1.0), (packing.Limits(1024, 8, 768), 20, 600, 0.5, 1.01), (packing.Limits(1000, 6, 400), 10, 300, 0.3, 1.02)):
        ours = largest = 0
        for seed in range(4):
            rng = np.random.default_rng(seed)
            # long prompts with short replies, and the other way round
            tokens = rng.integers(low, high, 400)
            demands = np.column_stack([tokens, (tokens * np.where(rng.random(400) < part_loss, 0.05, 0.95)).astype(int)])
            full, part = packing.pack(demands, limits)
            assert sorted(i for s in full + part for i in s) == list(range(400))
            ours, largest = ours + len(full) + len(part), largest + largest_fit(demands, limits)
        assert ours < share * largest
    limits = packing.Limits(1000, 8, 500)
    assert max(len(s) for s in sum(packing.pack(np.ones((100, 2), np.int64), limits), [])) == 8


def test_packing_is_tight():
    n = np.random.default_rng(5).integers(1, 1024, 3000)
    full, part = packing.pack(np.column_stack([n, n - 1]), packing.Limits())
    assert sorted(i for s in full + part for i in s) == list(range(3000))
    assert len(full) + len(part) <= 1.02 * n.sum() / 1024 + 1


# 6


def test_colliding_windows_are_told_apart(spark):
    w, keys = F.split(F.lit("a b c d e a b c d f a b c d e"), " "), F.array(*(F.struct(F.lit(1).alias("h"), F.lit(i).alias("i")) for i in (0, 5, 10)))
    hits = quality_module._equals(w, keys, lambda x, y: x["h"] == y["h"], lambda x: x["i"])
    assert [r["i"] for r in spark.range(1).select(hits.alias("x")).first()["x"]] == [0, 10]


def test_quality(docs, empty):
    got = sorted((tuple(r[c] for c in ("doc_id", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in quality(docs).collect()), key=str)

    def count(i, t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        often = collections.Counter(windows)
        covered = {k + j for k, x in enumerate(windows) if often[x] > 1 for j in range(5)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return (i, t, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w))

    assert got == sorted((count(i, t) for i, t in DOCS), key=str)
    assert quality(docs).where("kept and base_failed").count() == 0
    assert quality(empty).count() == 0
    assert "lang" in quality(docs).columns and quality(docs).columns.count("n_words") == 1


# 7


def test_probabilities_sum_to_one():
    tree = attention.Tree(np.array([5, 1, 9, 0, 3, 2]))
    model = attention.start(tree, 6)
    rng = np.random.default_rng(0)
    model["N"] = rng.standard_normal(model["N"].shape).astype(np.float32)
    state = rng.standard_normal((1, attention.DIM)).astype(np.float32).repeat(6, 0)
    assert np.exp(attention.log_probability(model, tree, state, np.arange(6))).sum() == pytest.approx(1, abs=1e-5)


def test_only_nodes_on_the_paths_are_worked_out():
    """Of 65,536 ids with paths of 7 to 8 nodes: no table of all heavy nodes is held, and each sum is that of its path."""
    rng = np.random.default_rng(6)
    tree = attention.Tree(np.ones(200, np.int64))
    model = attention.start(tree, 200)
    model["N"] = rng.standard_normal(model["N"].shape).astype(np.float32)
    state, y = rng.standard_normal((1 << 16, attention.DIM)).astype(np.float32), rng.integers(0, 200, 1 << 16)
    tracemalloc.start()
    got = attention.log_probability(model, tree, state, y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 << 20
    for i in range(0, 1 << 16, 997):
        path = slice(tree.begin[y[i]], tree.begin[y[i] + 1])
        z = tree.sign[path] * (model["N"][tree.node[path]] @ state[i] + model["b"][tree.node[path]])
        assert got[i] == pytest.approx(-np.log1p(np.exp(-z)).sum(), rel=1e-4)


def test_windows_score_each_id_once_and_causally():
    lengths = [1, 5, 32, 33, 56, 57, 200]
    at = np.concatenate([[0], np.cumsum(lengths)])
    ids = np.random.default_rng(1).integers(0, 5, at[-1])
    x, y, scored, text = attention.cut_windows(ids, at, 5)
    assert np.bincount(text, scored.sum(axis=1)).tolist() == lengths
    model = attention.start(attention.Tree(np.ones(6)), 6)
    before, _ = attention.hidden(model, x[-1:])
    changed = x[-1:].copy()
    changed[0, 20:] = (changed[0, 20:] + 1) % 6
    after, _ = attention.hidden(model, changed)
    assert np.allclose(before[:20], after[:20]) and not np.allclose(before[20:], after[20:])


def test_gradients():
    rng = np.random.default_rng(2)
    tree = attention.Tree(rng.integers(1, 9, 12))
    model = {k: v.astype(np.float64) for k, v in attention.start(tree, 12).items()}
    model["N"] = rng.standard_normal(model["N"].shape)
    x, y = rng.integers(0, 12, (3, attention.CONTEXT)), rng.integers(0, 12, (3, attention.CONTEXT))
    scored = rng.random((3, attention.CONTEXT)) < 0.7

    def loss(m):
        g = attention.hidden(m, x)[0][scored.reshape(-1)]
        return -attention.log_probability(m, tree, g, y[scored]).sum()

    for name in ("E", "Wq", "Wk", "Wv", "Wo", "W1", "b1", "W2", "N", "b", "P"):
        past = {k: np.zeros_like(v) for k, v in model.items()}
        moved = {k: v.copy() for k, v in model.items()}
        with np.errstate(all="ignore"):
            attention.step(moved, past, tree, x, y, scored)
        k = np.unravel_index(np.argmax(past[name]), past[name].shape)
        up, down = ({**model, name: model[name].copy()} for _ in range(2))
        up[name][k] += 1e-5
        down[name][k] -= 1e-5
        assert abs((loss(up) - loss(down)) / 2e-5) == pytest.approx(math.sqrt(past[name][k]), rel=1e-2)


def test_scores(spark, docs, empty):
    got = [tuple(r) for r in score_documents(docs).collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = collections.Counter(w for i, t in DOCS if not held(i) for w in [*words(t), None])
    n, v = sum(c.values()), len(c)
    want = []
    for i, t in DOCS:
        own = [*words(t), None]
        want.append((i, held(i), len(own), sum(c[w] > 0 for w in own), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own), 6), n))
    assert sorted(((a, b, d, e, round(f, 6), h) for a, b, d, e, f, g, h in got), key=str) == sorted(want, key=str)
    assert all(math.isfinite(r[5]) and r[5] < 0 for r in got)
    assert score_documents(empty).count() == 0


def test_model_learns(spark):
    rows = [(i, " ".join(["red green blue"] * 20)) for i in range(300)]
    got = score_documents(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").agg({"score": "sum", "n_tokens": "sum"}).first()
    assert got[0] / got[1] > math.log10(1 / 3)  # better than words at random


def test_every_id_is_learned_from_once():
    lengths = [1, 5, 32, 33, 64, 65, 200]
    at = np.concatenate([[0], np.cumsum(lengths)])
    ids = np.arange(at[-1])  # all different
    learned = np.array([True, True, False, True, True, False, True])
    seen = np.concatenate([y[scored] for _, y, scored in attention.training_blocks(ids, at, 999, learned)])
    assert sorted(seen.tolist()) == [k for i, on in enumerate(learned) if on for k in range(at[i], at[i + 1])]


def plain_score(m, counts, ids, end):
    """Of one text, id by id: every place's state from the whole window, every choice on the id's path by itself."""
    tree, total = attention.Tree(counts), 0.0
    for place in range(len(ids)):
        k = 0 if place < attention.CONTEXT else -(-(place - attention.CONTEXT + 1) // attention.STRIDE)
        first = k * attention.STRIDE
        before = [end, *ids][first : place + 1]
        X = np.array([m["E"][t] + m["P"][j] for j, t in enumerate(before)])
        q, K, V = X[-1] @ m["Wq"], X @ m["Wk"], X @ m["Wv"]
        weight = np.exp(K @ q / math.sqrt(attention.DIM))
        h = X[-1] + (weight / weight.sum()) @ V @ m["Wo"]
        g = h + np.maximum(h @ m["W1"] + m["b1"], 0) @ m["W2"]
        y = ids[place]
        for node, sign in zip(tree.node[tree.begin[y] : tree.begin[y + 1]], tree.sign[tree.begin[y] : tree.begin[y + 1]]):
            total -= math.log1p(math.exp(-sign * (g @ m["N"][node] + m["b"][node])))
    return total


def test_scores_of_a_plain_loop():
    rng = np.random.default_rng(4)
    counts = rng.integers(0, 50, 120)
    model = attention.start(attention.Tree(counts), 120)
    model["N"] = rng.standard_normal(model["N"].shape).astype(np.float32) * 0.3
    lengths = [1, 7, 31, 32, 33, 57, 140, 0]
    at = np.concatenate([[0], np.cumsum(lengths)])
    ids = rng.integers(0, 120, at[-1])
    got = attention.score(model, attention.Tree(counts), ids, at, 119)
    exact = {k: v.astype(np.float64) for k, v in model.items()}
    assert got == pytest.approx([plain_score(exact, counts, ids[a:b].tolist(), 119) for a, b in zip(at, at[1:])], rel=1e-4, abs=1e-4)


def test_scores_of_an_unlearned_model(spark, docs):
    """Before any round the model is the add-one unigram of all ids, texts and batches put together as they should."""
    e = encoder(default_path())
    end, held = e.engine.max_token_value + 1, lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    ids = {(i, t): [k for w in words(t) for k in e.plain(" " + w.decode()).tolist()] + [end] for i, t in DOCS}
    c = collections.Counter(k for i, t in DOCS if not held(i) for k in ids[(i, t)])
    n = sum(c.values()) + end + 1
    want = [(i, sum(math.log10((c[k] + 1) / n) for k in ids[(i, t)])) for i, t in DOCS]
    got = [(r["doc_id"], r["score"]) for r in score_documents(docs, rounds=0).collect()]
    key = lambda r: (str(r[0]), r[1])
    for (a, x), (b, y) in zip(sorted(got, key=key), sorted(want, key=key)):
        assert a == b and x == pytest.approx(y, rel=1e-3)


def test_changes_are_put_together():
    m = {"a": np.zeros(16, np.float32)}
    before = (np.zeros(16, np.float32), np.full(16, 0.01, np.float32))
    parts = []
    for task, (at, move) in enumerate([(3, 2.0), (3, 4.0), (9, 5.0)]):
        moved, past = {"a": m["a"].copy()}, {"a": before[1].copy()}
        moved["a"][at], past["a"][at] = move, 1.01
        parts += list(lm._changes(before, moved, past, task))
    out = {}
    for p in range(lm.PARTS):
        some = [b for b in parts if b["part"][0].as_py() == p]
        at, came, change = (np.frombuffer(x, t) for x, t in zip(lm.pickle.loads(lm._add(pa.Table.from_batches(some))["data"][0].as_py()), ("<u4", "<f4", "<f4")))
        out |= {int(k) + 2 * p: (float(c), float(x / c)) for k, c, x in zip(at, came, change)}
    assert out == {3: (2.0, 3.0), 9: (1.0, 5.0)}  # the mean of two tasks; the whole of one


# 8


def test_warc_round_trip(spark, tmp_path):
    big = "é\r\n\r\nWARC/1.1\r\n" * 20
    rows = [(5, "http://a", big), (2, "http://b\r\nX: y", big), (9, None, big), (7, "u", "small"), (8, "u", "small"), (1, "u", None), (3, "u", ""), (None, "u", "n" * 200), (4, "u", "n" * 200), (6, "u", "z" * 300), (6, "u", "z" * 300), (10, "u", "w" * 200_000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    got = warc.archive_round_trip(pages, str(tmp_path / "w")).collect()
    first = {}
    for i, _, h in rows:
        if h and len(h.encode()) >= 100 and i is not None:
            first[h] = min(first.get(h, i), i)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        again = len(raw) >= 100 and i != first.get(h, i)
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    assert sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in got), key=str) == sorted(want, key=str)
    assert {bytes(r["payload"]).decode() for r in got if r["payload"] is not None} == {r[2] or "" for r in rows}
    assert warc.archive_round_trip(pages.where("false"), str(tmp_path / "e")).count() == 0
    with pytest.raises(ValueError):
        list(warc.parse([b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"]))
    with pytest.raises(ValueError):
        list(warc.inflate(memoryview(gzip.compress(b"x" * 100)[:-9])))


def test_archives_of_bounded_files_with_a_member_per_record(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_FIRST", 0)
    pages = spark.range(300).selectExpr("id as page_id", "concat('http://x/', id) as url", "case when id % 3 = 0 then repeat('same ', 50) else repeat(cast(id as string), 400) end as html").repartition(2)
    path = str(tmp_path / "w")
    warc.write_warc(warc.plan_captures(pages), path, file_bundles=1)
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 2000)
    small = str(tmp_path / "s")
    warc.write_warc(warc.plan_captures(pages), small, file_bundles=2)
    files = [f.read_bytes() for f in (tmp_path / "w").glob("part-*")]
    assert len(files) == 2
    records = [r for f in files for r in warc.parse(warc.inflate(memoryview(f)))]
    members, rest = 0, b"".join(files)
    while rest:
        d = zlib.decompressobj(31)
        members += bool(d.decompress(rest))
        rest = d.unused_data
    assert members == len(records) == 900
    by_id = {h["warc-record-id"]: h for h, _ in records}
    assert len(by_id) == 900
    again = [h for h, _ in records if h["warc-type"] == "revisit"]
    assert len(again) == 99 and {h["warc-refers-to"] for h in again} <= set(by_id)
    whole = (tmp_path / "one").mkdir() or tmp_path / "one" / "a.warc.gz"
    whole.write_bytes(gzip.compress(b"".join(b"".join(warc.inflate(memoryview(f))) for f in files)))
    for p in (path, small, str(tmp_path / "one")):
        got = {r["page_id"]: (r["record_type"], r["refers_to"], r["url"]) for r in warc.resolve(warc.transactions(warc.read_records(spark, p))).collect()}
        assert got == {i: ("revisit" if i % 3 == 0 and i else "response", 0 if i % 3 == 0 and i else None, f"http://x/{i}") for i in range(300)}


# 9


def test_contamination(spark, docs, empty):
    first = BASE.split()
    bench = [(1, " ".join(first[5:30])), (2, " ".join(first[5:30])), (10, BASE), (3, "dog!! QUICK?"), (4, None), (5, " .. "), (None, " ".join(first[:12])), (6, "dup"), (7, " ".join(first[40:50]))]
    extra = [*DOCS, (900, "a quick, dog quick? x"), (901, " ".join(first[3:20]) + " zz " + " ".join(first[18:40]))]
    table = spark.createDataFrame(bench, "item_id long, text string")
    frame = spark.createDataFrame([(i, t, 1) for i, t in extra], "doc_id long, text string, n_words int")

    def tokens(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    def judge(i, t):
        w, hit, items = tokens(t), set(), set()
        for item, b in bench:
            own = tokens(b)
            n = min(10, len(own))
            for k in range(len(own) - n + 1 if own else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == own[k : k + n]:
                        hit |= set(range(p, p + n))
                        items |= {str(item)} if item is not None else set()
        return (i, t, len(w), len(hit), sorted(items))

    def match_lengths(t):
        """Of each span of hit words: the longest match in it, word by word."""
        w, own = tokens(t), [tokens(b) for _, b in bench]
        best = [0] * len(w)
        for b in own:
            n = min(10, len(b))
            for k in range(len(b)):
                for p in range(len(w)):
                    m = 0
                    while k + m < len(b) and p + m < len(w) and b[k + m] == w[p + m]:
                        m += 1
                    if m and m >= n and (k == 0 or len(b) >= 10):
                        best[p] = max(best[p], m)
        hit = set(x for p, m in enumerate(best) for x in range(p, p + m))
        spans = [[p for p in range(a, len(w) + 1)] for a in sorted(hit) if a - 1 not in hit]
        return [max(best[p] for p in s[: next(i for i, p in enumerate(s) if p not in hit)]) for s in spans]

    for block_words in (1 << 20, 10):
        out = find_contamination(frame, table, block_words=block_words)
        rows = out.withColumn("n_hit", hit_words(out["matches"])).collect()
        assert sorted(((r["doc_id"], r["text"], r["n_words"], r["n_hit"], r["items"]) for r in rows), key=str) == sorted((judge(i, t) for i, t in extra), key=str)
        for r in rows:
            if len(r["text"] or "") < 2000:
                assert [m["match_length"] for m in r["matches"]] == match_lengths(r["text"]), r["doc_id"]
    longest = find_contamination(frame, table).where("doc_id = 901").first()["matches"]
    assert [(m["start"], m["length"], m["item_ids"], m["item_start"], m["doc_start"], m["match_length"]) for m in longest] == [(0, 17, ["10"], 3, 0, 17), (18, 22, ["10"], 18, 18, 22)]
    assert find_contamination(docs, table.where("false")).where("size(matches) > 0").count() == 0
    assert find_contamination(empty, table).count() == 0
    clash = spark.createDataFrame([(1, "clean", -7, "x", 3), (2, BASE, -7, "x", 3)], "doc_id int, text string, n_words int, `a.b` string, Items int")
    kept = decontaminate(clash, table)
    assert kept.columns == clash.columns and [tuple(r) for r in kept.collect()] == [(1, "clean", -7, "x", 3)]


def test_repeated_words_are_no_pairs():
    """100,000 equal words against an item of 2000: memory in the order of the words, not of their pairs."""
    block = Block([("a", "w " * 2000), ("b", "w " * 30), ("c", "v w")], 10)
    h, at = word_hashes(pa.array(["w " * 100_000, "w " * 9, "w " * 50 + "u " + "v w"]), MARKS)
    tracemalloc.start()
    found = Found(len(h))
    found.add(block, h, at)
    items, matches = found.columns(at)
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
    assert items.to_pylist() == [["a", "b"], [], ["a", "b", "c"]]
    got = [[(m["start"], m["length"], m["item_ids"], m["match_length"]) for m in d] for d in matches.to_pylist()]
    assert got == [[(0, 100_000, ["a"], 2000)], [], [(0, 50, ["a"], 50), (51, 2, ["c"], 2)]]


def test_suffix_arrays_are_in_order():
    rng = np.random.default_rng(8)
    w = rng.integers(0, 4, 400)
    s = Sequence(w)
    places = np.flatnonzero(s.words)
    key = lambda p: s.words[p : s.end[p]].tolist()
    assert [key(p) for p in suffix_array(s, places)] == sorted(key(p) for p in places)
    i, j = rng.choice(places, 200), rng.choice(places, 200)
    want = [next((k for k, (x, y) in enumerate(zip(key(a), key(b))) if x != y), min(len(key(a)), len(key(b)))) for a, b in zip(i, j)]
    assert common(s, i, s, j).tolist() == want


# 10


def test_preference_pairs(spark):
    a = [("user", "hi"), ("assistant", "yes"), ("user", "more"), ("assistant", "A")]
    b = [("user", "hi"), ("assistant", "yes"), ("user", "more"), ("assistant", "B!"), ("user", None)]
    rows = [(1, True, k, r, t, 0) for k, (r, t) in enumerate(a)] + [(1, False, k, r, t, 0) for k, (r, t) in enumerate(b)]
    rows += [(2, True, 0, "user", "only", 0), (3, True, 0, "user", "same", 0), (3, False, 0, "user", "same", 0), (None, True, None, None, None, 0), (None, False, 1, "assistant", "no pair", 0), (4, None, 0, "user", "lost", 0), (5, True, 0, "a", "x", 0), (5, True, 0, "a", "x", 0), (5, False, 0, "b", "x", 0)]
    frame = spark.createDataFrame(rows, "pair_id long, chosen boolean, turn long, role string, text string, prompt int")
    render = lambda turns: "".join(f"<|im_start|>{r}\n{t or ''}<|im_end|>\n" for r, t in turns)
    found = preference_pairs(frame).collect()
    got = {r["pair_id"]: r for r in found}
    assert len(found) == 6 and {(r["chosen"], r["rejected"]) for r in found if r["pair_id"] is None} == {(render([("", "")]), None), (None, render([("assistant", "no pair")]))}
    assert set(got) == {1, 2, 3, 5, None}
    one = got[1]
    assert (one["n_common"], one["prompt"], one["chosen"], one["rejected"]) == (3, render(a[:3]), render(a[3:]), render(b[3:]))
    assert [one["chosen"][s["begin"] : s["end"]] for s in one["chosen_spans"]] == ["A<|im_end|>"]
    assert [one["rejected"][s["begin"] : s["end"]] for s in one["rejected_spans"]] == ["B!<|im_end|>"]
    assert (got[2]["n_common"], got[2]["prompt"], got[2]["rejected"], got[2]["rejected_spans"]) == (0, "", None, None)
    assert (got[3]["n_common"], got[3]["chosen"], got[3]["rejected"]) == (1, "", "")
    assert got[5]["chosen"] == render([("a", "x")] * 2)
    assert preference_pairs(frame.where("false")).count() == 0


def test_swapped_replies(spark):
    said = {
        4: [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d"), ("user", "e")],
        5: [("user", "p"), ("assistant", "q")],
        6: [("user", "no neighbour"), ("assistant", "z")],
        9: [("user", "no reply")],
        -3: [("assistant", "x")],
        -4: [("user", "y")],
    }
    rows = [(c, k, r, t) for c, turns in said.items() for k, (r, t) in enumerate(turns)] + [(None, 0, "assistant", "n"), (None, 0, "user", None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(3)
    sides = swapped_replies(frame)
    got = {r["pair_id"]: ([tuple(t) for t in r["c"]], [tuple(t) for t in r["r"]]) for r in sides.where("pair_id is not null").collect()}
    assert got == {4: (said[4], said[4][:3] + [("assistant", "q")]), 5: (said[5], [("user", "p"), ("assistant", "d")]), 6: (said[6], said[6][:1]), 9: (said[9], said[9]), -3: (said[-3], []), -4: (said[-4], said[-4] + [("assistant", "x")])}
    assert sorted(len(r["c"]) for r in sides.where("pair_id is null").collect()) == [1, 1]
    assert {r["pair_id"]: r["n_common"] for r in format_pairs(sides).where("pair_id is not null").collect()} == {4: 3, 5: 1, 6: 1, 9: 1, -3: 0, -4: 1}
    assert swapped_replies(frame.where("false")).count() == 0


# the pipeline


def test_pipeline_stages(spark, tmp_path):
    bench = [(1, " ".join(text(77, 40).split()[:30]))]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    prose = lambda s: "the " + text(s, 60) + " and that is all"
    rows = [(i, prose(i), "en", "s", 1) for i in range(10, 20)] + [(30, near(prose(10), 3), "en", "s", 1), (31, prose(11), "en", "s", 1), (40, prose(90) + " " + bench[0][1], "en", "s", 1), (50, "short", "en", "s", 1), (51, None, "en", "s", 1), (52, "a b " * 300, "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    current, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns = current.columns
        current = stage(spark, current, str(tmp_path))
        assert current.columns == columns
        kept.append({r["doc_id"] for r in current.collect()})
    clean = set(range(10, 20))
    assert kept == [clean | {30, 31, 40}, clean | {40}, clean]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    check_packing([(r[0], r[1]) for r in rows if r[0] in clean], out, packing.Limits())


def test_stages_on_awkward_rows(spark, tmp_path):
    """Null ids and texts, repeated rows, columns named like the operators' own, empty tables."""
    spark.createDataFrame([(1, BASE)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    good = lambda s: "the " + text(s, 60) + " and that is all"
    rows = [(1, good(1), -7, "x"), (1, good(1), -8, "y"), (None, good(2), -7, "x"), (None, None, -7, "x"), (2, good(3), -7, None), (2, good(4), -7, "x"), (3, "the " + BASE + " and that is", -7, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words long, matches string").repartition(2)
    sizes = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0
        docs = stage(spark, docs, str(tmp_path))
        got = docs.collect()
        sizes.append(len(got))
        assert docs.columns == ["doc_id", "text", "n_words", "matches"] and all(r["n_words"] in (-7, -8) for r in got)
    assert sizes == [6, 5, 4]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert len(pieces) == 4 and corpus_pipeline.STAGES[-1][1](spark, docs.where("false"), str(tmp_path)).count() == 0


def test_stages_keep_awkward_rows_apart(spark, tmp_path):
    """As above, with no text that is the benchmark's own: two rows of one id and text are one, texts of one id two."""
    spark.createDataFrame([(1, BASE)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    good = lambda s: "the " + text(s, 60) + " and that is all"
    rows = [(1, good(11), -7, "x"), (1, good(11), -8, "y"), (None, good(12), -7, "x"), (None, None, -7, "x"), (2, good(13), -7, None), (2, good(14), -7, "x"), (3, "the " + BASE + " and that is", -7, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words long, matches string").repartition(2)
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        kept.append(sorted((r["doc_id"] or 0, r["text"]) for r in docs.collect()))
    two, clean = (1, good(11)), [(0, good(12)), (1, good(11)), (2, good(13)), (2, good(14))]
    assert kept == [sorted([*clean, two, (3, rows[-1][1])]), sorted([*clean, (3, rows[-1][1])]), sorted(clean)]

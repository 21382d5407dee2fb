"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table.

A query derives the columns of its contract from the operator's real output. ``oracle_sql`` has the same in
DuckDB's SQL where SQL can express the operator; the others are tested against brute force in ``tests/llm``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table
from .chat import format_pairs, swapped_replies
from .decontaminate import find_contamination, hit_words
from .jaccard import similarity_classes
from .lm import score_documents
from .packing import Limits, pack_documents
from .quality import RULES, STOP_WORDS, quality
from .sharding import shard
from .token_counts import token_counts
from .url_filters import url_filter
from .warc import archive_round_trip

#: Host, path and action of the rules that op2 judges by.
URL_RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)


def op1_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents").select("doc_id", "text"), 8)
    crc = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    return out.select("doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id", "n_links")


#: Context limits and quantiles that op4 answers beside the lengths that occur.
CONTEXT_LIMITS = tuple(1 << k for k in range(5, 21))
SHARES = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999, 1.0)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents").select("text"), limits=CONTEXT_LIMITS, shares=SHARES)


#: op5: a text's first line is its prompt, if others follow; sequences hold at most so many segments and loss-bearing tokens.
PACKING = Limits(tokens=1024, segments=8, loss_tokens=1008)


def op5_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    prompt = F.when(F.instr("text", "\n") > 0, F.octet_length(F.substring_index("text", "\n", 1)) + 1)
    out = pack_documents(docs, PACKING, prompt_bytes=prompt)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss_tokens")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed", ",").alias("failed"))


def op7_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return archive_round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    out = find_contamination(docs, benchmark).select("doc_id", "n_words", hit_words(F.col("matches")).alias("n_hit"), "items")
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation is chosen; rejected is the same with the neighbour's last reply in place of its own."""
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["begin"].cast("string"), s["end"].cast("string"))), " ")
    out = format_pairs(swapped_replies(table(spark, sf_dir, "conversations")))
    return out.select("pair_id", F.col("n_common").cast("long").alias("n_common"), "prompt", "chosen", "rejected", spans(F.col("chosen_spans")).alias("chosen_spans"), spans(F.col("rejected_spans")).alias("rejected_spans"))


_OP2_SQL = """
with cut as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
parts as (select page_id, regexp_extract(rest, '^([^/?#]*)', 1) as raw, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut),
urls as (select page_id, coalesce(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host, coalesce(path, '') as path from parts),
rules(rhost, rpath, action) as (values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
judged as (select u.*, (select max(struct_pack(n := length(rhost) + length(rpath), rule := concat(rhost, rpath), action := action))
  from rules where (host = rhost or ends_with(host, concat('.', rhost))) and starts_with(path, rpath)) as best from urls u)
select page_id, host, path, best.rule as rule, coalesce(best.action, 'allow') as verdict from judged
"""

_OP10_SQL = """
with turns as (select conv_id, case when conv_id is null then row_number() over () else 0 end as own,
    struct_pack(turn := turn, role := coalesce(role, ''), text := coalesce(text, '')) as t from conversations),
ordered as (select conv_id, list_transform(ts, lambda x: struct_pack(role := x.role, text := x.text)) as c from (select conv_id, own, list(t order by t) as ts from turns group by conv_id, own)),
replies as (select *, list_max(list_filter(range(1, len(c) + 1), lambda i: c[i].role = 'assistant')) as at from ordered),
sides as (select m.conv_id as pair_id, m.c, case when m.at is null then m.c else m.c[1:m.at - 1] end || case when o.at is null then [] else [o.c[o.at]] end as r
  from replies m left join replies o on o.conv_id = case when m.conv_id % 2 = 0 then m.conv_id + 1 else m.conv_id - 1 end),
cut as (select *, (select count(*) from (select unnest(range(1, least(len(c), len(r)) + 1)) as i) where c[1:i] = r[1:i]) as n from sides),
rest as (select *, list_transform(c, lambda t: concat('<|im_start|>', t.role, chr(10), t.text, '<|im_end|>', chr(10))) as cs,
  list_transform(r, lambda t: concat('<|im_start|>', t.role, chr(10), t.text, '<|im_end|>', chr(10))) as rs from cut),
spans as (select *, list_transform(range(n + 1, len(c) + 1), lambda i: struct_pack(b := length(array_to_string(cs[n + 1:i - 1], '')), t := c[i])) as cb,
  list_transform(range(n + 1, len(r) + 1), lambda i: struct_pack(b := length(array_to_string(rs[n + 1:i - 1], '')), t := r[i])) as rb from rest)
select pair_id, n as n_common, coalesce(array_to_string(cs[1:n], ''), '') as prompt,
  case when len(c) > 0 then coalesce(array_to_string(cs[n + 1:], ''), '') end as chosen,
  case when len(r) > 0 then coalesce(array_to_string(rs[n + 1:], ''), '') end as rejected,
  case when len(c) > 0 then coalesce(array_to_string(list_transform(list_filter(cb, lambda x: x.t.role = 'assistant'), lambda x: concat(x.b + length(x.t.role) + 13, '-', x.b + length(x.t.role) + 13 + length(x.t.text) + 10)), ' '), '') end as chosen_spans,
  case when len(r) > 0 then coalesce(array_to_string(list_transform(list_filter(rb, lambda x: x.t.role = 'assistant'), lambda x: concat(x.b + length(x.t.role) + 13, '-', x.b + length(x.t.role) + 13 + length(x.t.text) + 10)), ' '), '') end as rejected_spans
from spans
"""

_OP8_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html)::bigint as payload_bytes, sha256(html) as payload_digest from p),
f as (select *, case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest) else page_id end as first_id from d)
select page_id, payload_bytes, payload_digest, case when page_id = first_id then 'response' else 'revisit' end as record_type,
  case when page_id <> first_id then first_id end as refers_to from f
"""

_OP9_SQL = """
with dw as (select doc_id, row_number() over () as r, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) as w from documents),
iw as (select item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) as w from benchmark),
wins as (select distinct item_id, least(len(w), 10) as n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as win
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from iw where len(w) > 0)),
places as (select r, n, i, array_to_string(w[i:i + n - 1], ' ') as win
  from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from dw cross join (select distinct n from wins) where len(w) >= n)),
hits as (select r, i, wins.n, item_id from places join wins on places.win = wins.win and places.n = wins.n),
words as (select r, count(distinct k) as n_hit from (select r, unnest(range(i, i + n)) as k from (select distinct r, i, n from hits)) group by r),
items as (select r, count(*) as n_items, sha256(string_agg(item_id, ',' order by item_id)) as s from (select distinct r, item_id::varchar as item_id from hits) group by r)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, coalesce(s, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join words using (r) left join items using (r)
"""

_SPACE = "\\x20\\x09-\\x0D"


def _op6_sql() -> str:
    def fails(rule) -> str:
        ratio = rule.top if rule.bottom is None else f"{rule.top} / greatest({rule.bottom}, 1)"
        bounds = [f"{ratio} < {rule.low}"] * (rule.low is not None) + [f"{ratio} > {rule.high}"] * (rule.high is not None)
        return f"case when ({' or '.join(bounds)}) and n_words >= {rule.least_words} then '{rule.name}' end"

    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    return f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^{_SPACE}]+') as w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{_SPACE}]')) as lines from d),
windows as (select r, i, array_to_string(w[i:i + 4], ' ') as k from (select r, w, unnest(range(1, len(w) - 3)) as i from w where len(w) >= 5)),
often as (select r, i, count(*) over (partition by r, k) as n from windows),
covered as (select r, count(distinct p) as n from (select r, unnest(range(i, i + 5)) as p from often where n > 1) group by r),
m as (select doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols, len(lines) as n_lines,
  len(lines) - len(list_distinct(lines)) as n_dup_lines, len(list_filter(lines, lambda x: regexp_matches(x, '^[{_SPACE}]*[-*•]'))) as n_bullet_lines,
  len(list_filter(lines, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[{_SPACE}]*$'))) as n_ellipsis_lines, len(list_filter([{stops}], lambda x: list_contains(w, x))) as n_stop_words,
  len(regexp_extract_all(text, '\\p{{Lu}}')) as n_capitals, coalesce(n, 0) as n_repeat_words from w left join covered using (r)),
f as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed, coalesce(array_to_string(list_filter([{', '.join(map(fails, RULES))}], lambda x: x is not null), ','), '') as failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and failed = '' as kept, failed from f
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_histogram_sort": op1_histogram_sort,
        "op2_url_filters": op2_url_filters,
        "op3_jaccard_join": op3_jaccard_join,
        "op4_token_counts": op4_token_counts,
        "op5_vector_packing": op5_vector_packing,
        "op6_quality_rules": op6_quality_rules,
        "op7_attention_lm": op7_attention_lm,
        "op8_warc": op8_warc,
        "op9_suffix_arrays": op9_suffix_arrays,
        "op10_chat_formatting": op10_chat_formatting,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filters": _OP2_SQL, "op6_quality_rules": _op6_sql(), "op8_warc": _OP8_SQL, "op9_suffix_arrays": _OP9_SQL, "op10_chat_formatting": _OP10_SQL}

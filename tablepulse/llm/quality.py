"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Counts are taken from whole texts by built-in functions; each row of ``RULES`` becomes one comparison of
a count or ratio with its bounds. The plan is a scan and projections: nothing is shuffled, and a text is
judged wherever it lies, so copies and hot sources cost nothing extra.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import without

#: As in a character class of a regular expression.
SPACES = "\\x20\\x09-\\x0D"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Words of a text whose window positions fit beside a hash in one 64-bit number.
PACKED_WORDS = 1 << 20
_POSITION = (1 << 20) - 1
#: Common function words of English, German, French and Spanish.
STOP_WORDS = (
    "the a an and of to in is was for on that with this at by as are it he or from which we you they be not have "
    "der die das und ist nicht ein eine zu den von mit auf im des sich dem als für es "
    "le la les et un une des est de en que qui dans pour pas sur au par ce plus il "
    "el los las y una por con del se su para como más al lo es no si"
).split()


@dataclass(frozen=True)
class Rule:
    """A text passes if ``low <= top / bottom <= high``, for texts of ``least_words`` and more."""

    name: str
    top: str
    bottom: str | None = None
    low: float | None = None
    high: float | None = None
    least_words: int = 0


#: The threshold table. Bounds follow published heuristics for web text, widened where a short text
#: would fail them by chance.
RULES = (
    Rule("too_long", "n_words", high=2_000_000),
    Rule("word_length", "word_chars", "n_words", low=2, high=14, least_words=10),
    Rule("symbols", "n_symbols", "n_words", high=0.1, least_words=10),
    Rule("stop_words", "n_stop_words", low=1, least_words=80),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=0.5, least_words=10),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", high=0.9, least_words=10),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", high=0.3, least_words=10),
    Rule("capitals", "n_capitals", "word_chars", high=0.4, least_words=10),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_bullet_lines", "n_ellipsis_lines", "n_stop_words", "n_capitals", "n_repeat_words")


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _words(text: Column) -> Column:
    """Runs of other characters than white space. Splitting at one plain character avoids a regular expression."""
    for c in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def _window_starts(words: Column, n: Column) -> Column:
    return F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>"))


def _same(words: Column, i: Column, j: Column) -> Column:
    """Whether the windows at ``i`` and ``j`` hold the same words."""
    out = F.get(words, i) == F.get(words, j)
    for k in range(1, WINDOW):
        out = out & (F.get(words, i + k) == F.get(words, j + k))
    return out


def _covered(starts: Column) -> Column:
    """Words inside any of the windows at these sorted starts."""
    return F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, s: F.struct((a["n"] + s + WINDOW - F.greatest(s, a["end"])).alias("n"), (s + WINDOW).alias("end")),
        lambda a: a["n"].cast("long"),
    )


def _hash(words: Column, i: Column) -> Column:
    return F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW)))


def _equals(words: Column, keys: Column, alike, place) -> Column:
    """Of windows sorted by hash: those with the same words as another one. Where a neighbour has the same hash
    but other words (a collision), all of that hash are compared."""
    same = lambda x, y: _same(words, place(x), place(y))

    def hit(x: Column, k: Column) -> Column:
        after, before = F.get(keys, k + 1), F.get(keys, k - 1)
        near = (after.isNotNull() & alike(x, after)) | (before.isNotNull() & alike(x, before))
        beside = (after.isNotNull() & alike(x, after) & same(x, after)) | (before.isNotNull() & alike(x, before) & same(x, before))
        return near & (beside | F.exists(keys, lambda y: alike(x, y) & (place(x) != place(y)) & same(x, y)))

    return F.filter(keys, hit)


def _repeated(words: Column) -> Column:
    """Words in windows that are found twice or more.

    Window hashes share a 64-bit number with their positions, so one sort of plain numbers brings equal
    windows together; windows of equal hash are then compared word by word. Texts too long for that
    sort pairs of a full hash and a position.
    """

    def packed(w: Column) -> Column:
        keys = F.sort_array(F.transform(_window_starts(w, F.size(w)), lambda i: _hash(w, i).bitwiseAND(F.lit(~_POSITION)).bitwiseOR(i.cast("long"))))

        def found(s: Column) -> Column:
            place = lambda x: x.bitwiseAND(F.lit(_POSITION)).cast("int")
            hits = _equals(w, s, lambda x, y: F.shiftright(x.bitwiseXOR(y), 20) == 0, place)
            return _covered(F.sort_array(F.transform(hits, place)))

        return _let(keys, found)

    def full(w: Column) -> Column:
        keys = F.sort_array(F.transform(_window_starts(w, F.size(w)), lambda i: F.struct(_hash(w, i).alias("h"), i.alias("i"))))

        def found(s: Column) -> Column:
            hits = _equals(w, s, lambda x, y: x["h"] == y["h"], lambda x: x["i"])
            return _covered(F.sort_array(F.transform(hits, lambda x: x["i"])))

        return _let(keys, found)

    return F.when(F.size(words) < WINDOW + 1, F.lit(0).cast("long")).when(F.size(words) < PACKED_WORDS, packed(words)).otherwise(full(words))


def measures(text: Column) -> Column:
    """A struct of the counts that rules compare. Null text: as an empty one."""
    text = F.coalesce(text, F.lit(""))
    words = _words(text)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACES}]"))
    stops = F.array(*map(F.lit, STOP_WORDS))

    def counts(w: Column, v: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
            F.size(v).cast("long").alias("n_lines"),
            (F.size(v) - F.size(F.array_distinct(v))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(v, lambda x: x.rlike(f"^[{SPACES}]*[-*•]"))).cast("long").alias("n_bullet_lines"),
            F.size(F.filter(v, lambda x: x.rlike(f"(\\.\\.\\.|…)[{SPACES}]*$"))).cast("long").alias("n_ellipsis_lines"),
            F.size(F.array_intersect(w, stops)).cast("long").alias("n_stop_words"),
            F.regexp_count(text, F.lit("\\p{Lu}")).cast("long").alias("n_capitals"),
            _repeated(w).alias("n_repeat_words"),
        )

    return _let(words, lambda w: _let(lines, lambda v: counts(w, v)))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


def compile_rules(rules, column) -> Column:
    """Names of the rules that a text fails, as one expression over its counts."""
    failed = []
    for rule in rules:
        ratio = column(rule.top) if rule.bottom is None else column(rule.top) / F.greatest(column(rule.bottom), F.lit(1))
        bad = F.lit(False)
        if rule.low is not None:
            bad = bad | (ratio < rule.low)
        if rule.high is not None:
            bad = bad | (ratio > rule.high)
        failed.append(F.when(bad & (column("n_words") >= rule.least_words), F.lit(rule.name)))
    return F.array_compact(F.array(*failed))


def _verdict(m: Column, rules) -> Column:
    """The counts and what follows from them, as one value: a filter on ``kept`` then works them out once."""
    failed, base = compile_rules(rules, lambda c: m[c]), base_failed(m["n_words"], m["n_repeat_words"])
    return _let(failed, lambda f: F.struct(*(m[c].alias(c) for c in COUNTS), base.alias("base_failed"), f.alias("failed"), (~base & (F.size(f) == 0)).alias("kept")))


def quality(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """Each row of ``docs`` with its counts, ``base_failed``, ``failed`` (names of rules) and ``kept``.

    Null and empty texts have no words: they fail the base rule, and are not kept. Repeated rows are judged
    each for itself. An empty table gives an empty result. Input columns named like a result's are replaced.
    """
    own = ("base_failed", "failed", "kept", *COUNTS)
    keep = without(docs.withColumn("__text", F.col(text)), *(c for c in own if c != text))
    out = keep.withColumn("__q", _let(measures(F.col("__text")), lambda m: _verdict(m, rules))).drop("__text")
    return out.withColumns({c: F.col("__q")[c] for c in (*COUNTS, "base_failed", "failed", "kept")}).drop("__q")

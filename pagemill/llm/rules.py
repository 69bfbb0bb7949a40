"""Quality rules as a short-circuit cascade of Catalyst expressions.

Each rule rejects a document by a condition on its text alone.  The cascade
measures every rule on a bounded sample: how long it takes and which share it
rejects, and evaluates rules in descending rejection per cost, so that costly
rules see only what the cheap ones let through.  Order changes the time, never
the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import materialise, words

#: Documents on which cost and selectivity are measured, at most.  Only the order depends on them.
SAMPLE_ROWS = 1_000

# Fixed values of the rules.
MIN_WORDS = 20
WINDOW_WORDS = 8
MAX_REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"
MAX_SYMBOLS_PER_100_WORDS = 30
MAX_DUP_LINE_PERCENT = 50
MAX_ECHO_PERCENT = 40
MAX_UPPER_PERCENT = 50


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it.

    The binding is a lambda variable, so no optimizer rule can copy the value
    into the places of its use.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


# -- measures ---------------------------------------------------------------
def text_of(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def word_chars(w: Column) -> Column:
    """Code points in words."""
    return F.length(F.array_join(w, "")).cast("long")


def symbol_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text_of(text), f"[^{SYMBOLS}]+", "")).cast("long")


def word_lines(text: Column) -> Column:
    r"""Lines between ``\n`` that hold a word."""
    return F.filter(F.split(text_of(text), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def dup_lines(lines: Column) -> Column:
    """Lines that equal an earlier line."""
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def echo_words(w: Column) -> Column:
    """Words that equal the word before them."""
    pairs = F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: a == b)
    return F.size(F.filter(pairs, lambda x: x)).cast("long")


def upper_share(text: Column) -> Column:
    """(upper-case letters, letters) of a text."""
    t = text_of(text)
    return F.struct(F.length(F.regexp_replace(t, r"\P{Lu}+", "")).cast("long").alias("upper"),
                    F.length(F.regexp_replace(t, r"\P{L}+", "")).cast("long").alias("letters"))


def window_hashes(w: Column) -> Column:
    """A 64-bit hash of every window of eight words, in order.

    Hashes of one word are joined to those of two, four and eight words.
    """
    def joined(h: Column, by: int) -> Column:
        return let(h, lambda x: F.zip_with(x, F.slice(x, by + 1, F.greatest(F.size(x), F.lit(1))), lambda a, b: F.xxhash64(a, b)))

    one = F.transform(w, lambda x: F.xxhash64(x))
    eight = joined(joined(joined(one, 1), 2), 4)
    return F.slice(eight, 1, F.greatest(F.size(w) - (WINDOW_WORDS - 1), F.lit(0)))


def _covered(h: Column) -> Column:
    """Words inside windows whose hash occurs twice or more.

    A window repeats if a neighbour in the order of (hash, place) has its hash.
    The places that repeat cover eight words each, less what the next one covers.
    """
    def places(s: Column) -> Column:
        both = F.arrays_zip(s.alias("at"), F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), s).alias("before"),
                            F.slice(s, 2, F.greatest(F.size(s), F.lit(1))).alias("after"))
        hit = F.filter(both, lambda z: F.coalesce(z["at"]["h"] == z["before"]["h"], F.lit(False))
                       | F.coalesce(z["at"]["h"] == z["after"]["h"], F.lit(False)))
        return F.array_sort(F.transform(hit, lambda z: z["at"]["i"]))

    def cover(p: Column) -> Column:
        steps = F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))),
                           lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW_WORDS)), F.lit(WINDOW_WORDS)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)

    by_hash = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return let(let(by_hash, places), cover)


def repeat_words(w: Column) -> Column:
    """Words in eight-word windows found twice or more in the text, the first included."""
    none = F.lit(0).cast("long")
    return F.when(F.size(w) <= WINDOW_WORDS, none).otherwise(
        let(window_hashes(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(_covered(h))))


# -- rules --------------------------------------------------------------------
@dataclass(frozen=True)
class Rule:
    """Rejects a text where ``rejects`` is true; ``base`` rules are part of ``base_failed``."""

    name: str
    rejects: Callable[[Column], Column]
    base: bool = False


def _with_words(test: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda text: let(words(text), test)


RULES = (
    Rule("few_words", _with_words(lambda w: F.size(w) < MIN_WORDS), base=True),
    Rule("repeats", _with_words(lambda w: repeat_words(w) * 100 > F.size(w) * MAX_REPEAT_PERCENT), base=True),
    Rule("symbols", lambda t: symbol_count(t) * 100 > F.size(words(t)) * MAX_SYMBOLS_PER_100_WORDS),
    Rule("dup_lines", lambda t: let(word_lines(t), lambda x: dup_lines(x) * 100 > F.size(x) * MAX_DUP_LINE_PERCENT)),
    Rule("echo", _with_words(lambda w: echo_words(w) * 100 > F.size(w) * MAX_ECHO_PERCENT)),
    Rule("shouting", lambda t: let(upper_share(t), lambda u: u["upper"] * 100 > u["letters"] * MAX_UPPER_PERCENT)),
)


def cascade_order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules in descending rejections per second, as measured on up to ``sample_rows`` documents."""
    # One row in so many, by hash: about sample_rows of them from all over the table, and no more than that.
    one_in = max(1, docs.count() // sample_rows)
    picked = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(one_in)) == 0)
    sample = materialise(picked.select(F.col("text").cast("string").alias("text")).limit(sample_rows), "rule_sample")
    sample.agg(F.sum(F.length("text"))).collect()
    rates = {}
    for rule in rules:
        began = time.perf_counter()
        rejected = sample.agg(F.count_if(rule.rejects(F.col("text")))).first()[0]
        rates[rule.name] = rejected / max(time.perf_counter() - began, 1e-6)
    return sorted(rules, key=lambda r: (-rates[r.name], r.name))


def passes(text: Column, order: list[Rule]) -> Column:
    """True if no rule rejects; a rule is evaluated only if all before it accept."""
    verdict = F.when(order[0].rejects(text), F.lit(False))
    for rule in order[1:]:
        verdict = verdict.when(rule.rejects(text), F.lit(False))
    return verdict.otherwise(F.lit(True))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass every rule, unchanged.  Null and empty texts have too few words."""
    return docs.where(passes(F.col("text"), cascade_order(docs)))


def measure(docs: DataFrame) -> DataFrame:
    """Counts and verdict of every document: doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed and kept.

    Null and empty texts have no words and fail.  Other columns of ``docs`` are ignored,
    repeated rows are judged each.
    """
    text = F.col("text")
    order = [r for r in cascade_order(docs) if not r.base]
    counted = docs.select("doc_id", "text", let(words(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), word_chars(w).alias("word_chars"),
        repeat_words(w).alias("n_repeat_words"))).alias("m"))
    failed = (F.col("m.n_words") < MIN_WORDS) | (F.col("m.n_repeat_words") * 100 > F.col("m.n_words") * MAX_REPEAT_PERCENT)
    return counted.select(
        "doc_id", "m.n_words", "m.word_chars", symbol_count(text).alias("n_symbols"),
        let(word_lines(text), dup_lines).alias("n_dup_lines"), "m.n_repeat_words",
        failed.alias("base_failed"), F.when(failed, F.lit(False)).otherwise(passes(text, order)).alias("kept"))

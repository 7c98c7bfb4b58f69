"""Quality rules: a threshold table compiled into one projection.

Everything is built-in array and string functions, so a row is judged where it
is read, without a shuffle or a user function.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import bind
from codeloom.llm.common import SPACE, unused

SYMBOLS = "#*$%&|<>"

# Common function words of four languages.
STOP_WORDS = {
    "en": "the of and to in is that it was for on are as with be this by from or an at not a",
    "fr": "le la les de des du et un une en que qui dans pour par sur au est pas ne plus ce elle",
    "de": "der die das den dem des und in von zu mit sich auf ist im nicht ein eine als auch es",
    "es": "el la los las de del que y en un una se por con no para su al lo como es o",
}


@dataclass(frozen=True)
class Rule:
    """``low <= ratio <= high``, for texts of ``langs`` (None: of any language).

    A share of few words says little, so a rule may begin at ``min_words``.
    """

    ratio: str
    low: float | None = None
    high: float | None = None
    langs: tuple[str, ...] | None = None
    min_words: int = 0


RULES = (
    Rule("mean_word_length", 2.0, 16.0),
    Rule("symbols_per_word", None, 0.2),
    Rule("stop_word_share", 0.02, None, tuple(STOP_WORDS), min_words=40),
    Rule("duplicate_line_share", None, 0.5),
    Rule("ellipsis_line_share", None, 0.5),
    Rule("bullet_line_share", None, 0.9),
)


BASE_WORDS, BASE_REPEATED_PERCENT = 10, 20
WINDOW = 5

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
    "n_stop_words", "n_ellipsis_lines", "n_bullet_lines",
)


def _words(text: Column) -> Column:
    plain = F.translate(text, SPACE, " " * len(SPACE))
    return F.array_remove(F.split(plain, " "), "")


def _lines(text: Column) -> Column:
    """``\\n``-separated lines with a word."""
    return F.filter(F.split(text, "\n"), lambda line: F.length(F.btrim(line, F.lit(SPACE))) > 0)


def _repeated_words(words: Column) -> Column:
    """How many words stand in a window of five that the text has at least twice.

    Windows are compared by a 64-bit hash. Only a text with an equal pair sorts
    them; each place of an equal window covers five words, less what the next
    such place covers anyway.
    """
    hashes = F.transform(
        F.sequence(F.lit(0), F.size(words) - WINDOW),
        lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(WINDOW)]),
    )

    def places(in_order: Column) -> Column:
        def twice(w: Column, i: Column) -> Column:
            return (F.get(in_order, i - 1)["h"] == w["h"]) | (F.get(in_order, i + 1)["h"] == w["h"])

        return F.sort_array(
            F.transform(
                F.filter(in_order, lambda w, i: F.coalesce(twice(w, i), F.lit(False))),
                lambda w: w["i"],
            )
        )

    def covered(at: Column) -> Column:
        steps = F.transform(
            at, lambda p, i: F.least(F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW)), F.lit(WINDOW))
        )
        return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

    def count(found: Column) -> Column:
        numbered = F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        repeated = bind(F.sort_array(numbered), lambda o: bind(places(o), covered))
        return F.when(F.size(F.array_distinct(found)) < F.size(found), repeated).otherwise(0)

    return F.when(F.size(words) > WINDOW, bind(hashes, count)).otherwise(0)


def _stop_words(words: Column, lang: Column) -> Column:
    def found(listed: str) -> Column:
        return F.size(F.filter(words, lambda word: word.isin(*listed.split())))

    count = F.lit(0)
    for name, listed in STOP_WORDS.items():
        count = F.when(lang == name, found(listed)).otherwise(count)
    return count


def _counts(text: Column, lang: Column) -> Column:
    """All counts of a text in one struct, so that words and lines are cut once."""

    def of(words: Column, lines: Column) -> Column:
        counts = {
            "n_words": F.size(words),
            "word_chars": F.length(F.translate(text, SPACE, "")),
            "n_symbols": F.length(text) - F.length(F.translate(text, SYMBOLS, "")),
            "n_lines": F.size(lines),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_repeat_words": _repeated_words(words),
            "n_stop_words": _stop_words(words, lang),
            "n_ellipsis_lines": F.size(
                F.filter(lines, lambda x: F.endswith(x, F.lit("...")) | F.endswith(x, F.lit("…")))
            ),
            "n_bullet_lines": F.size(
                F.filter(lines, lambda x: F.ltrim(x).substr(1, 1).isin("-", "*", "•"))
            ),
        }
        return F.struct(*[counts[c].cast("long").alias(c) for c in COUNTS])

    return bind(_words(text), lambda words: bind(_lines(text), lambda lines: of(words, lines)))


def _ratios(counts: Column) -> dict[str, Column]:
    def share(part: str, whole: str) -> Column:
        return counts[part] / F.greatest(counts[whole], F.lit(1))

    return {
        "mean_word_length": share("word_chars", "n_words"),
        "symbols_per_word": share("n_symbols", "n_words"),
        "stop_word_share": share("n_stop_words", "n_words"),
        "duplicate_line_share": share("n_dup_lines", "n_lines"),
        "ellipsis_line_share": share("n_ellipsis_lines", "n_lines"),
        "bullet_line_share": share("n_bullet_lines", "n_lines"),
    }


def compiled(
    rules: Sequence[Rule], ratios: dict[str, Column], n_words: Column, lang: Column
) -> Column:
    """Names of the rules a text breaks, as one array expression."""
    broken = []
    for rule in rules:
        value = ratios[rule.ratio]
        fails = F.lit(False)
        if rule.low is not None:
            fails = fails | (value < rule.low)
        if rule.high is not None:
            fails = fails | (value > rule.high)
        if rule.langs is not None:
            fails = fails & F.coalesce(lang.isin(*rule.langs), F.lit(False))
        if rule.min_words:
            fails = fails & (n_words >= rule.min_words)
        broken.append(F.when(fails, F.lit(rule.ratio)))
    return F.array_compact(F.array(*broken))


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, name: str = "quality") -> DataFrame:
    """All columns of ``docs`` and a struct ``name``.

    Its fields are the counts, the ratios, ``base_failed``, ``broken`` (names of
    rules) and ``kept``. A null or empty text has no words and fails the base
    test; a null or unknown ``lang`` is not held to the stop-word rule. Every
    row is judged by itself, so repeated rows and ties make no difference.
    """
    text, lang = F.coalesce(docs["text"].cast("string"), F.lit("")), docs["lang"].cast("string")

    def verdict(counts: Column) -> Column:
        ratios = _ratios(counts)
        failed = (counts["n_words"] < BASE_WORDS) | (
            100 * counts["n_repeat_words"] > BASE_REPEATED_PERCENT * counts["n_words"]
        )
        return bind(
            compiled(rules, ratios, counts["n_words"], lang),
            lambda broken: F.struct(
                *[counts[c].alias(c) for c in COUNTS],
                *[value.alias(name) for name, value in ratios.items()],
                failed.alias("base_failed"),
                broken.alias("broken"),
                (~failed & (F.size(broken) == 0)).alias("kept"),
            ),
        )

    return docs.withColumn(name, bind(_counts(text, lang), verdict))


def quality_report(docs: DataFrame) -> DataFrame:
    """Counts and verdict of every document; see :func:`judge`."""
    base = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["lang"], docs["text"])
    return judge(base).select("doc_id", "quality.*")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents no rule rejects, with their columns as they are, whatever their names."""
    name = unused(docs, "quality")
    return judge(docs, name=name).filter(F.col(name)["kept"]).select(*docs.columns)

"""How far the vocabulary of each source lies from that of other sources.

Words are counted by sorting pointers: a task marks where words start in its Arrow
buffers, orders these pointers by the words they point at with a multikey quicksort
(eight bytes at a time; only runs that are still equal and unfinished go on) and reads
occurrences, documents and sources off the runs of equal words. No word becomes an
object before its run is counted. Shares are exact integers throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import stage

SLICE = 8_000_000  # bytes of text whose pointers are sorted at a time
DEEP = 64  # bytes after which runs of equal words are compared whole
SHARD_ROWS = 200_000  # counts of one language compared in one task
SOURCES = 256  # sources of one language compared with as many at a time
_CELLS = 2_000_000

# A-Z become a-z, other letters and all bytes above ASCII stay, the rest separates words.
_LOWER = np.zeros(256, dtype=np.uint8)
_LOWER[0x41:0x5B] = np.arange(0x61, 0x7B)
_LOWER[0x61:0x7B] = np.arange(0x61, 0x7B)
_LOWER[0x80:] = np.arange(0x80, 0x100)
# Masks that keep the first 0 to 8 bytes of eight.
_HEAD = np.array([((1 << 8 * k) - 1) << 8 * (8 - k) for k in range(9)], dtype=np.uint64)


def multikey_sort(text: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
    """Order of the words at ``starts`` and, in that order, where a new word begins.

    ``text`` has eight bytes more than its words need. Equal words keep the
    order of their pointers.
    """
    eight = np.ndarray(len(text) - 7, dtype=">u8", buffer=text, strides=(1,))

    def load(which: np.ndarray, depth: int) -> np.ndarray:
        left = np.clip(lengths[which] - depth, 0, 8)
        at = np.minimum(starts[which] + depth, len(eight) - 1)
        return eight[at].astype(np.uint64) & _HEAD[left]

    keys = load(np.arange(len(starts)), 0)
    order = np.argsort(keys, kind="stable")
    first = _changes(keys[order])
    at, run = np.arange(len(order)), np.cumsum(first) - 1
    depth = 8
    while len(at):
        edges = np.flatnonzero(_changes(run))
        sizes = np.diff(np.append(edges, len(run)))
        unfinished = np.maximum.reduceat(lengths[order[at]], edges) > depth
        going = np.repeat(unfinished & (sizes > 1), sizes)
        at, run = at[going], run[going]
        if not len(at):
            break
        if depth >= DEEP:
            rest = [text[s + depth : s + n].tobytes() for s, n in zip(starts[order[at]], lengths[order[at]], strict=True)]
            turn = sorted(range(len(at)), key=lambda i: (run[i], rest[i]))
            new = np.array([i == 0 or rest[turn[i]] != rest[turn[i - 1]] for i in range(len(at))])
            order[at] = order[at][turn]
            first[at] |= new | _changes(run)
            break
        keys = load(order[at], depth)
        turn = np.lexsort((keys, run))
        order[at], keys = order[at][turn], keys[turn]
        new = _changes(keys) | _changes(run)
        first[at] |= new
        run, depth = np.cumsum(new) - 1, depth + 8
    return order, first


def _changes(values: np.ndarray) -> np.ndarray:
    new = np.ones(len(values), dtype=bool)
    new[1:] = values[1:] != values[:-1]
    return new


def _pointers(data: np.ndarray, offsets: np.ndarray):
    """Lower-cased bytes, and start and length of each word; no word spans two documents."""
    text = np.zeros(len(data) + 8, dtype=np.uint8)
    text[: len(data)] = _LOWER[data]
    word = np.zeros(len(data) + 2, dtype=bool)
    word[1:-1] = text[: len(data)] != 0
    begins, ends = word[1:] & ~word[:-1], word[:-1] & ~word[1:]
    inner = offsets[1:-1]
    begins[inner] |= word[inner + 1]
    ends[inner] |= word[inner]
    starts = np.flatnonzero(begins)
    return text, starts, np.flatnonzero(ends) - starts


def _gather(text: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    ends = np.cumsum(lengths)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(text[at].tobytes()))


def count_terms(data: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> pa.Table:
    """``group, term, n, docs`` of documents in ascending order of their group."""
    text, starts, lengths = _pointers(data, offsets)
    order, first = multikey_sort(text, starts, lengths)
    doc = np.searchsorted(offsets, starts, side="right")[order] - 1
    rows = np.flatnonzero(first | _changes(group[doc]))
    n = np.diff(np.append(rows, len(order)))
    docs = np.add.reduceat((first | _changes(doc)).astype(np.int64), rows) if len(rows) else n
    heads = order[rows]
    return pa.table(
        {"group": group[doc[rows]], "term": _gather(text, starts[heads], lengths[heads]), "n": n, "docs": docs}
    )


def _count_long(data: np.ndarray, group: int) -> pa.Table:
    """One document in pieces that end between words, counted as one document."""
    cuts, low = [0], 0
    while len(data) - low > SLICE:
        low += SLICE
        while low < len(data) and _LOWER[data[low]]:
            low += 1
        cuts.append(low)
    one = np.array([group])
    parts = [
        count_terms(data[a:b], np.array([0, b - a]), one).drop(["docs"])
        for a, b in zip(cuts, [*cuts[1:], len(data)], strict=True)
    ]
    summed = pa.concat_tables(parts).group_by(["group", "term"]).aggregate([("n", "sum")])
    summed = summed.rename_columns(["group", "term", "n"])
    return summed.append_column("docs", pa.array(np.ones(len(summed), dtype=np.int64)))


COUNTS = "lang string, source string, term string, n long, docs long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each slice, and one row without a term for each group met."""
    for batch in batches:
        if not batch.num_rows:
            continue
        langs, sources = (c.cast(pa.string()).dictionary_encode() for c in batch.columns[:2])
        code = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
        turn = np.argsort(code, kind="stable")
        code, texts = code[turn], batch.column(2).cast(pa.large_binary()).take(pa.array(turn))
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[: len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)

        def named(counts: pa.Table) -> list[pa.RecordBatch]:
            lang, source = np.divmod(counts["group"].to_numpy(), len(sources.dictionary))  # noqa: B023
            columns = {
                "lang": langs.dictionary.take(pa.array(lang)),  # noqa: B023
                "source": sources.dictionary.take(pa.array(source)),  # noqa: B023
                **{c: counts[c] for c in ("term", "n", "docs")},
            }
            return pa.table(columns).to_batches()

        met = np.unique(code)
        none = np.zeros(len(met), dtype=np.int64)
        yield from named(pa.table({"group": met, "term": pa.nulls(len(met), pa.string()), "n": none, "docs": none}))
        low = 0
        while low < len(texts):
            high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + SLICE, side="right")) - 1)
            held = data[offsets[low] : offsets[high]]
            if len(held) > SLICE:
                yield from named(_count_long(held, code[low]))
            else:
                yield from named(count_terms(held, offsets[low : high + 1] - offsets[low], code[low:high]))
            low = high


def share(count: Column, total: Column, terms: Column, smoothing: int) -> Column:
    """``1 + floor(10^9 * (count + smoothing) / (total + smoothing * terms))``, exactly.

    Long division by thousands, so 64 bits hold it up to 9 * 10^15 occurrences.
    """
    whole = total + smoothing * terms
    quotient, rest = F.lit(0).cast("long"), count + smoothing
    for _ in range(3):
        quotient = quotient * 1000 + F.call_function("div", rest * 1000, whole)
        rest = (rest * 1000) % whole
    return quotient + 1


DIFFERENCES = "lang string, a int, b int, value long"


def _differences(table: pa.Table) -> pa.Table:
    """Sums of ``|p - q|`` over the terms of one shard, for all sources of two blocks.

    Rows without a term hold a source's share of any term it lacks, and in the
    first shard how many terms the language has.
    """
    lang, shard, x, y = (table[c][0].as_py() for c in ("lang", "shard", "x", "y"))
    profile = pc.is_null(table["term"])
    basic, counts = table.filter(profile), table.filter(pc.invert(profile))
    number = basic["number"].to_numpy()
    known = np.argsort(number)
    number, base = number[known], basic["p"].to_numpy()[known]
    terms = counts["term"].combine_chunks().dictionary_encode()
    at = np.searchsorted(number, counts["number"].to_numpy())
    term, p = terms.indices.to_numpy(zero_copy_only=False), counts["p"].to_numpy()
    order = np.argsort(term, kind="stable")
    term, at, p = term[order], at[order], p[order]
    left, right = (np.flatnonzero(number // SOURCES == block) for block in (x, y))
    apart = np.abs(base[left][:, None] - base[right][None, :])
    total = apart * (basic["terms"][0].as_py() if shard == 0 else 0)
    step = max(1, _CELLS // len(number))
    for low in range(0, len(terms.dictionary), step):
        high = min(low + step, len(terms.dictionary))
        a, b = np.searchsorted(term, [low, high])
        dense = np.repeat(base[None, :], high - low, axis=0)
        dense[term[a:b] - low, at[a:b]] = p[a:b]
        others = dense[:, right]
        for i, column in enumerate(left):
            total[i] += np.abs(dense[:, column : column + 1] - others).sum(axis=0) - apart[i] * (high - low)
    a, b = np.repeat(number[left], len(right)), np.tile(number[right], len(left))
    value = total.ravel()
    if x != y:
        a, b, value = np.concatenate([a, b]), np.concatenate([b, a]), np.tile(value, 2)
    differ = a != b
    return pa.table(
        {
            "lang": pa.array([lang] * int(differ.sum()), pa.string()),
            "a": pa.array(a[differ], pa.int32()),
            "b": pa.array(b[differ], pa.int32()),
            "value": pa.array(value[differ], pa.int64()),
        }
    )


def _pairs(inside: DataFrame, groups: DataFrame, shards: int) -> DataFrame:
    """``lang, source, item, value`` for every two sources of a language."""
    by_name = Window.partitionBy("lang").orderBy("source")  # one row per source, never per document
    numbered = stage(groups.withColumn("number", F.row_number().over(by_name) - 1), "sources")
    size = numbered.groupBy("lang").agg(F.ceil(F.count("*") / SOURCES).alias("blocks"))
    block = F.floor(F.col("number") / SOURCES).cast("int")
    cells = F.transform(
        F.sequence(F.lit(0), F.col("blocks").cast("int") - 1),
        lambda o: F.struct(F.least(o, block).alias("x"), F.greatest(o, block).alias("y")),
    )
    counts = (
        inside.join(numbered.select("lang", "source", "number"), ["lang", "source"])
        .select("lang", "number", "term", "p", F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int").alias("shard"))
        .withColumn("terms", F.lit(None).cast("long"))
    )
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    profiles = numbered.select(
        "lang", "number", F.lit(None).cast("string").alias("term"), F.coalesce("base", F.lit(0)).alias("p"), everywhere, "terms"
    )
    rows = counts.unionByName(profiles).join(size, "lang").select("*", F.inline(cells))
    summed = (
        rows.groupBy("lang", "shard", "x", "y")
        .applyInArrow(_differences, DIFFERENCES)
        .groupBy("lang", "a", "b")
        .agg(F.sum("value").alias("value"))
    )
    name = lambda side, as_: numbered.select("lang", F.col("number").alias(side), F.col("source").alias(as_))
    return summed.join(name("a", "source"), ["lang", "a"]).join(name("b", "item"), ["lang", "b"]).select(
        "lang", "source", "item", "value"
    )


def source_divergence(docs: DataFrame, min_docs: int = 30, top: int = 50, smoothing: int = 5) -> DataFrame:
    """``lang, source, part, item, value, rank`` of every (lang, source) of ``docs``.

    A language keeps the terms that at least ``min_docs`` of its rows contain.
    Part ``pair``: the summed distance of term shares to each other source of
    the language. Part ``term``: the ``top`` terms whose share most exceeds the
    language's. Null text, lang or source count as ''; repeated rows count each;
    ties go by the bytes of the item. A language without kept terms has only
    ``pair`` rows of value 0, a language of one source none, an empty table no rows.
    """
    filled = [F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    counted = stage(
        docs.select(*filled)
        .mapInArrow(_count, COUNTS)
        .groupBy("lang", "source", "term")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")),
        "term-counts",
    )
    met = counted.filter("term IS NULL").select("lang", "source")
    kept = stage(
        counted.filter("term IS NOT NULL")
        .groupBy("lang", "term")
        .agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"))
        .filter(F.col("docs") >= min_docs)
        .drop("docs"),
        "kept-terms",
    )
    inside = stage(counted.drop("docs").join(kept, ["lang", "term"]), "kept-counts")
    by_lang = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    by_group = inside.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sized = met.join(by_group, ["lang", "source"], "left").join(by_lang, "lang", "left").fillna(0)
    known = F.col("terms") > 0
    base = F.when(known, share(F.lit(0).cast("long"), F.col("total"), F.col("terms"), smoothing))
    groups = stage(sized.withColumn("base", base), "groups")

    shares = inside.join(groups, ["lang", "source"]).select(
        "lang",
        "source",
        "term",
        share(F.col("n"), F.col("total"), F.col("terms"), smoothing).alias("p"),
        share(F.col("lang_n"), F.col("lang_total"), F.col("terms"), smoothing).alias("q"),
    )
    shards = 1 + inside.count() // SHARD_ROWS
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(ranked).alias("rank")
    terms = (
        shares.filter("p > q")
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
        .select("*", rank)
        .filter(F.col("rank") <= top)
    )
    pairs = _pairs(shares, groups, shards).select("lang", "source", F.lit("pair").alias("part"), "item", "value").select("*", rank)
    return pairs.unionByName(terms)

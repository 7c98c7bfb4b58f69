"""Source audit, token alignment and the byte network against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from codeloom.llm import alignment, quality_model, source_audit
from codeloom.llm.common import new_folder
from codeloom.llm.encoder import byte_letters
from codeloom.llm.queries import BYTE_BPE, PIECE_BPE, tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, term string, p long, links string"
A, B = tokenizer_path(BYTE_BPE), tokenizer_path(PIECE_BPE)
RNG = random.Random(11)
ODD = [
    None,
    "",
    " ",
    "a",
    "Ünï cødé ſ ﬁ x\x00y",
    "x▁y z",
    "it's <|endoftext|> here",
    "<s> </s> <unk>",
    "日本語 テスト 😀😀",
    "\n\n\t a  b ",
    "a" * 3000,
    *("".join(RNG.choice("ab c\né<>|😀▁ ") for _ in range(RNG.randint(1, 60))) for _ in range(60)),
]


def frame(spark, rows):
    """Rows of (doc_id, text, lang, source); the further columns clash with names used inside."""
    return spark.createDataFrame([(*row, None, "x", 7, "y") for row in rows], DOCS)


# --- source audit -----------------------------------------------------------


def audited(rows, min_docs, top=50):
    words, totals = defaultdict(Counter), defaultdict(Counter)
    docs, groups = defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        words[lang, source].update(found)
        totals[lang].update(found)
        docs[lang].update(set(found))
    out = set()
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]

        def shares(counts):
            whole = sum(counts[t] for t in kept) + 5 * len(kept)  # noqa: B023
            return {t: 1 + 10**9 * (counts[t] + 5) // whole for t in kept}  # noqa: B023

        own, average = shares(words[lang, source]), shares(totals[lang])
        others = {s: shares(words[lang, s]) for g, s in groups if g == lang and s != source}
        pair = [(-sum(abs(own[t] - q[t]) for t in kept), s.encode(), s) for s, q in others.items()]
        term = [(average[t] - own[t], t.encode(), t) for t in kept if words[lang, source][t] and own[t] > average[t]]
        for part, listed in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
            out |= {(lang, source, part, item, -value, rank) for rank, (value, _, item) in enumerate(listed, 1)}
    return out


def corpus(n, sources, seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 14))) for _ in range(60)]
    vocabulary += ["longer" * 14 + end for end in ("", "a", "b", "ab")]
    rows = []
    for i in range(n):
        lang, source = rng.choice(["en", "de", None]), rng.choice(["hot", rng.choice(sources)])
        weights = [1 + (hash((source, w)) % 5) for w in range(len(vocabulary))]
        words = rng.choices(vocabulary, weights, k=rng.randint(0, 40))
        text = "".join(w.upper() + "-" if rng.random() < 0.2 else w + rng.choice([" ", "1", "\n"]) for w in words)
        rows.append((i if rng.random() < 0.9 else None, None if rng.random() < 0.05 else text, lang, source))
    return rows


def test_source_audit_equals_brute_force(spark, monkeypatch):
    rows = corpus(400, ["s1", "s2", "ß", None, ""], 3)
    rows += rows[:20]
    want = audited([r[1:] for r in rows], 30)
    got = source_audit.source_divergence(frame(spark, rows).repartition(5))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_source_audit_in_small_blocks_of_sources_and_terms(spark, monkeypatch):
    monkeypatch.setattr(source_audit, "SOURCES", 3)
    monkeypatch.setattr(source_audit, "SHARD_ROWS", 40)
    rows = corpus(300, [f"s{i}" for i in range(8)], 4)
    got = source_audit.source_divergence(frame(spark, rows), min_docs=5, top=7)
    listed = [tuple(r) for r in got.collect()]
    assert len(listed) == len(set(listed)) and set(listed) == audited([r[1:] for r in rows], 5, 7)


def test_source_audit_without_kept_terms_and_without_rows(spark):
    rows = [(1, "one two", "en", "a"), (2, None, "en", "b"), (3, "three", "de", "c")]
    got = {tuple(r) for r in source_audit.source_divergence(frame(spark, rows)).collect()}
    assert got == {("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}
    assert source_audit.source_divergence(frame(spark, [])).count() == 0


def test_sorted_pointers_group_equal_words_of_any_length():
    rng = random.Random(2)
    words = ["".join(rng.choice("ab") for _ in range(rng.choice([1, 7, 8, 9, 16, 63, 64, 65, 200]))) for _ in range(300)]
    words += rng.sample(words, 100)
    text = " ".join(words).encode()
    lowered, starts, lengths = source_audit._pointers(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    order, first = source_audit.multikey_sort(lowered, starts, lengths)
    ordered = [words[i] for i in order]
    assert ordered == sorted(words)
    assert first.tolist() == [i == 0 or ordered[i] != ordered[i - 1] for i in range(len(ordered))]


def test_long_document_counts_once(monkeypatch):
    text = (b"alpha beta " * 500) + b"gamma"
    whole = source_audit.count_terms(np.frombuffer(text, np.uint8), np.array([0, len(text)]), np.array([4]))
    monkeypatch.setattr(source_audit, "SLICE", 64)
    pieces = source_audit._count_long(np.frombuffer(text, np.uint8), 4)
    rows = lambda t: {(r["term"], r["n"], r["docs"]) for r in t.to_pylist()}
    assert rows(whole) == rows(pieces) == {("alpha", 500, 1), ("beta", 500, 1), ("gamma", 1, 1)}


# --- token alignment --------------------------------------------------------


def token_bytes():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    code = {letter: byte for byte, letter in byte_letters().items()}
    entries = {i: bytes(code[c] for c in t) for t, i in a.get_vocab().items()}

    def piece(i):
        text = b.id_to_piece(i)
        return bytes([int(text[3:5], 16)]) if b.is_byte(i) else text.replace("▁", " ").encode()

    return (lambda t: [(i, entries[i]) for i in a.encode(" " + t, add_special_tokens=False).ids]), (
        lambda t: [(i, piece(i)) for i in b.encode(t)]
    )


def aligned(texts):
    """The columns after ``doc_id``, token by token."""
    spell_a, spell_b = token_bytes()
    shapes, links = [], []
    for text in texts:
        a, b = spell_a(text or ""), spell_b(text or "")
        raw = (" " + (text or "")).encode()
        linked, groups = [], []
        if text and b"".join(s for _, s in a) == raw == b"".join(s for _, s in b):
            owner_a = [k for k, (_, s) in enumerate(a) for _ in s]
            owner_b = [k for k, (_, s) in enumerate(b) for _ in s]
            linked = [(a[x][0], b[y][0]) for x, y in sorted(set(zip(owner_a, owner_b, strict=True)))]
            at = [i for i in range(len(raw)) if i + 1 == len(raw) or (owner_a[i] != owner_a[i + 1] and owner_b[i] != owner_b[i + 1])]
            for low, high in zip([-1, *at], at, strict=False):
                sides = [sorted({o[i] for i in range(low + 1, high + 1)}) for o in (owner_a, owner_b)]
                groups.append("|".join(",".join(str(t[k][0]) for k in side) for t, side in zip((a, b), sides, strict=True)))
        links.append(linked)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        shapes.append(((len(a), len(b)) if groups else (0, 0)) + (len(groups), len(linked), digest))
    counts = Counter(link for linked in links for link in linked)
    highest = defaultdict(int)
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    return [
        (*s[:4], sum(counts[x] == highest[x[1]] for x in linked), sum(counts[x] for x in linked), s[4])
        for s, linked in zip(shapes, links, strict=True)
    ]


def test_alignment_equals_brute_force(spark):
    texts = [*ODD, ODD[8], "no id here", "the same text again", "the same text again"]
    ids = [*range(len(ODD)), 8, None, 900, 901]
    rows = [(i, t, "en", None) for i, t in zip(ids, texts, strict=True)]
    got = alignment.token_alignment(frame(spark, rows).repartition(4), A, B, new_folder(spark, "pairs")).collect()
    assert got[0].__fields__ == [c.split()[0] for c in alignment.SUMS.split(", ")]
    want = Counter(zip(ids, aligned(texts), strict=True))
    assert Counter((r["doc_id"], tuple(r)[1:]) for r in got) == want


def test_alignment_of_no_rows_and_of_rows_without_tokens(spark):
    empty = alignment.token_alignment(frame(spark, []), A, B, new_folder(spark, "pairs"))
    assert empty.count() == 0
    rows = alignment.token_alignment(frame(spark, [(1, None, "en", "a"), (2, "", "en", "a")]), A, B, new_folder(spark, "pairs"))
    assert sorted(tuple(r) for r in rows.collect()) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


@pytest.mark.parametrize("piece", [1, 2, 5, 1000])
def test_pieces_of_any_size_give_the_same_overlaps(piece):
    rng = random.Random(piece)
    for _ in range(30):
        end = rng.randint(1, 60)
        a, b = (np.array(sorted({*rng.sample(range(1, end + 1), rng.randint(0, end)), end})) for _ in range(2))
        splits = alignment.split_merge(a, b, np.arange(len(a) + len(b) + 1))
        merged = sorted([(v, 0) for v in a] + [(v, 1) for v in b])
        assert splits.tolist() == [sum(side == 0 for _, side in merged[:d]) for d in range(len(merged) + 1)]
        under, inner, inner_a, close_a, close_b = alignment.overlaps(a, b, piece)
        starts = lambda e: np.concatenate([[0], e[:-1]])
        every = {
            (i, j)
            for i in range(len(a))
            for j in range(len(b))
            if max(starts(a)[i], starts(b)[j]) < min(a[i], b[j])
        }
        links = [*enumerate(under.tolist()), *zip(inner_a.tolist(), inner.tolist(), strict=True)]
        assert len(links) == len(every) and set(links) == every
        assert a[close_a].tolist() == b[close_b].tolist() == sorted({*a.tolist()} & {*b.tolist()})


def test_very_long_text_is_aligned_whole():
    text = " ".join(RNG.choice(["the", "unforgettable", "Ünï", "x1", "..."]) for _ in range(60_000))
    a, b = alignment.spelling(A), alignment.spelling(B)
    n_a, n_b, groups, links, digest, held = alignment._align([text], a, b)[0]
    assert (n_a, n_b, groups, links, digest) == (*aligned([text])[0][:4], aligned([text])[0][6])
    assert len(held) == 4 * links


# --- byte network -----------------------------------------------------------


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in quality_model.start_weights().items()}
    size = quality_model.BLOCK * quality_model.PER_CHUNK
    lengths, text, labels = np.array([size, size, 100, size, 7]), np.array([0, 0, 0, 1, 1]), np.array([1.0, 0.0])
    chunks = rng.integers(0, 256, (5, size)).astype(np.int16)
    chunks[np.arange(size) >= lengths[:, None]] = quality_model.PAD
    _, grad = quality_model.gradients(w, chunks, lengths, text, labels)
    for name, values in w.items():
        for _ in range(5):
            at = tuple(rng.integers(0, n) for n in values.shape)
            if name == "vectors" and at[0] == quality_model.PAD:
                continue
            loss = []
            for move in (1e-5, -2e-5):
                values[at] += move
                loss.append(quality_model.gradients(w, chunks, lengths, text, labels)[0])
            values[at] += 1e-5
            assert abs((loss[0] - loss[1]) / 2e-5 - grad[name][at]) < 1e-4


def test_training_and_scoring_see_the_same_network():
    """A text that one chunk covers scores as its loss says, whatever stands beside it."""
    w = quality_model.start_weights(3)
    texts = [b"short", b"x" * 255, bytes(range(200)), b""]
    offsets = np.cumsum([0, *map(len, texts)])
    scores = quality_model.probabilities(w, np.frombuffer(b"".join(texts), np.uint8), offsets)
    for text, score in zip(texts, scores, strict=True):
        alone = quality_model.probabilities(w, np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]
        assert abs(alone - score) < 1e-6
        size = quality_model.BLOCK * quality_model.PER_CHUNK
        row = np.full((1, size), quality_model.PAD, dtype=np.int16)
        row[0, : len(text)] = list(text)
        loss, _ = quality_model.gradients(w, row, np.array([len(text)]), np.array([0]), np.array([1.0]))
        assert abs(-np.log(score) - loss) < 1e-4


def test_every_byte_of_a_long_text_is_read(monkeypatch):
    """A change anywhere, also across the pieces convolved at a time, reaches the blocks."""
    w = quality_model.start_weights(5)
    data = np.full(40_000, ord("a"), dtype=np.uint8)
    offsets = np.array([0, len(data)])
    before = quality_model.block_pools(w, data, offsets)
    monkeypatch.setattr(quality_model, "PIECE", 640)
    again = quality_model.block_pools(w, data, offsets)
    assert all(np.allclose(x, y, atol=1e-5) for x, y in zip(before, again, strict=True))
    for place in (0, 639, 640, 20_001, 39_999):
        changed = data.copy()
        changed[place] = ord("Z")
        assert not np.array_equal(quality_model.block_pools(w, changed, offsets)[1], again[1])


def _labelled(n):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(["plain", "words", "of", "some", "text", "again"]) for _ in range(rng.randint(5, 200))]
        good = rng.random() < 0.7
        rows.append((i, " ".join(words) if good else "!! ".join(words).upper(), "en", "a"))
        labels.append((i, int(good), 0))
    return rows, labels


def test_quality_scores_on_held_out_rows(spark):
    rows, labels = _labelled(500)
    extra = [(None, "plain words", "en", "a"), (900, None, "en", "a"), (901, "", "en", "a"), (3, rows[3][1], "de", "b")]
    marks = [*labels, (None, 1, 0), (5000, 0, 1), (7, None, 0)]
    labelled = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = quality_model.score_quality(frame(spark, rows + extra).repartition(3), labelled).collect()
    assert len(got) == len(rows) + len(extra)
    truth = {i: quality for i, quality, _ in labels}
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % 5 == 0)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    assert len({r["score"] for r in got if r["doc_id"] in (900, 901)}) == 1
    assert len({r["score"] for r in got if r["doc_id"] == 3}) == 1


def test_held_out_labels_are_never_read(spark):
    rows, labels = _labelled(60)
    docs = frame(spark, rows)
    kinds = "doc_id long, quality int, toxic int"
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in labels]
    scores = [
        {r["doc_id"]: r["score"] for r in quality_model.score_quality(docs, spark.createDataFrame(m, kinds)).collect()}
        for m in (labels, turned)
    ]
    assert all(abs(scores[0][i] - scores[1][i]) < 1e-9 for i in scores[0])


def test_quality_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_model.score_quality(frame(spark, []), none).count() == 0
    rows = quality_model.score_quality(frame(spark, [(1, "text", "en", "a"), (2, None, "en", "a")]), none).collect()
    assert [r["score"] for r in rows] == [0.5, 0.5]
    one = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality_model.score_quality(frame(spark, [(1, "text", "en", "a"), (2, "more", "en", "a")]), one).collect()
    assert all(abs(r["score"] - 2 / 3) < 1e-6 for r in rows)


def test_quality_model_on_the_synthetic_labels(spark):
    """Held-out accuracy and rank order on the given tables."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = quality_model.score_quality(docs, labels).join(labels.select("doc_id", "quality"), "doc_id")
    rows = scored.filter("held_out").select("score", "predicted", "quality").collect()
    score, truth = (np.array([r[c] for r in rows]) for c in ("score", "quality"))
    place = np.argsort(np.argsort(score)) + 1
    good, bad = (truth == 1).sum(), (truth == 0).sum()
    area = (place[truth == 1].sum() - good * (good + 1) / 2) / (good * bad)
    print(f"held-out rows {len(rows)}, area under the curve {area:.4f}, accuracy {np.mean((score >= 0.3) == truth):.4f}")
    assert area > 0.99 and np.mean((score >= 0.3) == truth) > 0.97

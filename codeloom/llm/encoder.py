"""Token ids of whole texts, with a memory of short text pieces.

A byte-level pre-tokenizer never joins a space to what stands before it, so a
text can be cut in front of a single space that stands between other
characters, and the ids of the parts put together are the ids of the text.
Within such a part words and punctuation are encoded apart. Natural text
repeats its words, so most of them are looked up and only new ones encoded.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Callable

WIDTH = 4  # an id is kept as an unsigned 32-bit little-endian integer
# Bounds of a worker's memory of parts and words; beyond them it starts anew.
PARTS, WORDS, CHARS = 400_000, 600_000, 30_000_000

# What the byte-level pre-tokenizer keeps together, for these letters and ASCII.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_KNOWN = re.compile(rf"[\x00-\x7f{_LETTERS}]*")
_WORDS = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\t-\r 0-9{_LETTERS}]+"
    r"|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
)
_POINTS = ".,;:!?"


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, others follow 255."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = (b for b in range(256) if b not in shown)
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def pack(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def crc(ids: bytes) -> int:
    return zlib.crc32(ids)


def cuts_at_spaces(tokenizer: dict) -> bool:
    """Whether parts in front of single spaces are encoded independently."""
    step = tokenizer.get("pre_tokenizer") or {}
    plain = not any(
        a["lstrip"] or a["rstrip"] or a["single_word"] or " " in a["content"]
        for a in tokenizer.get("added_tokens", [])
    )
    return (
        plain
        and tokenizer.get("normalizer") is None
        and step.get("type") == "ByteLevel"
        and step.get("use_regex", True)
        and not step.get("add_prefix_space", True)
    )


class _Memory(dict):
    """A mapping that asks ``find`` for what it does not hold."""

    def __init__(self, find: Callable):
        self._find = find
        self.chars = 0

    def __missing__(self, key: str):
        value = self[key] = self._find(key)
        self.chars += len(key)
        return value

    def bounded(self, entries: int) -> None:
        if len(self) > entries or self.chars > CHARS:
            self.clear()
            self.chars = 0


class Encoder:
    """Encodes texts with the file's own library; ids come as packed bytes.

    ``.json`` files go to tokenizers, ``.model`` files to sentencepiece; no
    begin, end or special tokens are added, nothing is truncated or padded.
    """

    def __init__(self, path: str):
        if path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            model = SentencePieceProcessor(model_file=path)
            self._whole = lambda text: pack(model.encode(text, num_threads=1))
            self._cut = False
            self.vocabulary = model.get_piece_size()
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self._whole = lambda text: pack(tokenizer.encode(text, add_special_tokens=False).ids)
        self.vocabulary = tokenizer.get_vocab_size(with_added_tokens=True)
        with open(path, encoding="utf-8") as file:
            description = json.load(file)
        self._cut = cuts_at_spaces(description)
        special = [re.escape(a["content"]) for a in description.get("added_tokens", [])]
        self._special = re.compile("|".join(special) or r"(?!)")
        # No special token looks like a word with points behind it.
        self._plain = not any(a["content"].rstrip(_POINTS).isalpha() for a in description.get("added_tokens", []))
        letters, model = byte_letters(), tokenizer.model

        space, tokenize = letters[0x20], model.tokenize

        def word(text: str) -> bytes:
            if text[0] == " " and text.isascii() and text[1:].isalpha():
                spelt = space + text[1:]  # printable bytes stand for themselves
            else:
                spelt = text.encode().decode("latin-1").translate(letters)
            return pack([token.id for token in tokenize(spelt)])

        self._words = _Memory(word)
        self._parts = _Memory(self._part)

    def _part(self, part: str) -> bytes | None:
        """Ids of a space and ``part``; None if there must be no cut before it."""
        if not part or part[0].isspace():
            return None
        core = part.rstrip(_POINTS)
        if self._plain and core.isalpha() and (core.isascii() or _KNOWN.fullmatch(core)):
            ids = self._words[" " + core]
            return ids if core == part else ids + self._words[part[len(core) :]]
        text = " " + part
        if self._special.search(part) or not (part.isascii() or _KNOWN.fullmatch(part)):
            return self._whole(text)
        return b"".join(map(self._words.__getitem__, _WORDS.findall(text)))

    def encode(self, text: str) -> bytes:
        if not self._cut:
            return self._whole(text)
        head, *rest = text.split(" ")
        try:
            tail = b"".join(map(self._parts.__getitem__, rest))
        except TypeError:  # white space stands beside a cut
            return self._whole(text)
        self._parts.bounded(PARTS)
        self._words.bounded(WORDS)
        return self._whole(head) + tail if head else tail


_LOADED: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]

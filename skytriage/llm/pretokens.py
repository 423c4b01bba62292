"""Pre-tokens of a word-level BPE tokenizer file, split the same way as the tokenizers library does."""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator

import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Characters on which the library's Unicode rules and those of Python agree; other texts are split by the library.
_PLAIN = regex.compile(r"[\t\n\r -~ -¬®-ž‐-‧‰-⁞€]*+")
#: Longer texts are split at white space, which no pre-token contains, into pieces of about this many characters.
PIECE = 1 << 18


def _members(kind: str) -> str:
    """All letters ("L") or numbers ("N") up to U+20FF, which holds all plain characters."""
    found = [chr(c) for c in range(0x2100) if unicodedata.category(chr(c))[0] == kind]
    return "".join(f"\\u{ord(c):04x}" for c in found)


def plain_pattern(pattern: str):
    """The split pattern for plain texts: by the standard library, about twice as fast, where it can say the same."""
    if r"\p" in regex.sub(r"\[[^]]*\]", "", pattern):
        return regex.compile(pattern)
    said = pattern.replace(r"\p{L}", _members("L")).replace(r"\p{N}", _members("N"))
    return regex.compile(pattern) if r"\p" in said.lower() else re.compile(said)


class PreTokens:
    """Splitter for a file with NFC, white space and lower-case normalisers, a split pattern and byte-level letters.

    Other kinds of files are refused.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.path = path
        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        steps = [n["type"] for n in self.spec["normalizer"]["normalizers"]]
        parts = self.spec["pre_tokenizer"]["pretokenizers"]
        if steps != ["NFC", "Replace", "Lowercase"] or [p["type"] for p in parts] != ["Split", "ByteLevel"] or parts[1]["use_regex"] or parts[1]["add_prefix_space"]:
            raise ValueError(f"{path}: not a word-level BPE file of the supported kind")
        self.pattern = plain_pattern(parts[0]["pattern"]["Regex"])
        self.special = {t["content"]: t["id"] for t in self.spec["added_tokens"]}
        self._cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        letters = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(letters)]
        #: Letter of each byte: printable ones stand for themselves, the others for code points from 256 on.
        self.letter = {b: chr(b) for b in letters} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self.byte = {c: b for b, c in self.letter.items()}
        self._table = {b: c for b, c in self.letter.items()}

    def letters(self, word: str) -> str:
        """The byte-level letters of a word."""
        return word.encode("utf-8").decode("latin-1").translate(self._table)

    def pieces(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > PIECE:
            end = at + PIECE
            while end < len(text) and not text[end].isspace():
                end += 1
            yield text[at:end]
            at = end
        yield text[at:]

    def split(self, text: str) -> Iterator[tuple[str, list]]:
        """Runs of a text: ``("words", words)``, ``("letters", byte-level words)`` or ``("special", [id])``."""
        for piece in self.pieces(text):
            for k, run in enumerate(self._cut.split(piece) if self._cut and "<" in piece else [piece]):
                if not run:
                    continue
                if k % 2:
                    yield "special", [self.special[run]]
                elif _PLAIN.fullmatch(run):
                    if not run.isascii():
                        run = unicodedata.normalize("NFC", run)
                    yield "words", self.pattern.findall(run.lower())
                else:
                    clean = self.tokenizer.normalizer.normalize_str(run.encode("utf-8", "replace").decode("utf-8"))
                    yield "letters", [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(clean)]

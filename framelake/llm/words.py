"""How the public tokenizers cut a text into the words they encode one by one.

A word's tokens do not depend on its neighbours, so an encoder may remember them. The patterns of the two vocabularies
are stated here for code points below 0x250, where neither normalisation form nor Unicode version plays a part. Any
other text is cut by the tokenizers library's own normaliser and pre-tokenizer.
"""

from __future__ import annotations

import functools
import re

from .common import one_thread

# Letters, numbers and white space below U+0250, and the patterns of the tokenizers' files over them.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NUMBERS = "0-9²³¹¼-¾"
SPACES = r"\t-\r \x85\xa0"
WORD_BPE = f"'(?:[stmdSTMD]|[rR][eE]|[vV][eE]|[lL][lL])|[{LETTERS}]+|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+"
BYTE_BPE = f"'(?:[stmd]|re|ve|ll)| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
# U+0130 becomes two code points in lower case.
OTHER = re.compile("[^\x00-įı-ɏ]")


def load(path: str):
    """The tokenizer of a file, without truncation and padding."""
    one_thread()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def specials(tok) -> re.Pattern | None:
    found = sorted((t.content for t in tok.get_added_tokens_decoder().values()), key=len, reverse=True)
    return re.compile("(" + "|".join(map(re.escape, found)) + ")") if found else None


class Cutter:
    """Cuts texts into words. ``pattern``: WORD_BPE or BYTE_BPE, whichever the file's pre-tokenizer states."""

    def __init__(self, tok, pattern: str):
        self.tok, self.special = tok, specials(tok)
        self.find = re.compile(pattern).findall

    def __call__(self, text: str) -> list[str]:
        """Words in order. Texts with code points from 0x250 up come as normalised words, special tokens as themselves."""
        if self.special is not None and "<|" in text and self.special.search(text):
            return [w for part in self.special.split(text) if part for w in ([part] if self.special.fullmatch(part) else self.plain(part))]
        return self.plain(text)

    def plain(self, text: str) -> list[str]:
        if not OTHER.search(text):
            return self.find(text)
        normal = self.tok.normalizer.normalize_str(text) if self.tok.normalizer else text
        spans = split_spans(self.tok, normal)
        return [normal[a:b] for a, b in spans]


def split_spans(tok, normal: str) -> list[tuple[int, int]]:
    """Character spans of the library's own pre-tokens."""
    return [span for _, span in tok.pre_tokenizer.pre_tokenize_str(normal)]


def _byte_signs() -> dict[int, str]:
    """The sign of each byte in byte-level vocabularies: visible Latin-1 characters stand for themselves, the others follow from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + k) for k, b in enumerate(others)}


BYTE_SIGNS = _byte_signs()


def visible(word: str) -> str:
    """The UTF-8 bytes of a word in the signs of a byte-level vocabulary."""
    return word.encode().decode("latin-1").translate(BYTE_SIGNS)


@functools.cache
def cutter(path: str, pattern: str) -> Cutter:
    return Cutter(load(path), pattern)

"""Pre-tokens of byte-level BPE: the matches of its fixed pattern in a text."""

from __future__ import annotations

import re
from collections.abc import Callable

# The pattern of this kind of tokenizer, and the letters, numbers and white space below U+0250.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NUMBERS = "0-9²³¹¼-¾"
BLANKS = r"\t\n\x0b\x0c\r \x85\xa0"

_BEYOND = re.compile("[^\x00-ɏ]")
_LATIN = re.compile(
    f"'(?:[stmd]|re|ve|ll)| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{BLANKS}{LETTERS}{NUMBERS}]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+"
)


def is_latin(text: str) -> bool:
    """Whether every character is below U+0250, where the classes above are complete."""
    return text.isascii() or _BEYOND.search(text) is None


def finder(pattern: str) -> Callable[[str], list[str]]:
    """A function that lists the matches of ``pattern``; the usual pattern takes a faster form on Latin texts."""
    import regex

    general = regex.compile(pattern).findall
    if pattern != PATTERN:
        return general
    latin = _LATIN.findall
    return lambda text: latin(text) if is_latin(text) else general(text)

"""How byte-level vocabularies spell bytes as characters."""

from __future__ import annotations


def byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: itself if printable, else from 256 on in turn."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def spelled(text: str) -> str:
    """The UTF-8 bytes of a text as a byte-level vocabulary spells them."""
    return "".join(CHARACTERS[b] for b in text.encode())


CHARACTERS = {b: c for c, b in byte_of_character().items()}

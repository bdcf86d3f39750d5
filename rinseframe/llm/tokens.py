"""Byte-level BPE ids of whole texts, as little-endian unsigned 32-bit blobs.

Boundaries that every text has, before a blank and a following non-blank, cut it into
chunks; chunks that were met before come from a bounded table. Others are encoded by
the ranks file of the same vocabulary, those with unusual characters or a special
token's string by the tokenizer file itself, so ids are those of the tokenizer file.
"""

from __future__ import annotations

import base64
import json
import re
from functools import cached_property, lru_cache

import numpy as np

#: chunks remembered by a Python worker: about 50 MB
REMEMBERED = 250_000
DOUBLE_SPACE = re.compile(r"\s\s")
BEFORE_WORD = re.compile(r"(?= \S)")
#: characters on which all regular-expression libraries agree
USUAL = re.compile(r"[\t\n\r -~¡-¬®-ɏ]*", re.ASCII)


class Encoder:
    def __init__(self, tokenizer_path: str, ranks_path: str | None, pattern: str):
        self.path = tokenizer_path
        with open(tokenizer_path, encoding="utf-8") as file:
            self.special = [token["content"] for token in json.load(file)["added_tokens"]]
        self.fast = None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}

    @cached_property
    def whole(self):
        """The tokenizer of the file, loaded where a chunk needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode_chunk(self, chunk: str) -> bytes:
        if self.fast and USUAL.fullmatch(chunk) and not any(s in chunk for s in self.special):
            ids = self.fast.encode_ordinary(chunk)
        else:
            ids = self.whole.encode(chunk, add_special_tokens=False).ids
        blob = np.array(ids, dtype="<u4").tobytes()
        if len(self.known) < REMEMBERED and len(chunk) <= 64:
            self.known[chunk] = blob
        return blob

    def encode(self, text: str) -> bytes:
        """Ids of the whole text as a blob."""
        if any(" " in s and s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if DOUBLE_SPACE.search(text):
            chunks = BEFORE_WORD.split(text)
        else:
            first, *rest = text.split(" ")
            chunks = [first, *[" " + c for c in rest]]
        get, known = self.known.get, []
        for chunk in chunks:
            blob = get(chunk)
            known.append(self.encode_chunk(chunk) if blob is None else blob)
        return b"".join(known)


@lru_cache(maxsize=2)
def encoder(tokenizer_path: str, ranks_path: str | None, pattern: str) -> Encoder:
    return Encoder(tokenizer_path, ranks_path, pattern)

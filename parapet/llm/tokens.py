"""Token ids of whole texts in the byte-level vocabulary, one encoder per Python worker."""

import base64
import functools
import os
import re

import numpy as np

END_TEXT = "<|endoftext|>"
CACHED = 150_000
BEYOND_LATIN = re.compile("[^\0-ɏ]")


class _Spaced(Exception):
    """A piece that can't be encoded apart from its neighbours."""


class _Pieces(dict):
    """Ids (little-endian bytes) of a space followed by a piece; emptied when full."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece):
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise _Spaced
        ids = self.encode(" " + piece)
        if len(piece) <= 40:
            if len(self) >= CACHED:
                self.clear()
            self[piece] = ids
        return ids


@functools.lru_cache(maxsize=2)
def encoder(path):
    """text -> ids as little-endian unsigned 32-bit bytes, no special tokens added.

    `path` is a tokenizer file; its vocabulary as ranks (same name, .tiktoken) is used
    where it lies beside, for Latin text, on which both libraries agree and it is faster.
    Other texts are cut: every space before a non-space starts a new word, so pieces between
    single spaces are encoded apart and remembered; a text with other white space around a
    space is encoded whole.
    """
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path)
    fast = None
    ranks = os.path.splitext(path)[0] + ".tiktoken"
    if os.path.exists(ranks):
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        special = {END_TEXT: exact.token_to_id(END_TEXT)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=special)

    def latin(text):
        return fast is not None and (text.isascii() or not BEYOND_LATIN.search(text))

    def by_ranks(text):
        return fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()

    def encode(text):
        return by_ranks(text) if latin(text) else np.array(exact.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    pieces = _Pieces(encode)

    def whole(text):
        if latin(text):
            return by_ranks(text)
        first, *rest = text.split(" ")
        try:
            head = pieces.encode(first) if first and not first[-1:].isspace() else b""
            if first and not head:
                return encode(text)
            return head + b"".join(map(pieces.__getitem__, rest))
        except _Spaced:
            return encode(text)

    return whole

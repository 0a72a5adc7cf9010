"""Token ids of a public byte-level BPE vocabulary.

The ids are those of ``tokenizers`` for the vocabulary file.  Where the file's merges are in the
order of their ids, ``tiktoken`` gives the same ids from the same merges in half the time; texts of
ASCII and Latin-1 letters go that way.  Any other text, and a text that holds an added token of the
vocabulary or a long run of blanks, is encoded by ``tokenizers`` itself, so neither Unicode tables
nor limits of the two can differ.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np

_UNUSUAL = re.compile("[^\t\n\r -~¡-ÿ]")
_LONG_BLANK = re.compile(r"\s{256}")
#: How a byte-level vocabulary cuts a text (a fixed value).
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}


def default_vocabulary() -> str:
    """The place of the 50k byte-level vocabulary among the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it can be printed."""
    shown = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 256 and b != 173]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def _by_rank(path: str):
    """The vocabulary for ``tiktoken``, or None where its merges aren't in the order of their ids."""
    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    model, letters = data["model"], byte_letters()
    added = {t["content"] for t in data.get("added_tokens", ())}
    words = {w: k for w, k in model.get("vocab", {}).items() if w not in added}
    merges = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", ())]
    ordered = all(words.get(a + b) == 256 + k for k, (a, b) in enumerate(merges))
    if model.get("type") != "BPE" or data.get("normalizer") or data.get("pre_tokenizer") != _BYTE_LEVEL or not ordered or len(words) != 256 + len(merges):
        return None
    import tiktoken

    return tiktoken.Encoding("bytes", pat_str=_PIECES, mergeable_ranks={bytes(letters[c] for c in w): k for w, k in words.items()}, special_tokens={})


class Encoder:
    """Encodes texts with the vocabulary file at ``path``; ids fit 16 bits where it has at most 65,536."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.quick = _by_rank(path)
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text, little-endian in ``kind``."""
        for text in texts:
            if not text:
                yield b""
            elif self.quick is None or _UNUSUAL.search(text) or _LONG_BLANK.search(text) or any(t in text for t in self.added):
                yield array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
            else:
                yield array(self.code, self.quick.encode_ordinary(text)).tobytes()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]

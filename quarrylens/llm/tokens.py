"""Ids of public tokenizers.

The byte-level tokenizer is read from its ``tokenizers`` file. Where the file is of the plain
kind (no normaliser, byte-level words, merges in the order of their ids) the merging runs in
``tiktoken`` over the file's own vocabulary, which gives the same ids in a fraction of the time;
tests compare the two on every code point. Texts with very long runs of white space, which
``tiktoken`` cannot take, and files of another kind go to ``tokenizers``.

A long text can be worked through in segments: it is cut at single spaces between visible
characters. Neither tokenizer joins across such a space: the byte-level one starts a new word
there, and no piece of the other holds a space behind a character (checked when it is loaded).
So the ids of the segments, one after another, are the ids of the whole text.

The files' contents are broadcast (two files of fixed size, below 4 MB together), so executors
need the libraries only.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterator

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
# How byte-level files cut text into words, published with the first tokenizer of this kind.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CUT = re.compile(r" (?=[!-~\w])(?<=[!-~\w] )")
_LONG_BLANK = re.compile(r"\s{1000}")


def contents(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def segments(text: str, size: int) -> Iterator[str]:
    """The text in segments of ``size`` characters and what is left to the next cut; between two
    segments a space is missing."""
    at = 0
    while cut := _CUT.search(text, at + size):
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:]


def byte_level() -> dict[str, int]:
    """Character that stands for a byte in a byte-level vocabulary -> that byte: visible
    Latin-1 characters stand for themselves, the rest in order for code points from 256."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def raw_ids(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit numbers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class ByteBpe:
    """Byte-level tokenizer; special tokens in a text are either plain text or themselves."""

    def __init__(self, file: bytes, specials_are_text: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(file.decode())
        self.model.encode_special_tokens = specials_are_text
        self.size = self.model.get_vocab_size()
        self.fast = _fast(json.loads(file), specials_are_text)

    def token_bytes(self) -> list[bytes]:
        table = byte_level()
        names = [self.model.id_to_token(i) or "" for i in range(self.size)]
        return [bytes(table[c] for c in n) if all(c in table for c in n) else n.encode() for n in names]

    def encode(self, text: str) -> list[int]:
        if self.fast is None or _LONG_BLANK.search(text):
            return self.model.encode(text, add_special_tokens=False).ids
        return self.fast(text)


def _fast(file: dict, specials_are_text: bool):
    """The merging of a plain byte-level file in ``tiktoken``, or None for any other file."""
    words, model, added = file.get("pre_tokenizer") or {}, file["model"], file.get("added_tokens", [])
    special = {t["content"]: t["id"] for t in added}
    ids = {name: i for name, i in model.get("vocab", {}).items() if name not in special}
    merged = [m if isinstance(m, str) else " ".join(m) for m in model.get("merges", [])]
    in_order = [ids.get(m.replace(" ", "", 1), -1) for m in merged]
    plain = (
        model.get("type") == "BPE" and not model.get("dropout") and file.get("normalizer") is None
        and words.get("type") == "ByteLevel" and words.get("use_regex") and not words.get("add_prefix_space")
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
        and in_order == list(range(256, 256 + len(merged))) and len(ids) == 256 + len(merged)
    )
    if not plain:
        return None
    import tiktoken

    table = byte_level()
    ranks = {bytes(table[c] for c in name): i for name, i in ids.items()}
    encoding = tiktoken.Encoding("file", pat_str=WORDS, mergeable_ranks=ranks, special_tokens=special)
    if specials_are_text:
        return encoding.encode_ordinary
    return lambda text: encoding.encode(text, allowed_special="all")


class PieceBpe:
    """Piece tokenizer, which puts a space before the text."""

    def __init__(self, file: bytes):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=file)
        self.size = self.model.get_piece_size()
        self.pieces = [self.model.id_to_piece(i) for i in range(self.size)]
        if any("▁" in p.lstrip("▁") for p in self.pieces):
            raise ValueError("A piece holds a space behind a character; segments cannot be encoded on their own.")

    def token_bytes(self) -> list[bytes]:
        return [
            bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(self.pieces)
        ]

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text)

"""Vocabulary files of public tokenizers as the workers use them.

The files lie at the same path on every machine; a worker loads a tokenizer once.
"""

from __future__ import annotations

import json
import os
import unicodedata
from functools import cache

import numpy as np
import regex

#: White space of more than this at a stretch goes to the library that takes any length.
LONG_RUN = 1000


def tokenizer_path(name: str) -> str:
    """A path as it is; a bare name is looked up among the installed public tokenizers."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    """The pattern that cuts text into pre-tokens for byte-level merges."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def split_alike(text: str) -> bool:
    """Do all libraries cut this text at the same places? Not for certain where it has code points without a category:
    libraries with other Unicode tables may class them as letters, numbers or signs."""
    return text.isascii() or "Cn" not in map(unicodedata.category, set(text))


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable bytes stand for themselves; the others are numbered from U+0100 on.
    """
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals the work to the cores
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def is_byte_level(path: str) -> bool:
    """Byte-level BPE by the usual pattern, without normaliser, whose added tokens are matched as they stand?"""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    plain = not any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
    by_pattern = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    return by_pattern and plain and not spec.get("normalizer") and spec["model"]["type"] == "BPE"


@cache
def json_tokenizer(path: str):
    """The ``tokenizers`` library with its defaults, without truncation and padding."""
    t = _load(path)
    t.no_truncation()
    t.no_padding()
    return t


@cache
def piece_tokenizer(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


class Vocabulary:
    """Ids of texts without special tokens, and the bytes of every id."""

    def __init__(self, path: str):
        self.pieces = path.endswith(".model")
        if self.pieces:
            self._sp = piece_tokenizer(path)
            table = [self._piece_bytes(i) for i in range(self._sp.get_piece_size())]
        else:
            self._hf = _load(path)
            self._hf.no_truncation()
            self._hf.no_padding()
            self._hf.encode_special_tokens = True
            byte_of, vocab = byte_of_char(), self._hf.get_vocab(with_added_tokens=False)
            table = [b""] * self._hf.get_vocab_size(with_added_tokens=True)
            for token, i in vocab.items():
                table[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
            self._fast = self._ranked(path, vocab, table)
        self.bytes = np.array(table, object)
        self.lengths = np.array([len(b) for b in table], np.int64)
        self.dtype = np.uint16 if len(table) <= 1 << 16 else np.uint32

    def _piece_bytes(self, i: int) -> bytes:
        if self._sp.is_byte(i):
            return bytes([int(self._sp.id_to_piece(i)[3:-1], 16)])
        return self._sp.id_to_piece(i).replace("▁", " ").encode()

    def _ranked(self, path: str, vocab: dict, table: list[bytes]):
        """The same merges by rank, several times faster, where ids are in order of merging; else None."""
        special = {t.content for t in self._hf.get_added_tokens_decoder().values()}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"].get("merges", [])]
        made = [vocab.get("".join(m)) for m in merges]
        if not is_byte_level(path) or None in made or made != sorted(made):
            return None
        import tiktoken

        ranks = {table[i]: i for t, i in vocab.items() if t not in special}
        return tiktoken.Encoding("own", pat_str=split_pattern(), mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.pieces:
            return self._sp.encode(texts, num_threads=1)
        out, rest = [None] * len(texts), []
        for i, t in enumerate(texts):
            if self._fast is not None and split_alike(t) and not _LONG.search(t):
                out[i] = self._fast.encode_ordinary(t)
            else:
                rest.append(i)
        for i, e in zip(rest, self._hf.encode_batch([texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out


_LONG = regex.compile(r"\s{%d}" % LONG_RUN)


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)

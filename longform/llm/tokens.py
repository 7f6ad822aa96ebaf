"""Ids of a byte-level BPE tokenizer file.

Texts of Latin letters, digits, ASCII signs and plain white space go through the rank encoder of ``tiktoken``, with ranks read
from the same file: where the file's merges make its tokens in the order of their ids, both libraries give the same
ids, and the rank encoder needs a third of the time. All other texts, and those that hold a special token's string,
are encoded by ``tokenizers``.

The pre-tokenizer splits at white space, so no token crosses the start of a blank that follows a word: a text can also be
encoded as its blank-separated words, each with the blank before it (``splits`` tells for which words this holds).
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

MAX_WORDS = 800_000
# Characters whose kind (letter, digit, sign, white space) is the same in every version of Unicode.
PLAIN = re.compile("[\t\n\r -~¡-ɏ]*")
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""  # fixed: the byte-level splitter
LONG_WORD = 256
JOINED = 4096


def byte_decoder() -> dict[str, int]:
    """Characters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others, in order, for
    the characters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(rest)}


def ends_open(word: str) -> bool:
    """Whether a blank after this word could belong to the same white space run, or the word is too long to be kept."""
    return not word or len(word) > LONG_WORD or word[-1].isspace() or word[-1] == "᠎"


class ByteBpe:
    """``tokenizers`` file of a byte-level BPE. ``plain``: strings of special tokens inside texts are ordinary text."""

    def __init__(self, path: str, plain: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        pre = spec.get("pre_tokenizer") or {}
        self.by_word = (spec.get("normalizer") is None and pre.get("type") == "ByteLevel"
                        and not pre.get("add_prefix_space") and pre.get("use_regex", True))
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.specials = [] if plain else [t["content"] for t in spec.get("added_tokens", [])]
        decode = byte_decoder()
        self.bytes_of: list[bytes] = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = (bytes(decode[c] for c in token) if all(c in decode for c in token)
                                else token.encode("utf-8"))
        self.starts = np.array([b[:1] == b" " for b in self.bytes_of])
        self.ranks = self._rank_encoder(spec, vocab) if self.by_word else None

    def _rank_encoder(self, spec: dict, vocab: dict[str, int]):
        """The rank encoder of the same vocabulary, if the merges make the tokens in the order of their ids."""
        import tiktoken
        merged = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in spec["model"]["merges"]]
        if any(a >= b for a, b in zip(merged, merged[1:])) or merged[:1] == [-1]:
            return None
        added = {t["id"] for t in spec.get("added_tokens", [])}
        ranks = {b: i for i, b in enumerate(self.bytes_of) if i not in added}
        return tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a text."""
        if self.ranks and PLAIN.fullmatch(text) and not any(s in text for s in self.specials):
            try:
                return self.ranks.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
            except ValueError:  # its splitter gives up on very long runs of white space
                pass
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def splits(self, word: str) -> bool:
        return not ends_open(word) and not any(s in word for s in self.specials)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word with a blank before it (words that ``splits`` holds for)."""
        out: list[bytes] = []
        for i in range(0, len(words), JOINED):
            some = words[i:i + JOINED]
            raw = self.encode(" " + " ".join(some))
            first = np.flatnonzero(self.starts[np.frombuffer(raw, "<u4")])
            if len(first) == len(some):
                cuts = [*(first * 4).tolist(), len(raw)]
                out += [raw[a:b] for a, b in zip(cuts, cuts[1:])]
            else:
                out += [self.encode(" " + w) for w in some]
        return out


_LOADED: dict[tuple[str, bool], ByteBpe] = {}


def byte_bpe(path: str, plain: bool = False) -> ByteBpe:
    """The tokenizer of this worker process, loaded once."""
    if (path, plain) not in _LOADED:
        _LOADED[path, plain] = ByteBpe(path, plain)
    return _LOADED[path, plain]


def public_path(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers
    return public_tokenizers.path(name)

"""Token ids of texts by a public tokenizer file, with pre-tokens encoded once a worker.

The tokenizer of ``word_bpe_49k.json`` drops white space, lower-cases, and cuts what is left into pre-tokens, which it
encodes one by one. ``PieceEncoder`` makes the same pre-tokens with one pattern, keeps the ids of those it has seen in a
bounded cache, and has the library's model encode the others, many in one call. That holds for Latin text; words with
other characters or special strings go through the whole library, one by one (no id depends on what stands beyond
white space).
"""

from __future__ import annotations

import os
import re
from itertools import islice

import numpy as np

#: White space of the tokenizer. str.split() also splits at the four separators 1C to 1F, which are characters to it.
_SPACE = "\t-\r \x85\xa0  -     　"
_WORDS = re.compile(f"[^{_SPACE}]+")
_LETTERS = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-į"
_DIGITS = "0-9\xb2\xb3\xb9\xbc-\xbe"
#: Characters whose lower case and kind are plain; the pre-tokens of such text, by the pattern in the tokenizer file.
_PLAIN = re.compile("[!-~\xa1-į\t-\r \x85\xa0]*")
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^{_SPACE}{_LETTERS}{_DIGITS}]+")

DEFAULT_TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    """The place of a public tokenizer file; a path with a folder is taken as it is."""
    if os.path.dirname(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def plain(text: str) -> bool:
    """Whether the pattern above makes the library's pre-tokens of this text."""
    return "<|" not in text and _PLAIN.fullmatch(text) is not None


def pieces_of(text: str) -> list[str]:
    """The pre-tokens of a plain text."""
    return _PIECES.findall(text.lower())


class PieceEncoder:
    """Ids as little-endian unsigned 32-bit bytes. The cache of pre-tokens keeps its older half beyond max_pieces."""

    def __init__(self, path: str, max_pieces: int = 600_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, WhitespaceSplit

        self.whole = Tokenizer.from_file(path)
        self.model = Tokenizer(self.whole.model)
        self.model.pre_tokenizer = WhitespaceSplit()
        self.byte_letters = ByteLevel(add_prefix_space=False, use_regex=False)
        vocab = self.whole.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.max_pieces = max_pieces
        self.known: dict[str, bytes] = {}

    def _library(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, pieces: list[str]) -> None:
        """Encode new pre-tokens in one call; the last id of each ends a word, which no other id does."""
        if len(self.known) + len(pieces) > self.max_pieces:
            self.known = dict(islice(self.known.items(), self.max_pieces // 2))
        letters = [p if p.isascii() else self.byte_letters.pre_tokenize_str(p)[0][0] for p in pieces]
        ids = np.array(self.model.encode_batch_fast([" ".join(letters)], add_special_tokens=False)[0].ids, "<u4")
        cuts = [0, *((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()]
        if len(cuts) != len(pieces) + 1:
            raise ValueError("the tokenizer file has no end-of-word ids")
        packed = ids.tobytes()
        self.known.update(zip(pieces, (packed[a:b] for a, b in zip(cuts, cuts[1:]))))

    def encode(self, text: str) -> bytes:
        """The ids of a whole text."""
        if plain(text):
            return self.encode_pieces(pieces_of(text))
        return b"".join(self.encode_pieces(pieces_of(w)) if plain(w) else self._library(w) for w in _WORDS.findall(text))

    def encode_pieces(self, pieces: list[str]) -> bytes:
        known = self.known
        found = list(map(known.get, pieces))
        if None in found:
            gaps = [i for i, f in enumerate(found) if f is None]
            self.learn(list(dict.fromkeys([pieces[i] for i in gaps])))
            known = self.known  # may have been cut, but holds what was new
            for i in gaps:
                found[i] = known[pieces[i]]
        return b"".join(found)


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder of a file; its cache lives as long as the worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]

"""Token ids of a vocabulary file of the tokenizers library, with a cache of the pieces that white space separates.

The vocabularies here drop white space and cut words at it, so a text's ids are those of its pieces one after another.
"""

from __future__ import annotations

import array
import gc
import json
import unicodedata
from itertools import chain

import regex

#: Pieces that each of a worker's two generations of the cache holds; what isn't met in a generation is forgotten.
CACHE_PIECES = 100_000
_SPACE = regex.compile(r"\s+")
_TAIL = ".,!?;:|%$&*#-)\"'"


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(shown)))}


class WordTokens:
    """ids(text) as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        self.merge = self.model.model.tokenize  # the merges alone, for pieces that need nothing before them
        self.letters = _byte_letters()
        with open(path) as f:
            kinds = [x["type"] for x in json.load(f)["pre_tokenizer"]["pretokenizers"]]
        self.direct = kinds == ["Split", "ByteLevel"]  # letters stay together and are then spelled by bytes
        self.cache_pieces = cache_pieces
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array.array("I", e.ids).tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> None:
        """Ids of words that need nothing before the merges, into the cache."""
        merge, letters, ids, ends = self.merge, self.letters, [], []
        for w in words:
            ids += [t.id for t in merge(w if w.isascii() else w.encode().decode("latin-1").translate(letters))]
            ends.append(4 * len(ids))
        data, start, cache = array.array("I", ids).tobytes(), 0, self.cache
        for w, end in zip(words, ends, strict=True):
            cache[w] = data[start:end]
            start = end

    def learn(self, pieces: set[str]) -> None:
        """Put pieces into the cache; a word with punctuation behind it is two pieces, as the words pattern cuts there too."""
        new = pieces.difference(self.cache)
        if len(self.cache) + len(new) > self.cache_pieces:
            self.older, self.cache, new = self.cache, {}, pieces
        cache, older = self.cache, self.older
        known = new.intersection(older)
        cache |= {p: older[p] for p in known}
        rest, split, words = [], [], set()
        for p in new.difference(known):
            if p.isalpha():
                core = p
            else:
                core = p.rstrip(_TAIL)
                if not core.isalpha() or p[len(core)] == "'":
                    rest.append(p)
                    continue
                split.append((p, core))
            if self.direct and core.islower() and (core.isascii() or unicodedata.is_normalized("NFC", core)):
                words.add(core)
            else:
                rest.append(core)
        self._words(list(words.difference(cache)))
        rest = list({*rest, *(p[len(c) :] for p, c in split)}.difference(cache))
        cache |= zip(rest, self._encode(rest), strict=True)
        for p, core in split:
            cache[p] = cache[core] + cache[p[len(core) :]]

    def batch(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts. Pieces are lower-cased before the cache where that can't change what the model sees."""
        collecting = gc.isenabled()
        gc.disable()  # what follows makes no cycles, but more lists than the collector likes
        try:
            return self._batch(texts)
        finally:
            if collecting:
                gc.enable()

    def _batch(self, texts: list[str]) -> list[bytes]:
        cut = []
        for t in texts:
            # str.split() also cuts at 0x1C-0x1F, which the model doesn't; lower() has a special rule for capital sigma.
            odd = "\x1c" in t or "\x1d" in t or "\x1e" in t or "\x1f" in t or "\u03a3" in t
            cut.append(_SPACE.split(t) if odd else t.lower().split())
        self.learn(set(chain.from_iterable(cut)))
        find = self.cache.__getitem__
        return [b"".join(map(find, c)) for c in cut]


_loaded: dict[str, WordTokens] = {}


def load(path: str, cache_pieces: int = CACHE_PIECES) -> WordTokens:
    """One tokenizer a worker process."""
    if path not in _loaded:
        _loaded[path] = WordTokens(path)
    _loaded[path].cache_pieces = cache_pieces
    return _loaded[path]

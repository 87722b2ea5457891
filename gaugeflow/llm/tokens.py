"""Encoding whole texts with the tokenizers library.

The vocabulary's splitter never joins text across white space and lower-cases every text, so the ids of a text are
those of its white-space-separated words in order. Each worker keeps the library's ids of the words it has met;
a text that may hold one of the vocabulary's special strings goes to the library whole.
"""

from __future__ import annotations

import os
import re
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import kept_by

#: Words whose ids a worker keeps; words met later are encoded each time they occur.
MEMO_WORDS = 1_000_000
#: Words of one call to the library.
JOINED = 2000
#: Bytes of the texts whose words are columns at once; a longer text stands alone.
AT_ONCE = 2 << 20
PUNCTUATION = string.punctuation.encode()
#: Letters of ASCII and Latin-1 that are lower-case and composed already, so that normalizing leaves them as they are.
SETTLED = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch
_OPEN: dict[str, "WordTokenizer"] = {}


class WordTokenizer:
    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        # the same model, held once, on words that need no normalizing and no splitting but at white space
        self.settled = Tokenizer(self.library.model)
        self.settled.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.memo: dict[bytes, bytes] = {b"": b""}
        self.memo_words = memo_words
        self.closes = np.zeros(self.library.get_vocab_size() + 1, bool)
        for word, i in self.library.get_vocab().items():
            self.closes[i] = word.endswith("</w>")
        self.special = sorted({t.content[:2].lower().encode() for t in self.library.get_added_tokens_decoder().values()})

    def _direct(self, words: list[bytes]) -> list[bytes]:
        found = self.library.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def _letters(self, words: list[bytes], library) -> dict[bytes, bytes]:
        """Ids of words of letters alone. Each is one unit of the splitter and ends where an id closes a word, so many
        go to the library as one text."""
        out = {}
        for i in range(0, len(words), JOINED):
            some = words[i : i + JOINED]
            ids = np.array(library.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = (np.nonzero(self.closes[ids])[0] + 1) * 4
            if len(cuts) != len(some):
                out.update(zip(some, self._direct(some)))
                continue
            raw, cuts = ids.tobytes(), [0, *cuts.tolist()]
            out.update(zip(some, (raw[a:b] for a, b in zip(cuts, cuts[1:]))))
        return out

    def _new(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words that the memo lacks. ASCII punctuation after letters is a unit of its own, so these are encoded
        each by itself."""
        memo, cut, plain, settled, letters, direct, out = self.memo, {}, {}, [], [], [], {}
        for w in words:
            stem = w.rstrip(PUNCTUATION)
            if len(stem) < len(w) and stem and (SETTLED(stem) or stem[-1:].isalpha()):
                cut[w] = stem
                plain[stem] = plain[w[len(stem) :]] = None
            else:
                plain[w] = None
        for w in plain:
            if w not in memo:
                (settled if SETTLED(w) else letters if w.decode("utf-8", "replace").lower().isalpha() else direct).append(w)
        out |= self._letters(settled, self.settled)
        out |= self._letters(letters, self.library)
        out.update(zip(direct, self._direct(direct)))
        of = lambda w: out[w] if w in out else memo[w]
        for w, stem in cut.items():
            out[w] = of(stem) + of(w[len(stem) :])
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each UTF-8 text, as little-endian unsigned 32-bit integers."""
        out, i, size = [], 0, 0
        for j, t in enumerate(texts):
            if size and size + len(t) > AT_ONCE:
                out += self._batch(texts[i:j])
                i, size = j, 0
            size += len(t)
        return out + self._batch(texts[i:])

    def _batch(self, texts: list[bytes]) -> list[bytes]:
        """Words are told apart and laid out as columns; only those that differ are looked up."""
        low = [t.lower() for t in texts]  # ASCII only; the library lower-cases the rest
        whole = [i for i, t in enumerate(low) if any(s in t for s in self.special)]
        for i in whole:
            low[i] = b""
        lists = pc.ascii_split_whitespace(pa.array(low, pa.large_binary()).view(pa.large_string()))
        words = pc.dictionary_encode(lists.values)
        known = words.dictionary.view(pa.large_binary()).to_pylist()
        found = list(map(self.memo.get, known))
        new = [w for w, ids in zip(known, found) if ids is None]
        if new:
            more = self._new(new)
            if len(self.memo) + len(more) <= self.memo_words:
                self.memo.update(more)
            found = [more[w] if ids is None else ids for w, ids in zip(known, found)]
        ids = pa.array(found, pa.large_binary()).take(words.indices)
        _, bounds, data = ids.buffers()
        at = np.frombuffer(bounds, np.int64)[lists.offsets.to_numpy()].tolist() if len(ids) else [0] * (len(texts) + 1)
        raw = memoryview(data) if data is not None else b""
        out = [bytes(raw[a:b]) for a, b in zip(at, at[1:])]
        for i, got in zip(whole, self._direct([texts[i] for i in whole])):
            out[i] = got
        del lists, words, known, found, ids, data, raw
        pa.default_memory_pool().release_unused()
        return out


kept_by("tokens", _OPEN.clear)


def opened(path: str) -> WordTokenizer:
    """This worker's tokenizer for a vocabulary file, loaded once."""
    if path not in _OPEN:
        _OPEN[path] = WordTokenizer(path)
    return _OPEN[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")

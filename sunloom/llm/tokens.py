"""Token ids of whole texts by a ``tokenizers`` file, with the ids of words that recur kept in memory.

Both public vocabularies cut a text into words by a pattern before they merge, so a text's ids are its words' ids in
order. Texts of plain Latin characters are cut here by the same pattern and only words not seen before go to the
library's merges; a text with any other character, or with what may be a special token, goes through it whole. The
library's defaults hold: the string of a special token in a text is that token.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Callable

_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ſ"
_NUMBER = "0-9²³¹¼½¾"
_SPACE = " \t\n\r\xa0"
_ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
#: Characters for which the classes above agree with Unicode's and normalisation changes nothing but case.
_OTHER = re.compile("[^\t\n\r -~\xa0-įı-ſ‐-‧]")
#: By file: the pattern that cuts words, and whether case is folded first.
KINDS = {
    "byte_bpe_50k.json": (re.compile(f" ?[{_LETTER}]+| ?[{_NUMBER}]+|{_ENDINGS}| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"), False),
    "word_bpe_49k.json": (re.compile(f"[{_LETTER}]+|{_ENDINGS}|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+"), True),
}
#: Words kept in each of two generations, the longest that is kept, and characters cut into words at a time.
CACHE_WORDS, CACHE_CHARS, CHARS_AT_ONCE = 300_000, 64, 1 << 21
_loaded: dict[str, Encoder] = {}


def _byte_letters() -> str:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 stays, others follow U+0100."""
    rest = iter(range(256, 512))
    return "".join(chr(b if 33 <= b <= 126 or (161 <= b and b != 173) else next(rest)) for b in range(256))


_LETTERS = _byte_letters()


def _bytes(ids: list[int]) -> bytes:
    made = array("I", ids)
    if sys.byteorder == "big":
        made.byteswap()
    return made.tobytes()


class Words(dict):
    """Ids by word, in two generations: when the young one is full it becomes the old one, and a word of the old one that
    comes again moves to the young one, so words in use stay and memory is bounded."""

    def __init__(self, encode: Callable[[str], bytes]) -> None:
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.encode(word)
        if len(word) <= CACHE_CHARS:
            self[word] = ids
        return ids

    def age(self) -> None:
        if len(self) > CACHE_WORDS:
            self.old = dict(self)
            self.clear()


class Encoder:
    """Texts to ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        # What special tokens begin with; with nothing in common, every text goes through the library whole.
        self.special = os.path.commonprefix(specials)[:2].lower() if specials else None
        self.pattern, self.fold = KINDS.get(os.path.basename(path), (None, False))
        self.model = self.library.model
        self.words = Words(self._word)

    def _word(self, word: str) -> bytes:
        """Ids of one word as the pattern cuts it: straight to the vocabulary's merges."""
        if word.isascii() and word.isprintable():
            word = word.replace(" ", _LETTERS[32])
        else:
            word = word.encode().decode("latin-1").translate(_LETTERS)
        return _bytes([t.id for t in self.model.tokenize(word)])

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [_bytes(x.ids) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _cut(self, texts: list[str]) -> list[bytes]:
        self.words.age()
        get, find = self.words.__getitem__, self.pattern.findall
        return [b"".join(map(get, find(t.lower() if self.fold else t))) for t in texts]

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        out = [b""] * len(texts)
        whole = [k for k, t in enumerate(texts) if t and (self.pattern is None or _OTHER.search(t) or (self.special is not None and self.special in t))]
        for k in whole:
            out[k] = self._whole([texts[k]])[0]
        apart, part, size = set(whole), [], 0
        for k, t in enumerate(texts):
            if t and k not in apart:
                part.append(k)
                size += len(t)
            if part and (size >= CHARS_AT_ONCE or k == len(texts) - 1):
                for j, ids in zip(part, self._cut([texts[j] for j in part]), strict=True):
                    out[j] = ids
                part, size = [], 0
        return out


def encoder(path: str) -> Encoder:
    """One encoder per path and Python worker."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]

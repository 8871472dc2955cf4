"""Token ids of whole texts with the tokenizers library, each distinct word encoded once per worker.

Neither tokenizer used here has a token that reaches across certain places in a
text, so its ids are the ids of the parts between them, put together:

* word BPE drops white space and never joins across it: the parts are the words;
* byte BPE may start a token with one space, and a longer run of white space gives
  its last space to the word after it: the parts are words with that space, and
  what remains of white space.

New parts are encoded many at a time in one call and cut apart again. Most are
letters, perhaps with one mark after them: letters are one piece to either tokenizer's
pattern, so they are encoded without running the pattern, and the mark's ids follow.
Other parts take the tokenizer as it is, and are told apart by a marker between words,
or by the known byte length of every id.
"""

from __future__ import annotations

import os
import re
import unicodedata
from functools import lru_cache

import numpy as np

WORD_FILE = "word_bpe_49k.json"
BYTE_FILE = "byte_bpe_50k.json"

#: Distinct parts that a worker remembers, and those of a group of texts more; then it forgets all and goes on.
REMEMBERED = 800_000

# White space as the tokenizers' patterns have it (Unicode's White_Space).
_SPACE = "\\x09-\\x0d\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_PARTS = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_MARK = "\x01"
_MARKS = ".,;:!?"
_AT_ONCE = 256


def tokenizer_path(name: str) -> str:
    """A path is taken as it is; a bare name is one of the installed public files."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.letters = (Tokenizer.from_file(tokenizer_path(name)) for _ in range(2))
        self.tokenizer.encode_special_tokens = self.letters.encode_special_tokens = True
        self.letters.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.CharDelimiterSplit(_MARK), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.known: dict = {}
        self.words = self._ids("a b") == self._ids("a \n b")
        self.after = {c: np.array(self._ids("a" + c)[len(self._ids("a")) :], "<u4").tobytes() for c in _MARKS}
        # A byte-level token has one character for each byte; the word BPE's last token of a piece says so.
        vocabulary = self.tokenizer.get_vocab()
        self.size = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.size[i] = token.endswith("</w>") if self.words else len(token)
        mark = self._ids(_MARK)
        self.mark = mark[0] if len(mark) == 1 else None

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _alone(self, parts: list[str]) -> None:
        for p, e in zip(parts, self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)):
            self.known[p] = np.array(e.ids, "<u4").tobytes()

    def _one_piece(self, part: str) -> bool:
        """Whether a part is letters only, also after the word BPE's normalisation."""
        bare = part if self.words or part[:1] != " " else part[1:]
        if not bare.isalpha():
            return False
        return not self.words or bare.isascii() or (unicodedata.is_normalized("NFC", bare) and bare.lower().isalpha())

    def _cut(self, groups: list[list[str]], encoded: list, ends_of) -> None:
        """Remember the ids of each part of each group."""
        known = self.known
        for group, e in zip(groups, encoded):
            ids = np.array(e.ids, "<u4")
            starts, ends = ends_of(ids, group)
            if len(ends) != len(group):
                self._alone(group)
                continue
            raw = ids.tobytes()
            for p, s, t in zip(group, (4 * starts).tolist(), (4 * ends).tolist()):
                known[p] = raw[s:t]

    def _by_bytes(self, ids: np.ndarray, group: list[str], led: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each part's ids start and end; a part with ``led`` has one id before it."""
        lengths = np.array([len(p.encode("utf-8", "replace")) for p in group])
        ends = np.searchsorted(np.cumsum(self.size[ids]), np.cumsum(lengths + led), "left") + 1
        return np.append(0, ends[:-1]) + led, ends

    def _learn(self, parts: list[str]) -> None:
        bare, other, marked = set(), [], []
        for p in parts:
            core = p[:-1] if p[-1] in _MARKS else p
            if core and self._one_piece(core):
                bare.add(core)
                if core is not p:
                    marked.append(p)
            else:
                other.append(p)
        self._learn_letters(list(bare.difference(self.known)))
        for p in marked:
            self.known[p] = self.known[p[:-1]] + self.after[p[-1]]
        self._learn_others(other)

    def _learn_letters(self, parts: list[str]) -> None:
        groups = [parts[i : i + _AT_ONCE] for i in range(0, len(parts), _AT_ONCE)]
        encoded = self.letters.encode_batch_fast([_MARK.join(g) for g in groups], add_special_tokens=False)

        def ends_of(ids: np.ndarray, group: list[str]) -> tuple[np.ndarray, np.ndarray]:
            if not self.words:
                return self._by_bytes(ids, group, np.zeros(len(group), np.int64))
            ends = np.flatnonzero(self.size[ids]) + 1
            return np.append(0, ends[:-1]), ends

        self._cut(groups, encoded, ends_of)

    def _learn_others(self, parts: list[str]) -> None:
        odd = lambda p: _MARK in p or self.mark is None if self.words else p.isspace()
        self._alone([p for p in parts if odd(p)])
        plain = [p for p in parts if not odd(p)]
        groups = [plain[i : i + _AT_ONCE] for i in range(0, len(plain), _AT_ONCE)]
        if self.words:
            texts = [f" {_MARK} ".join(g) for g in groups]
        else:
            texts = ["".join(p if p[0] == " " else "\n" + p for p in g) for g in groups]

        def ends_of(ids: np.ndarray, group: list[str]) -> tuple[np.ndarray, np.ndarray]:
            if not self.words:
                return self._by_bytes(ids, group, np.array([p[0] != " " for p in group], np.int64))
            ends = np.append(np.flatnonzero(ids == self.mark), len(ids))
            return np.append(0, ends[:-1] + 1), ends

        self._cut(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), ends_of)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        split = re.compile(r"[^\x20\x09-\x0D]+").findall if self.words else _PARTS.findall
        if len(self.known) > REMEMBERED:
            self.known.clear()
        get = self.known.get
        found, new = [], set()
        for t in texts:
            parts = split(t)
            got = list(map(get, parts))
            missing = [(i, parts[i]) for i, g in enumerate(got) if g is None]
            new.update(p for _, p in missing)
            found.append((got, missing))
        if new:
            self._learn(list(new))
        for got, missing in found:
            for i, p in missing:
                got[i] = get(p)
        return [b"".join(got) for got, _ in found]


@lru_cache(maxsize=4)
def encoder(name: str) -> Encoder:
    """The encoder of a file, kept by the worker process."""
    return Encoder(name)


def text_groups(texts: list[str], chars: int = 4_000_000):
    """Runs of texts of about ``chars`` characters, so that work in memory has a bound; a longer text stands alone."""
    group, size = [], 0
    for t in texts:
        if group and size + len(t) > chars:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group

"""Token ids and character spans by the tokenizers library, each distinct word encoded once.

No token crosses the start of a word, so a text's ids are those of its words in order.  A worker
keeps the ids of the words it has met; of a new word, only runs of letters or marks not met before
reach the library's model.  Texts with any white space but single blanks and line ends, and words
beyond Latin-1 that are not all letters, go through the whole library.
"""

from __future__ import annotations

import os
import string
import sys
import unicodedata
from array import array
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: White space that is more than one character long, or neither a blank nor a line end.
_UNUSUAL = ("  ", "\n\n", " \n", "\n ", *filter(str.isspace, map(chr, set(range(0x3001)) - {10, 32})))
_UNUSUAL_ASCII = tuple(s for s in _UNUSUAL if s.isascii())
#: How the two kinds of vocabulary cut a word into runs.
_RUNS = {
    True: regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"),
    False: regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"),
}
#: What often ends a word; together a run of its own.
_ENDS = string.punctuation
#: New words, and their characters, a memory takes up before it drops those not met since the last
#: time.
WORDS_KEPT, CHARACTERS_KEPT = 400_000, 8_000_000
#: Characters of the texts whose words are looked up together, unless one text has more, and the words
#: whose ids are put in place at once.
_GROUP, _GATHERED = 1 << 22, 1 << 18


class Memory(dict):
    """What ``find`` gives for the words met lately; asks ``before`` for those met before that."""

    def __init__(self, find: Callable[[str], bytes], before: Memory | None = None):
        self.find, self.before, self.characters = find, before, 0

    def __missing__(self, word: str) -> bytes:
        found = self.before.get(word) if self.before is not None else None
        if found is None:
            found = self.find(word)
        self[word] = found
        self.characters += len(word)
        return found

    def renewed(self) -> Memory:
        """Itself, or once it is full a new one that still remembers it, but nothing older."""
        if len(self) <= WORDS_KEPT and self.characters <= CHARACTERS_KEPT:
            return self
        self.before = None
        return Memory(self.find, self)


def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(rest)}


_BYTE_LETTERS = _byte_letters()


class WordEncoder:
    """Encodes texts with one tokenizer file.

    ``blanks_count``: the vocabulary joins a blank to the word after it (byte-level BPE, capitals
    kept); otherwise white space only separates words, and capitals become small.  ``end_id`` is
    appended to every text unless it is None.
    """

    def __init__(self, path: str, blanks_count: bool, end_id: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.model, self.blanks_count = self.library.model, blanks_count
        size = self.library.get_vocab_size()
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.end = b"" if end_id is None else self._raw([end_id])
        #: How many bytes of text each id stands for.
        self.widths = np.array([len(self.library.id_to_token(i) or "") for i in range(size)], np.int64)
        self.after_blank = Memory(lambda word: self._word_ids(word, " "))
        self.at_start = Memory(lambda word: self._word_ids(word, ""))
        self.runs: dict[str, bytes] = {}
        self.newline = self._library_ids("\n")

    def _raw(self, ids: list[int]) -> bytes:
        out = array("H" if self.kind.itemsize == 2 else "I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _library_ids(self, text: str) -> bytes:
        return self._raw(self.library.encode(text, add_special_tokens=False).ids)

    def _run_ids(self, run: str) -> bytes:
        shown = run.encode().decode("latin-1").translate(_BYTE_LETTERS)
        return self._raw([t.id for t in self.model.tokenize(shown)])

    def _word_ids(self, word: str, before: str) -> bytes:
        """The ids of one word without white space (it may be empty), with ``before`` in front."""
        plain = word if self.blanks_count else word.lower()
        if word.isascii():
            if word.isalpha():
                shown = "Ġ" + plain if before else plain
                return self._raw([t.id for t in self.model.tokenize(shown)])
        elif plain.isalpha() and word.isalpha():
            # A small sigma depends on its place.
            if "Σ" not in word and unicodedata.is_normalized("NFC", word):
                return self._run_ids(before + plain)
        if not plain.isascii() and max(plain) > "ÿ":
            return self._library_ids(before + word)
        letters = plain.rstrip(_ENDS)
        if letters.isalpha() and letters != plain:
            known = (self.after_blank if before else self.at_start).get(letters)
            if known is None:
                known = self._word_ids(letters, before)
            return known + self._known_run(plain[len(letters) :])
        return b"".join([self._known_run(run) for run in _RUNS[self.blanks_count].findall(before + plain)])

    def _known_run(self, run: str) -> bytes:
        if (ids := self.runs.get(run)) is None:
            if len(self.runs) > WORDS_KEPT:
                self.runs.clear()
            ids = self.runs[run] = self._run_ids(run)
        return ids

    def _whole(self, text: str) -> bool:
        """Whether a text holds one of the vocabulary's special tokens, which only the library finds."""
        return any(s in text for s in self.special)

    def ids(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as ``kind`` integers, the end id last."""
        self.at_start, self.after_blank = self.at_start.renewed(), self.after_blank.renewed()
        if not self.blanks_count:
            return self._separated(texts)
        known, start, newline = self.after_blank.__getitem__, self.at_start, self.newline
        out = []
        for text in texts:
            if _unusual(text) or self._whole(text):
                out.append(self._library_ids(text) + self.end)
                continue
            parts = []
            for line in text.split("\n"):
                first, *words = line.split(" ")
                parts.append(newline)
                parts.append(start[first])
                parts += map(known, words)
            parts.append(self.end)
            out.append(b"".join(parts[1:]))
        return out

    def _separated(self, texts: list[str]) -> list[bytes]:
        """The texts in groups, each distinct word of a group looked up once."""
        out: list[bytes] = [b""] * len(texts)
        plain: list[tuple[int, str]] = []
        size = 0
        for n, text in enumerate(texts):
            # The library's white space does not include the four separators that str.split knows.
            if any(c in text for c in "\x1c\x1d\x1e\x1f") or self._whole(text):
                out[n] = self._library_ids(text) + self.end
                continue
            if plain and size + len(text) > _GROUP:
                self._grouped(plain, out)
                plain, size = [], 0
            plain.append((n, _small(text)))
            size += len(text)
        if plain:
            self._grouped(plain, out)
        return out

    def _grouped(self, plain: list[tuple[int, str]], out: list[bytes]) -> None:
        """Put the ids of each text into its place of ``out``."""
        split = pc.utf8_split_whitespace(pa.array([text for _, text in plain], pa.large_string()))
        words = split.flatten().dictionary_encode()
        found = list(map(self.at_start.__getitem__, words.dictionary.to_numpy(zero_copy_only=False)))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // self.kind.itemsize
        flat, firsts = np.frombuffer(b"".join(found), self.kind), np.cumsum(sizes) - sizes
        codes, offsets = words.indices.to_numpy(), split.offsets.to_numpy()
        first = 0
        parts: list[list[bytes]] = [[] for _ in plain]
        while first < len(plain):  # a text's words in stretches, texts of few words together
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + _GATHERED, "right")) - 1)
            for at in range(offsets[first], max(offsets[last], offsets[first] + 1), _GATHERED):
                own = codes[at : min(at + _GATHERED, offsets[last])]
                lengths = sizes[own]
                ends = np.append(0, np.cumsum(lengths))
                raw = flat[np.arange(ends[-1]) + np.repeat(firsts[own] - ends[:-1], lengths)].tobytes()
                cuts = ends[np.clip(offsets[first : last + 1] - at, 0, len(own))] * self.kind.itemsize
                for n, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist()), first):
                    parts[n].append(raw[a:b])
            first = last
        for (n, _), own in zip(plain, parts):
            out[n] = b"".join([*own, self.end])

    def ids_and_spans(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Each text's ids, and rows of first and last-plus-one character, without the end id; for
        vocabularies in which blanks count, whose ids spell the text byte by byte.  Ids that share a
        character have it in both spans."""
        out = []
        for text, raw in zip(texts, self.ids(texts)):
            ids = np.frombuffer(raw[: len(raw) - len(self.end)], self.kind)
            ends = np.cumsum(self.widths[ids])
            starts = np.append(0, ends[:-1])[: len(ends)]
            if not text.isascii():
                lead = np.frombuffer(text.encode(), np.uint8) & 0xC0 != 0x80
                character = np.cumsum(lead) - 1
                starts, ends = character[starts], character[ends - 1] + 1
            out.append((ids, np.stack([starts, ends], axis=1)))
        return out


def _unusual(text: str) -> bool:
    return any(s in text for s in (_UNUSUAL_ASCII if text.isascii() else _UNUSUAL))


def _small(text: str) -> str:
    """The text with small letters where that commutes with what the library does: in Latin-1."""
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
    return text.lower()


@cache
def encoder(path: str, blanks_count: bool, end_id: int | None = None) -> WordEncoder:
    """One encoder per worker and setting, with the words it has met."""
    return WordEncoder(path, blanks_count, end_id)


def decoded(texts: list[bytes]) -> list[str]:
    return [t.decode() for t in texts]

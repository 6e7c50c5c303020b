"""Token ids of a public BPE vocabulary, as bytes, with a word cache in each Python worker.

The vocabulary's splitter never joins what white space separates, so a text's ids are those of its words in a row.
A word is looked up in the worker's cache; what is missing is encoded by the tokenizers library. ``encode_all`` looks up the words of many
texts at once in a hash table of NumPy rows, each with the word's own bytes, so that words are told apart exactly. A word of letters, which
the vocabulary's normaliser and splitter would leave whole, goes to the library's BPE model directly. A word of printable ASCII
and Latin letters is cut as the splitter would cut it, and its pieces, most of them letters or marks met before, are looked up.
"""

from __future__ import annotations

import os
import re
from array import array
from codecs import charmap_decode
from functools import lru_cache

import numpy as np

VOCABULARY = "word_bpe_49k.json"

_WORD_CACHE = 350_000  # entries of a worker in each of two ages; words not met for an age are forgotten
#: Lower-cased words of these characters are left as they are by the normaliser, and cut by the splitter as by _PIECES.
_PLAIN = re.compile("[!-~à-öø-ÿ]+")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+")
_SHORT = 23  # longest word of the table in bytes; the 24th byte of a key is the word's length
_TABLE_WORDS = 1 << 20  # words after which a worker's table is begun anew
_TEXTS = 1 << 20  # bytes of texts that are looked up together; longer texts go through the cache word by word
_WHITE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
# 0 for ASCII letters, 1 for ASCII marks, far more than a text has bytes for others
_WEIGHT = np.array([0 if bytes([x]).isalpha() else 1 if 32 < x < 127 and not 48 <= x < 58 else 1 << 32 for x in range(256)])
_LATIN = np.isin(np.arange(256), [x for x in range(0xA0, 0xC0) if x != 0xB7])  # second bytes of the letters from à to ÿ
# what a key's three numbers keep of the eight bytes that each was read from, by the length of the word
_KEEP = np.array([[(1 << 8 * min(max(n - 8 * i, 0), 8)) - 1 for n in range(_SHORT + 1)] for i in range(3)], np.uint64)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def byte_letters() -> dict[int, str]:
    """The usual printable stand-ins of byte-level BPE: printable bytes stand for themselves, others for 256 and up."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Table:
    """Words of up to 23 bytes -> where their ids lie in ``pool`` and how many there are; open addressing."""

    def __init__(self, bits: int = 16) -> None:
        self.bits = bits
        self.rows = np.zeros((1 << bits, 4), np.uint64)  # key; place in the pool * 2 ** 16 + number of ids + 1, 0 if free
        self.pool = np.zeros(1 << 16, np.uint32)
        self.words = self.used = 0

    def put(self, ids: np.ndarray, at: int) -> None:
        if at + len(ids) > len(self.pool):
            self.pool = np.append(self.pool, np.zeros(max(len(self.pool), len(ids)), np.uint32))
        self.pool[at:at + len(ids)] = ids

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The last number of each key's row, 0 where the word is not known."""
        at = self._slots(keys)
        row = self.rows.take(at, axis=0)
        out = row[:, 3].copy()
        todo = np.flatnonzero((out != 0) & ((row[:, 0] != keys[0]) | (row[:, 1] != keys[1]) | (row[:, 2] != keys[2])))
        at = at[todo]
        while len(todo):
            at = at + 1 & len(self.rows) - 1
            row, (a, b, c) = self.rows[at], keys[:, todo]
            out[todo] = row[:, 3]
            more = np.flatnonzero((row[:, 3] != 0) & ((row[:, 0] != a) | (row[:, 1] != b) | (row[:, 2] != c)))
            todo, at = todo[more], at[more]
        return out

    def add(self, keys: np.ndarray, places: np.ndarray) -> None:
        """Adds different words that are not yet there."""
        self.words += len(places)
        if self.words * 2 > len(self.rows):
            old = self.rows[self.rows[:, 3] != 0]
            keys, places = np.concatenate([old[:, :3].T, keys], axis=1), np.append(old[:, 3], places)
            self.bits = (self.words * 2).bit_length()
            self.rows = np.zeros((1 << self.bits, 4), np.uint64)
        at = self._slots(keys)
        rows = np.concatenate([keys, places[None]]).T
        while len(rows):
            free = self.rows[at, 3] == 0
            self.rows[at[free]] = rows[free]
            left = np.flatnonzero(self.rows[at, 3] != rows[:, 3])  # of several words for a free row one stays
            rows, at = rows[left], at[left] + 1 & len(self.rows) - 1

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys[0] * _MIX[0] + keys[1] * _MIX[1] + keys[2] * _MIX[2] >> np.uint64(64 - self.bits)).astype(np.int64)


def _cut(body: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words begin and stop in a text with white space around it, and the weight before each byte, which grows behind letters only.

    The marks behind a word of letters are a word by themselves: the splitter parts them, and no special string begins with a letter.
    """
    white = _WHITE[body]
    turns = np.flatnonzero(white[1:] != white[:-1]) + 1
    begin, stop = turns[::2], turns[1::2]
    weight = _WEIGHT[body]
    latin = np.flatnonzero(body[:-1] == 0xC3)
    latin = latin[_LATIN[body[latin + 1]]]
    weight[latin] = weight[latin + 1] = 0
    before = np.append(0, np.cumsum(weight))
    marks = before[stop] - before[begin]
    last = np.flatnonzero((marks > 0) & (marks < stop - begin))
    tail = stop[last] - marks[last]
    whole = before[tail] == before[begin[last]]
    last, tail = last[whole], tail[whole]
    return np.insert(begin, last + 1, tail), np.insert(stop, last, tail), before


class WordIds(dict):
    """Word (bytes) -> little-endian unsigned 32-bit ids (bytes)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        super().__init__()
        self.older: dict[bytes, bytes] = {}
        self.table = _Table()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.spelled = "".join(self.letters[i] for i in range(256))
        self.digits = {x: self._piece(chr(x)) for x in b"0123456789"}  # the splitter takes each by itself

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, coded: str) -> bytes:
        """Ids of a lower-case piece that the splitter leaves whole, spelled in the vocabulary's stand-ins for bytes."""
        return array("I", [t.id for t in self.model.tokenize(coded)]).tobytes()

    def __missing__(self, word: bytes) -> bytes:
        found = self.older.get(word)
        if found is None:
            if word.isalpha():  # ASCII letters stand for themselves
                found = self._piece(word.lower().decode())
            else:
                found = self._new(word)
        self[word] = found
        return found

    def _new(self, word: bytes) -> bytes:
        if word.isdigit():
            return b"".join([self.digits[x] for x in word])
        tail = word[-1:]
        if (tail == b"." or tail == b",") and word[:-1].isalpha():
            return self[word[:-1]] + self[tail]
        text = word.decode()
        lower = text.lower()
        if "<|" in text or not _PLAIN.fullmatch(lower):
            return self._encode(text)
        pieces = _PIECES.findall(lower)
        if len(pieces) == 1:
            return self._piece("".join(map(self.letters.__getitem__, lower.encode())))
        return b"".join([self[x.encode()] for x in pieces])

    def age(self) -> None:
        """Starts a new age once the cache is full."""
        if len(self) > _WORD_CACHE:
            self.older = dict(self)
            self.clear()

    def encode_all(self, texts: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts, ``end`` behind each, and how many each has."""
        made, some, size = [(np.zeros(0, np.uint32), np.zeros(0, np.int64))], [], 0
        for text in texts:
            if len(text) > _TEXTS:
                if some:
                    made.append(self._looked_up(some, end))
                made.append(self._one(text, end))
                some, size = [], 0
                continue
            if size + len(text) > _TEXTS:
                made.append(self._looked_up(some, end))
                some, size = [], 0
            some.append(text)
            size += len(text)
        if some:
            made.append(self._looked_up(some, end))
        ids, counts = zip(*made)
        return np.concatenate(ids), np.concatenate(counts)

    def _one(self, text: bytes, end: int) -> tuple[np.ndarray, np.ndarray]:
        ids = np.append(np.frombuffer(self.encode(text), "<u4"), np.uint32(end))
        return ids, np.array([len(ids)])

    def _looked_up(self, texts: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray]:
        self.age()
        if self.table.words > _TABLE_WORDS:
            self.table = _Table()
        table = self.table
        texts = [x if b"<|" in x else x.lower() for x in texts]  # the special strings are lower case only
        body = b" ".join([b"", *texts, b" " * 24])
        begin, stop, weight = _cut(np.frombuffer(body, np.uint8))
        n = stop - begin
        n[n > _SHORT] = 0  # a key of zeros is in no table
        eights = np.ndarray(len(body) - 7, "<u8", body, strides=(1,))
        keys = np.stack([eights[begin + 8 * i] & _KEEP[i][n] for i in range(3)])
        keys[2] |= n.astype(np.uint64) << np.uint64(56)
        places = table.find(keys)

        new = np.flatnonzero((places == 0) & (n > 0))
        if len(new):
            words = [body[b:e] for b, e in zip(begin[new].tolist(), stop[new].tolist())]
            plain = (weight[begin[new]] == weight[stop[new]]).tolist()
            ids_of = {word: self._letters(word) if own else self._new(word) for word, own in dict(zip(words, plain)).items()}
            count = np.fromiter(map(len, ids_of.values()), np.int64, len(ids_of)) // 4
            upto = table.used + np.cumsum(count)
            table.put(np.frombuffer(b"".join(ids_of.values()), "<u4"), table.used)
            table.used = int(upto[-1])
            place_of = dict(zip(ids_of, ((upto - count << 16) + count + 1).tolist()))
            places[new] = np.fromiter(map(place_of.__getitem__, words), np.uint64, len(words))
            first = new[np.unique(places[new], return_index=True)[1]]
            table.add(keys[:, first], places[first])

        at, count = (places >> np.uint64(16)).astype(np.int64), (places & np.uint64(0xFFFF)).astype(np.int64) - 1
        free = table.used  # ids that the table does not keep: the end, then words too long for a key
        long = np.flatnonzero(n == 0)
        others = [np.frombuffer(self[body[b:e]], "<u4") for b, e in zip(begin[long].tolist(), stop[long].tolist())]
        table.put(np.concatenate([np.array([end], np.uint32), *others]), free)
        count[long] = [len(x) for x in others]
        at[long] = free + 1 + np.cumsum(count[long]) - count[long]
        ends = np.searchsorted(begin, np.cumsum([len(x) + 1 for x in texts]))  # the number of words up to the end of each text
        at, count = np.insert(at, ends, free), np.insert(count, ends, 1)
        upto = np.cumsum(count)
        ids = table.pool[np.repeat(at - upto + count, count) + np.arange(upto[-1])]
        return ids, np.diff(upto[ends + np.arange(len(ends))], prepend=0)

    def _letters(self, word: bytes) -> bytes:
        """Ids of a word of ASCII letters and the lower-case ones from à to ÿ, which normaliser and splitter leave whole."""
        return self._piece(charmap_decode(word.lower(), "strict", self.spelled)[0])

    def encode(self, text: bytes) -> bytes:
        """Ids of a whole text."""
        return b"".join(self.words(text))

    def words(self, text: bytes) -> list[bytes]:
        """Ids of each word of a text."""
        self.age()
        if b"<|" not in text:  # the special strings are lower case only
            text = text.lower()
        return list(map(self.__getitem__, text.split()))


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One cache for each worker process and vocabulary file."""
    return WordIds(path)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)

"""Token ids by the tokenizers library, each distinct word encoded once for each worker.

A byte-level BPE splits text into words before it merges, and a new word begins at every space
that stands between two characters that are not white space, and at every newline that does. So a
text can be cut there and the ids of its units joined; they are those of the whole text. Stops after
a letter or digit are words of their own, so they are cut off too. Most of what is left repeats: the
units of a batch of texts are numbered by Arrow, and a bounded memo holds the ids of their parts.
"""

from __future__ import annotations

import re
import sys
from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

VOCABULARY = "byte_bpe_50k.json"
#: Parts longer than this are encoded each time; a memo holds so many parts, and when it is full the half used last.
MEMO_CHARS, MEMO_ENTRIES = 40, 1_000_000
RUN = re.compile(r"\s\s")
CUT = re.compile(r"(?<=\S)(?= \S)")
#: What stands between units while Arrow cuts texts; a text that holds it is cut by itself.
MARK = "\x00"
#: The white space of RUN, and MARK, for Arrow, whose \\s is ASCII alone.
BY_ITSELF = "[\t-\r\x1c- \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{2}|\\x00"
#: Stops, and what a word ends with if stops after it are a word of their own.
STOPS, ENDS = ".,;:!?", "[A-Za-z0-9À-ÖØ-öø-ÿ]$"
#: A word of letters; what follows it, unless a letter, is a word of its own.
WORD = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")

#: The characters of byte-level BPE: bytes that print stand for themselves, the others for characters from 256 on.
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in PRINTED)}


def pack(ids: list[int]) -> bytes:
    out = array("I", ids)  # unsigned, of four bytes
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class _Memo:
    """Parts of texts with their ids, one after the other in ``ids`` from ``starts`` on; the empty part comes first."""

    def __init__(self, tokenizer: Tokenizer) -> None:
        self.encode, self.tokenize = tokenizer.encode, tokenizer.model.tokenize
        self.parts = pa.array([""], pa.large_string())
        self.ids, self.starts = np.zeros(0, "<u4"), np.zeros(2, np.int64)
        self.used, self.now = np.zeros(1, np.int64), 0

    def encoded(self, part: str) -> bytes:
        spaced = part[0] == " "
        word = part[spaced:]
        if word.isascii() and word.isalpha():  # a word by itself needs no cutting
            return pack([t.id for t in self.tokenize("Ġ" * spaced + word)])
        if WORD.fullmatch(word):  # nor does one with other letters of Latin-1, by its bytes
            return pack([t.id for t in self.tokenize("Ġ" * spaced + word.encode().decode("latin-1").translate(BYTES))])
        return pack(self.encode(part, add_special_tokens=False).ids)

    def places(self, parts: pa.Array) -> np.ndarray:
        """Where each of different ``parts`` stands; they stay there until ``bound`` is called."""
        at = pc.index_in(parts, value_set=self.parts)
        fresh = parts.filter(at.is_null())
        found = [self.encoded(p) for p in fresh.to_pylist()]
        places = at.fill_null(-1).to_numpy()
        new = places < 0
        places = np.where(new, len(self.parts) + np.cumsum(new) - 1, places)
        self.now += 1
        if found:
            lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
            self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(found), "<u4")])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])
            self.parts = pa.concat_arrays([self.parts, fresh])
            self.used = np.concatenate([self.used, np.zeros(len(found), np.int64)])
        self.used[places] = self.now
        return places

    def bound(self) -> None:
        """Leave out parts that are long and, where there are too many, those that were not used lately."""
        kept = pc.utf8_length(self.parts).to_numpy() <= MEMO_CHARS
        if len(kept) > MEMO_ENTRIES:
            last = np.partition(self.used, len(kept) - MEMO_ENTRIES // 2)[len(kept) - MEMO_ENTRIES // 2]
            kept &= self.used > last
        kept[0] = True
        if not kept.all():
            at = np.flatnonzero(kept)
            self.parts, self.used = self.parts.take(pa.array(at)), self.used[at]
            self.ids, self.starts = gathered(self.ids, self.starts, at)


def gathered(ids: np.ndarray, starts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs number ``at`` of ``ids``, which begin at ``starts``, one after the other, and where they begin there."""
    lengths = starts[at + 1] - starts[at]
    begin = np.append(0, np.cumsum(lengths))
    return ids[np.repeat(starts[at] - begin[:-1], lengths) + np.arange(begin[-1])], begin


def units(texts: pa.Array) -> pa.Array:
    """Lists of the pieces of texts that can be encoded one by one."""
    alone = pc.match_substring_regex(texts, BY_ITSELF)
    marked = pc.replace_substring(pc.replace_substring(pc.if_else(alone, pa.scalar("", texts.type), texts), " ", MARK + " "), "\n", f"{MARK}\n{MARK}")
    cut = pc.split_pattern(marked, MARK)
    if not alone.true_count:
        return cut
    own = pa.array([CUT.split(t) for t in texts.filter(alone).to_pylist()], cut.type)
    other = alone.to_numpy(zero_copy_only=False)
    return pa.concat_arrays([cut, own]).take(pa.array(np.where(other, len(texts) + np.cumsum(other) - 1, np.arange(len(texts)))))


def parted(words: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Units without the stops at their end, and these; nothing where they cannot be cut off."""
    bare = pc.utf8_rtrim(words, characters=STOPS)
    ends = pc.match_substring_regex(bare, ENDS)
    size, left = (pc.binary_length(x).to_numpy() for x in (words, bare))
    _, where, data = words.buffers()
    where = np.frombuffer(where, np.int64)[words.offset : words.offset + len(words) + 1]
    begin = np.where(ends.to_numpy(zero_copy_only=False), where[:-1] + left, where[1:])
    letters, offsets = gathered(np.frombuffer(data or b"", np.uint8), np.stack([begin, where[1:]], axis=1).ravel(), 2 * np.arange(len(words)))
    return pc.if_else(ends, bare, words), pa.Array.from_buffers(words.type, len(words), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])


class Encoder:
    def __init__(self, path: str) -> None:
        tokenizer = Tokenizer.from_file(path)
        self.first = self.spaced = _Memo(tokenizer)  # of units at the beginning of a line and after a space, which these hold
        self.vocabulary = tokenizer.get_vocab_size()

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of whole texts, one after the other, and where each begins and the last one ends; a null text has none."""
        lists = units(pc.fill_null(texts.cast(pa.large_string()), ""))
        coded = lists.flatten().dictionary_encode()
        words, stops = parted(coded.dictionary)
        parts = pa.concat_arrays([words, stops]).dictionary_encode()
        memo = self.first
        both = memo.places(parts.dictionary)[parts.indices.to_numpy()].reshape(2, -1).T  # of each unit, its word and its stops
        ids, begin = gathered(memo.ids, memo.starts, both[coded.indices.to_numpy()].ravel())
        memo.bound()
        ends = np.cumsum(pc.list_value_length(lists).to_numpy())
        return ids, begin[np.concatenate([[0], 2 * ends])]

    def __call__(self, text: str | None) -> bytes:
        """The ids of a whole text, four bytes each; none for null."""
        return self.batch(pa.array([text], pa.large_string()))[0].tobytes()


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """The worker's encoder for the vocabulary file at ``path``."""
    return Encoder(path)


def vocabulary_path(name: str = VOCABULARY) -> str:
    return public_tokenizers.path(name)

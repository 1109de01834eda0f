"""Whole texts to token ids with the tokenizers library, each distinct piece encoded once.

Both public vocabularies split a text into pretokens ahead of the merges. A piece that is cut where a pretoken ends has
the ids that it has in the whole text, so pieces are encoded once and looked up after that:

* ``words``: for vocabularies that drop white space (word ends are part of the ids), at white space;
* ``spaces``: for byte-level vocabularies, ahead of a single space between two characters that aren't white space: there
  the pretoken ends and ``" word"`` begins. Texts with other runs of white space are cut one by one.

Defined cases: an empty text has its end id alone (callers put empty texts in place of null ones); repeated texts and
pieces have the same ids; texts of any length are encoded whole; no texts give no ids. Ids that don't fit the given type raise.
"""

from __future__ import annotations

import os
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from sluice.llm.common import keeps

#: Pieces held by a worker; beyond, those of the last slice stay.
HELD = 300_000
#: Bytes of text to encode at once: the more, the fewer distinct pieces in all.
SLICE = 8 << 20
#: Characters of a piece that is held.
PIECE = 64
#: Marks that may follow a word; none is a letter, a number or white space to a vocabulary.
MARKS = ",.!?;:#$%&*|"
#: Pieces that are encoded at once.
TOGETHER = 512

_HELD: dict[tuple[str, str], Pieces] = {}
keeps("tokens", _HELD.clear)


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, np.uint32).tobytes()


class Pieces(dict):
    """Ids of a piece as packed 32-bit integers.

    Pieces that aren't held are encoded many at once, in one text in which they stand apart as they do in documents;
    the bytes that each id stands for tell where a piece ends. Where they don't add up, pieces are encoded one by one.
    """

    def __init__(self, path: str, split: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.gap = Tokenizer.from_file(path), "" if split == "spaces" else "\n"
        self.encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.width[i] = len(token.removesuffix("</w>") if self.gap else token)

    def learn(self, wanted: Wanted, alone: Iterable[str] = ()) -> None:
        """Encodes those of the pieces that aren't held; alone: those that don't keep apart in a text."""
        alone = {x for x in alone if x not in self}
        together = dict.fromkeys(x for x in compress(wanted.pieces, wanted.letters) if x not in self)
        compound = []
        # Letters and the marks after them are pretokens of their own.
        for x, n in zip(compress(wanted.pieces, wanted.marked), wanted.stems, strict=True):
            if x not in self:
                compound.append((x, x[:n], x[n:]))
                together[x[:n]] = None
                alone.add(x[n:])
        for x in compress(wanted.pieces, wanted.others):
            if x not in self:
                if self.gap and (not x or not x.isascii() and x.split() != [x]):
                    alone.add(x)  # white space within a piece would hide where it ends
                else:
                    together[x] = None
        missing = [x for x in together if x not in self]
        for a in range(0, len(missing), TOGETHER):
            self._learn(missing[a : a + TOGETHER])
        if missing := [x for x in alone if x not in self]:
            self.update((x, _packed(e.ids)) for x, e in zip(missing, self.encode(missing, add_special_tokens=False), strict=True))
        for x, stem, marks in compound:
            self[x] = self[stem] + self[marks]

    def _learn(self, missing: list[str]) -> None:
        text, parts = self.gap.join(missing), missing
        if self.gap:
            parts = self.tokenizer.normalizer.normalize_str(text).split(" ")
        ids = self.encode([text], add_special_tokens=False)[0].ids
        ends, goals = np.cumsum(self.width[ids]), np.cumsum([len(x.encode()) for x in parts])
        at = np.searchsorted(ends, goals)
        if len(parts) == len(missing) and len(ids) and at[-1] == len(ids) - 1 and (ends[at] == goals).all():
            stops, raw = (4 * at + 4).tolist(), _packed(ids)
            self.update((x, raw[a:b]) for x, a, b in zip(missing, [0, *stops[:-1]], stops, strict=True))
        else:
            self.update((x, _packed(e.ids)) for x, e in zip(missing, self.encode(missing, add_special_tokens=False), strict=True))

    def forget(self, used: list[str], ids: list[bytes]) -> None:
        """Long pieces go, and all that weren't used if there are too many."""
        if len(self) >= HELD:
            self.clear()
            self.update(zip(used, ids, strict=True))
        for x in [x for x in used if len(x) > PIECE]:
            self.pop(x, None)


def pieces(path: str, split: str) -> Pieces:
    """The table of this process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    if (path, split) not in _HELD:
        _HELD[path, split] = Pieces(path, split)
    return _HELD[path, split]


def by_spaces(text: str) -> list[str]:
    """Pieces of a text with runs of white space."""
    parts = text.split(" ")
    out, last = [parts[0]], parts[0]
    for part in parts[1:]:
        if part and last and not part[0].isspace() and not last[-1].isspace():
            out.append(" " + part)
        else:
            out[-1] += " " + part
        last = part
    return out


#: White space that is ASCII, at a part's ends.
_ASCII_EDGE = r"^[\x09-\x0D\x1C-\x20]|[\x09-\x0D\x1C-\x20]$"


def _plain(parts: pa.Array) -> np.ndarray:
    """Which parts have characters, and none at their ends that is white space."""
    out = pc.and_not(pc.not_equal(parts, ""), pc.match_substring_regex(parts, _ASCII_EDGE)).to_numpy(zero_copy_only=False).copy()
    other = np.flatnonzero(~pc.string_is_ascii(parts).to_numpy(zero_copy_only=False))
    for i, x in zip(other.tolist(), parts.take(pa.array(other)).to_pylist(), strict=True):
        out[i] = not x[0].isspace() and not x[-1].isspace()
    return out


@dataclass
class Wanted:
    """Pieces that keep apart: which are letters alone, and which letters with marks behind them, from so many characters on."""

    pieces: list[str]
    letters: list[bool]
    marked: list[bool]
    others: list[bool]
    stems: list[int]


def _wanted(pieces: list[str], parts: pa.Array, ahead: int) -> Wanted:
    """parts: the pieces without the ``ahead`` characters that they begin with."""
    stems = pc.utf8_rtrim(parts, characters=MARKS)
    size = pc.utf8_length(stems).to_numpy(zero_copy_only=False) + ahead
    letters = pc.utf8_is_alpha(parts).to_numpy(zero_copy_only=False)
    marked = pc.utf8_is_alpha(stems).to_numpy(zero_copy_only=False) & ~letters & (pc.utf8_length(parts).to_numpy(zero_copy_only=False) + ahead <= PIECE)
    return Wanted(pieces, letters.tolist(), marked.tolist(), (~letters & ~marked).tolist(), size[marked].tolist())


def _cut(texts: pa.Array, split: str) -> tuple[np.ndarray, np.ndarray, Wanted, list[str]]:
    """Offsets of each text's pieces, their numbers, and the distinct pieces: those that keep apart, and the others."""
    if split == "words":
        # These vocabularies lower-case; only special tokens, which have "<|", tell cases apart.
        special = pc.any(pc.match_substring(texts, "<|")).as_py()
        lists = pc.ascii_split_whitespace(texts if special else pc.ascii_lower(texts))
    elif split == "spaces":
        lists = pc.split_pattern(texts, " ")
    else:
        raise ValueError(f"no such split: {split}")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    coded = lists.flatten().dictionary_encode()
    index, parts = coded.indices.to_numpy().copy(), coded.dictionary
    if split == "words":
        return offsets, index, _wanted(parts.to_pylist(), parts, 0), []
    plain = _plain(parts)
    wild = np.unique(np.searchsorted(offsets, np.flatnonzero(~plain[index]), side="right") - 1)
    # A part that isn't plain is used in no text that stays cut at single spaces, but as its first.
    known = len(parts)
    firsts = offsets[:-1][np.diff(offsets) > 0]
    own = {i: by_spaces(texts[i].as_py()) for i in wild.tolist()}
    more: dict[str, int] = {}
    number = lambda x: more.setdefault(x, known + len(more))
    index[firsts] = [number(x) for x in parts.take(pa.array(index[firsts])).to_pylist()]
    if own:
        pieces_of = [np.array([number(x) for x in own[i]], np.int32) if i in own else index[offsets[i] : offsets[i + 1]] for i in range(len(texts))]
        offsets, index = np.concatenate([[0], np.cumsum([len(x) for x in pieces_of])]), np.concatenate(pieces_of)
    used = np.zeros(known, bool)
    used[index[index < known]] = True
    if not (used & plain).all():
        parts = pc.if_else(pa.array(used & plain), parts, pa.scalar("x", parts.type))
    spaced = pc.binary_join_element_wise(pa.scalar("", parts.type), parts, pa.scalar(" ", parts.type))
    return offsets, index, _wanted(spaced.to_pylist(), parts, 1), list(more)


def encode(texts: pa.Array, path: str, split: str, end: int, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, each with its end id, and the number of ids of each."""
    n = len(texts)
    if not n:
        return np.empty(0, dtype), np.empty(0, np.int64)
    offsets, index, apart, others = _cut(texts, split)
    table, distinct = pieces(path, split), apart.pieces + others
    table.learn(apart, others)
    held = [table[x] for x in distinct]
    table.forget(distinct, held)
    # The end id is one more piece, which stands behind each text's own.
    held.append(_packed([end]))
    index = np.insert(index, offsets[1:], len(held) - 1)
    offsets = offsets + np.arange(n + 1)
    sizes = np.fromiter(map(len, held), np.int32, len(held)) // 4
    flat = np.frombuffer(b"".join(held), np.uint32)
    if flat.max() > np.iinfo(dtype).max:
        raise OverflowError(f"ids up to {flat.max()} don't fit {np.dtype(dtype)}")
    flat = flat.astype(dtype, copy=False)
    # A slice's ids are far fewer than 2**31.
    starts = np.cumsum(sizes, dtype=np.int32) - sizes
    length = sizes[index]
    before = np.zeros(len(length) + 1, np.int32)
    np.cumsum(length, out=before[1:])
    counts = (before[offsets[1:]] - before[offsets[:-1]]).astype(np.int64)
    place = np.repeat(starts[index] - before[:-1], length)
    place += np.arange(before[-1], dtype=np.int32)
    return flat[place], counts

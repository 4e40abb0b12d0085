"""Token ids of whole texts with a public tokenizer, at a word's price once per word."""

from __future__ import annotations

import json
import re

import numpy as np

from sessionloom.llm.common import same_spans, span_hashes

#: Parts of texts that a worker remembers (about 60 bytes each); beyond it starts afresh.
REMEMBERED = 1_200_000
_SLOTS = 1 << 21

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

#: Parts that need no normalising but lower case: ASCII without ' and <, and Latin-1 letters; and what the pattern below makes of them.
_SIMPLE = re.compile("[!-&(-;=-~À-ÖØ-öø-ÿ]+")
_PIECES = re.compile("[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
#: The commonest shape of such parts: letters, then signs or nothing.
_WORD = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:;=-@[-`{-~]*)")
#: The pattern of the tokenizer for which this holds.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_encoders: dict[str, TextEncoder] = {}


class HashTable:
    """Numbers of 64-bit keys, with numpy lookups: open addressing, probed for all keys at once."""

    def __init__(self, slots: int = _SLOTS):
        self.keys, self.values, self.mask = np.zeros(slots, np.uint64), np.zeros(slots, np.int32), slots - 1

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for unknown ones."""
        slot = (keys >> np.uint64(20)).astype(np.int64) & self.mask
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], -1).astype(np.int64)
        open_ = np.flatnonzero((there != keys) & (there != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            there = self.keys[slot[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (there != 0)]
        return out

    def add(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        """New, distinct keys and their numbers."""
        slot = (keys >> np.uint64(20)).astype(np.int64) & self.mask
        open_ = np.arange(len(keys))
        while len(open_):
            at = slot[open_]
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[open_[free]]
            mine = self.keys[at] == keys[open_]
            self.values[at[mine]] = numbers[open_[mine]]
            open_ = open_[~mine]
            slot[open_] = (slot[open_] + 1) & self.mask


class _Signs(dict):
    """Ids of runs of signs, each encoded once."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, signs: str) -> list[int]:
        self[signs] = ids = self.encode(signs)
        return ids


class _Lists:
    """Short lists of numbers, one after the other, with eight places to spare; grows by doubling."""

    def __init__(self, kind: type):
        self.n, self.total = 0, 0
        self.flat, self.begin, self.length = np.zeros(1 << 16, kind), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)

    def extend(self, length: np.ndarray, flat: np.ndarray) -> None:
        n, total = self.n + len(length), self.total + len(flat)
        for name, size in (("flat", total + 8), ("begin", n), ("length", n)):
            old = getattr(self, name)
            if size > len(old):
                new = np.zeros(max(size, 2 * len(old)), old.dtype)
                new[: len(old)] = old
                setattr(self, name, new)
        self.length[self.n : n] = length
        self.begin[self.n : n] = self.total + np.cumsum(length) - length
        self.flat[self.total : total] = flat
        self.n, self.total = n, total

    def gather(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of these numbers one after the other, and their len + 1 offsets."""
        ends = np.zeros(len(of) + 1, np.int64)
        length = self.length[of]
        np.cumsum(length, out=ends[1:])
        at = np.arange(ends[-1])
        at += np.repeat(self.begin[of] - ends[:-1], length)
        return self.flat[at], ends


def _parts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of what stands between ASCII white space."""
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


class TextEncoder:
    """Encodes texts as ``Tokenizer.encode(text, add_special_tokens=False)`` does.

    A tokenizer that drops white space and treats what stands between as separate, as word_bpe_49k.json does, gives a
    text the ids of its parts between ASCII white space one after the other; each different part is encoded
    once and found again by a hash and its bytes. Parts of plain letters, digits and signs are cut as the tokenizer would cut them and
    given to its model; any other part goes through the whole tokenizer. Other tokenizers get whole texts.
    """

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        shape = json.loads(self.tokenizer.to_str())
        split = ((shape.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        self.by_part = split.get("pattern") == {"Regex": _PATTERN} and split.get("invert") is True and split.get("behavior") == "Removed"
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes_of = {ord(c): "".join(p for p, _ in level.pre_tokenize_str(c)) for c in map(chr, range(33, 256)) if c.isalpha() or ord(c) < 127}
        self.signs = _Signs(self._piece)
        self._forget()

    def _forget(self) -> None:
        self.table, self.known, self.parts = HashTable(), _Lists(np.uint32), _Lists(np.uint8)
        #: Parts whose hash another part had before.
        self.others: dict[bytes, int] = {}

    def _learn(self, raw: list[bytes]) -> np.ndarray:
        """Encode parts and remember them; returns their numbers."""
        parts = [x.decode("utf-8", "replace") for x in raw]
        tokenize, table, signs, word = self.tokenizer.model.tokenize, self.bytes_of, self.signs, _WORD.fullmatch
        found: list[list[int]] = []
        rest = []
        for part in parts:
            if shape := word(part):
                letters, tail = shape.groups()
                letters = letters.lower()
                ids = [t.id for t in tokenize(letters if letters.isascii() else letters.translate(table))]
                found.append(ids + signs[tail] if tail else ids)
            elif _SIMPLE.fullmatch(part):
                found.append([i for piece in _PIECES.findall(part.lower()) for i in self._piece(piece)])
            else:
                rest.append(len(found))
                found.append([])
        if rest:
            for k, e in zip(rest, self.tokenizer.encode_batch_fast([parts[k] for k in rest], add_special_tokens=False)):
                found[k] = e.ids
        flat: list[int] = []
        for ids in found:
            flat.extend(ids)
        numbers = np.arange(self.known.n, self.known.n + len(raw))
        self.known.extend(np.fromiter(map(len, found), np.int64, len(found)), np.array(flat, np.uint32))
        self.parts.extend(np.fromiter(map(len, raw), np.int64, len(raw)), np.frombuffer(b"".join(raw), np.uint8))
        return numbers

    def _find(self, keys: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of parts by their hashes, -1 for unknown ones; and which parts have the hash of another part."""
        of = self.table.find(keys)
        known = np.flatnonzero(of >= 0)
        begin = self.parts.begin[of[known]]
        same = same_spans(data, start[known], end[known], self.parts.flat, begin, begin + self.parts.length[of[known]], spare=True)
        return of, known[~same]

    def _piece(self, piece: str) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize(piece.translate(self.bytes_of))]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and the len + 1 offsets of the texts in them."""
        if not self.by_part:
            whole, ends = data.tobytes(), offsets.tolist()
            found = [e.ids for e in self.tokenizer.encode_batch_fast([whole[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])], add_special_tokens=False)]
            return np.fromiter((i for x in found for i in x), np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in found], dtype=np.int64)]).astype(np.int64)
        start, end = _parts(data, offsets)
        keys = span_hashes(data, start, end) | np.uint64(1)
        if self.known.n > REMEMBERED:
            self._forget()
        of, twins = self._find(keys, data, start, end)
        unknown = np.flatnonzero(of < 0)
        if len(unknown):
            fresh, first = np.unique(keys[unknown], return_index=True)
            at = unknown[first]
            self.table.add(fresh, self._learn([data[a:b].tobytes() for a, b in zip(start[at].tolist(), end[at].tolist())]))
            of[unknown], more = self._find(keys[unknown], data, start[unknown], end[unknown])
            twins = np.concatenate([twins, unknown[more]])
        for k in twins.tolist():
            raw = data[start[k] : end[k]].tobytes()
            if raw not in self.others:
                self.others[raw] = int(self._learn([raw])[0])
            of[k] = self.others[raw]
        ids, ends = self.known.gather(of)
        return ids, ends[np.searchsorted(start, offsets)]


def encoder(tokenizer_file: str) -> TextEncoder:
    """The worker's encoder of this file."""
    if tokenizer_file not in _encoders:
        _encoders[tokenizer_file] = TextEncoder(tokenizer_file)
    return _encoders[tokenizer_file]

"""Units of texts, and what is known of each different unit (helpers that run inside tasks).

A unit is a word with the white space before it; what white space ends a text is
one, too.  Units are the texts' bytes, cut.  The tokenizers used here never join
what stands on both sides of such a cut, so that a text's tokens are its units'
tokens, and each different unit has to be tokenized once.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from ._words import _BYTE, _SPACE, Texts, _powers, mixed, ranges

_U = np.uint64
#: A random 64-bit value for each byte, white space included.
_VALUE = _BYTE.copy()
_VALUE[_SPACE] = np.random.default_rng(21).integers(1, 2**64, int(_SPACE.sum()), dtype=_U)
_POWERS = _powers(1 << 14)
#: Units are hashed in blocks of about this many bytes; a longer unit is a block of its own.
BLOCK = 1 << 20
#: White space beyond ASCII, as UTF-8: it may end a word, and then the cut behind it is none.
WIDE_SPACE = rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"


class Units:
    """The units of texts ``a .. b``: starts among ``data``, the text of each, 64-bit hashes.

    Texts in which the pattern ``odd`` matches are one unit each.
    """

    def __init__(self, texts: Texts, a: int, b: int, odd: re.Pattern) -> None:
        lo, hi = texts.offsets[a], texts.offsets[b]
        self.data, offsets = texts.bytes[lo:hi], texts.offsets[a : b + 1] - lo
        n = len(self.data)
        first = _SPACE[self.data]
        first[1:] &= ~first[:-1]
        first[offsets[:-1][offsets[:-1] < n]] = True
        self.odd_texts = np.zeros(b - a, dtype=bool)
        for t in {int(np.searchsorted(offsets, m.start(), side="right")) - 1 for m in odd.finditer(self.data)}:
            first[offsets[t] + 1 : offsets[t + 1]] = False
            self.odd_texts[t] = True
        self.starts = np.flatnonzero(first)
        self.lengths = np.diff(np.append(self.starts, n))
        self.owner = np.searchsorted(offsets, self.starts, side="right") - 1
        #: Units before each text, and in all.
        self.bounds = np.searchsorted(self.owner, np.arange(b - a + 1))
        self.hashes = self._hashes()

    def _hashes(self) -> np.ndarray:
        out = np.zeros(len(self.starts), dtype=_U)
        at = 0
        while at < len(self.starts):
            base = self.starts[at]
            stop = max(at + 1, int(np.searchsorted(self.starts, base + BLOCK)))
            starts, lengths = self.starts[at:stop] - base, self.lengths[at:stop]
            longest = int(lengths.max())
            powers = _POWERS if longest <= len(_POWERS) else _powers(longest)
            value = _VALUE[self.data[base : base + int(lengths.sum())]]
            value *= powers[np.arange(len(value)) - np.repeat(starts, lengths)]
            out[at:stop] = mixed(np.add.reduceat(value, starts))
            at = stop
        return out

    def bytes_of(self, which: np.ndarray) -> list[bytes]:
        starts, lengths = self.starts[which], self.lengths[which]
        joined = self.data[ranges(starts, lengths)].tobytes()
        ends = np.cumsum(lengths).tolist()
        return [joined[s:e] for s, e in zip([0, *ends], ends, strict=False)]


class UnitTable:
    """Numbers of different units, kept from run to run; subclasses keep what they need by number.

    When ``limit`` units, or units of ``limit_bytes`` in all, are known, the table starts anew.
    """

    limit = 1_500_000
    limit_bytes = 1 << 26

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.keys, self.values, self.held = np.zeros(0, dtype=_U), np.zeros(0, dtype=np.int64), 0

    def add(self, units: list[bytes], whole: np.ndarray) -> None:
        """Keep what is needed of new units, which get the next numbers; ``whole``: those that are odd texts."""
        raise NotImplementedError

    def numbers(self, units: Units) -> np.ndarray:
        if len(self.keys) > self.limit or self.held > self.limit_bytes:
            self.clear()
        keys, where, at = np.unique(units.hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, keys)
        fresh = np.ones(len(keys), dtype=bool)
        inside = place < len(self.keys)
        fresh[inside] = self.keys[place[inside]] != keys[inside]
        if fresh.any():
            new = where[fresh]
            texts, count = units.bytes_of(new), len(self.keys)
            self.add(texts, units.odd_texts[units.owner[new]])
            self.held += sum(map(len, texts))
            self.values = np.insert(self.values, place[fresh], np.arange(count, count + len(new)))
            self.keys = np.insert(self.keys, place[fresh], keys[fresh])
            place += np.cumsum(fresh) - fresh
        return self.values[place][at]


#: The signs that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from 256 on.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_REST = [b for b in range(256) if b not in _PRINTABLE]
BYTE_SIGNS = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(_REST)}


class ByteLevel:
    """A byte-level BPE vocabulary whose own pattern cuts texts, asked for units.

    Most units go to it end to end, in texts of about ``text_bytes``, and their
    tokens are told apart by the bytes they stand for.
    """

    text_bytes = 1 << 15

    def __init__(self, path: str, special: bool) -> None:
        """``special``: special tokens within a text keep their own ids."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark deals out the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        rules = json.loads(self.tokenizer.to_str())
        cut = rules["pre_tokenizer"] or {}
        if rules["normalizer"] or rules["model"]["type"] != "BPE" or cut.get("type") != "ByteLevel" or cut["add_prefix_space"] or not cut["use_regex"]:
            raise ValueError(f"the vocabulary in {path} does not cut texts by the rules known here")
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        byte_of = {sign: b for b, sign in BYTE_SIGNS.items()}
        self.bytes = {i: bytes(map(byte_of.__getitem__, t)) for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items()}
        self.bytes |= {i: t.content.encode() for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.sizes = np.zeros(max(self.bytes) + 1, dtype=np.int64)
        self.sizes[list(self.bytes)] = list(map(len, self.bytes.values()))

    def encode(self, units: list[bytes], whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all units end to end, and how many each has."""
        blank = b" \t\n\x0b\x0c\r"
        joins = np.array([u[0] in blank and u[-1] not in blank for u in units], dtype=bool) & ~whole
        counts, parts = np.zeros(len(units), dtype=np.int64), [np.zeros(0, dtype=np.int64)] * len(units)
        easy = np.flatnonzero(joins)
        stops = np.cumsum([len(units[i]) for i in easy.tolist()])
        edges = np.flatnonzero(np.diff(stops // self.text_bytes, prepend=-1)).tolist()
        groups = [easy[i:j].tolist() for i, j in zip(edges, [*edges[1:], len(easy)], strict=False)]
        alone = np.flatnonzero(~joins).tolist()
        for group, found in zip(groups, self._ids([b"".join(map(units.__getitem__, g)) for g in groups]), strict=True):
            ends = np.cumsum(self.sizes[found])
            stops = np.cumsum([len(units[i]) for i in group])
            at = np.searchsorted(ends, stops)
            if ends[-1] != stops[-1] or (ends[at] != stops).any():
                alone += group
                continue
            counts[group] = np.diff(at, prepend=-1)
            parts[group[0]] = (group, found)
        for i, found in zip(alone, self._ids([units[i] for i in alone]), strict=True):
            counts[i], parts[i] = len(found), found
        # Units lie in the order of their numbers again.
        flat = np.zeros(int(counts.sum()), dtype=np.int64)
        starts = np.cumsum(counts) - counts
        for i, part in enumerate(parts):
            if isinstance(part, tuple):
                flat[ranges(starts[part[0]], counts[part[0]])] = part[1]
            elif len(part):
                flat[starts[i] : starts[i] + len(part)] = part
        return flat, counts

    def _ids(self, texts: list[bytes]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast([t.decode(errors="replace") for t in texts], add_special_tokens=False) if texts else []
        return [np.array(e.ids, dtype=np.int64) for e in found]

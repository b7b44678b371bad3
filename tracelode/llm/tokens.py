"""Token ids of whole texts with a public tokenizer file, in Spark tasks.

The tokenizer's rules never look across a space, tab, line feed or carriage
return, nor from an ASCII letter to a digit or sign, so the distinct runs
between these are encoded once for each Python worker and the ids of the
documents are gathered from them. Runs of plain letters, and Latin ones part by
part, go straight to the library's model, which saves its normalising steps;
all others to the whole library. The tests hold the
result against the library's own ids of whole texts.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import regex

from .textkernel import Texts

#: Distinct runs whose ids a worker keeps; beyond it, it starts anew.
KEPT_RUNS = 400_000
#: The parts into which the tokenizer cuts a normalised text.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Printable characters that stand for themselves when composed; the capital I with a dot grows when lower-cased.
_LATIN = regex.compile("[\x21-\x7e\xa1-\xac\xae-\u012f\u0131-\u024f]+")
_PARTS = regex.compile(PARTS)
#: Kinds of bytes: white space between runs, letter, digit, sign, and those that no cut may touch (apostrophes, control and non-ASCII bytes).
_BETWEEN, _LETTER, _DIGIT, _SIGN, _BOUND = range(5)
_KIND = np.full(256, _BOUND, np.uint8)
_KIND[0x21:0x7F] = _SIGN
_KIND[[0x20, 0x09, 0x0A, 0x0D]] = _BETWEEN
_KIND[0x30:0x3A] = _DIGIT
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _LETTER
_KIND[0x27] = _BOUND
#: Between these neighbours the tokenizer always cuts.
_CUT = np.zeros((5, 5), bool)
_CUT[_BETWEEN, :] = _CUT[:, _BETWEEN] = True
_CUT[_LETTER : _SIGN + 1, _LETTER : _SIGN + 1] = ~np.eye(3, dtype=bool)
_CUT[_DIGIT, _DIGIT] = True
#: The same as tables for ``bytes.translate``; neighbours as first * 5 + second.
_KIND_TABLE, _CUT_TABLE = _KIND.tobytes(), _CUT.tobytes().ljust(256, b"\0")
_PLAIN = re.compile(r"[a-z]+|[0-9]|[\x21-\x26\x28-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+")


@lru_cache(maxsize=2)
def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_signs() -> dict[int, str]:
    """The printable sign that byte-level tokenizers write for each byte: itself, or the next free one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in plain)}


_SIGNS = _byte_signs()


@lru_cache(maxsize=1)
def encoder(path: str) -> "Encoder":
    """The worker's encoder, loaded once; ``forget`` drops its runs."""
    return Encoder(path)


class Encoder:
    """Encodes Arrow text columns; null is an empty text. Special tokens are not added."""

    def __init__(self, path: str):
        self.library = _library(path)
        self.by_parts = self._cuts_as_known()
        self.forget()

    def _cuts_as_known(self) -> bool:
        """Whether the file normalises and cuts by the rules that ``_learn`` follows."""
        rules = json.loads(self.library.to_str())
        steps = [x["type"] for x in (rules["normalizer"] or {}).get("normalizers", [])]
        cuts = (rules["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        return steps == ["NFC", "Replace", "Lowercase"] and len(cuts) == 2 and cuts[0].get("pattern") == {"Regex": PARTS} and cuts[1]["type"] == "ByteLevel"

    def forget(self) -> None:
        """Drops the known runs and gives their memory back: a task's last act, so that an idle worker holds the library alone."""
        self.slot: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.bounds = np.zeros(1 << 14, np.int64)
        self.n = 0
        pa.default_memory_pool().release_unused()

    def _learn(self, runs: list[bytes]) -> np.ndarray:
        """Keeps the ids of new runs; their slots."""
        easy, hard, words, parts = [], [], [], []
        tokenize = self.library.model.tokenize
        for i, text in enumerate(b" ".join(runs).decode().split(" ")):
            if not self.by_parts or "<|" in text:
                hard.append((i, text))
            elif _PLAIN.fullmatch(text):
                easy.append(i)
                words.append(text)
                parts.append(1)
            elif _LATIN.fullmatch(text):
                own = _PARTS.findall(text.lower())
                easy.append(i)
                words += [p if p.isascii() else "".join([_SIGNS[b] for b in p.encode()]) for p in own]
                parts.append(len(own))
            else:
                hard.append((i, text))
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        if words:
            each = [[t.id for t in tokenize(word)] for word in words]
            sizes.append(np.add.reduceat(np.fromiter(map(len, each), np.int64, len(each)), np.cumsum([0, *parts[:-1]])))
            ids.append(np.fromiter(chain.from_iterable(each), np.uint32, int(sizes[-1].sum())))
        if hard:
            each = [x.ids for x in self.library.encode_batch_fast([text for _, text in hard], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, each), np.int64, len(each)))
            ids.append(np.fromiter(chain.from_iterable(each), np.uint32, int(sizes[-1].sum())))
        new = np.concatenate(ids)
        low = int(self.bounds[self.n])
        high = low + len(new)
        while len(self.ids) < high:
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while len(self.bounds) < self.n + len(runs) + 1:
            self.bounds = np.concatenate((self.bounds, np.zeros_like(self.bounds)))
        self.ids[low:high] = new
        self.bounds[self.n + 1 : self.n + 1 + len(runs)] = low + np.cumsum(np.concatenate(sizes))
        slots = np.empty(len(runs), np.int64)
        slots[easy + [i for i, _ in hard]] = np.arange(self.n, self.n + len(runs))
        self.slot.update(zip(runs, slots.tolist(), strict=True))
        self.n += len(runs)
        return slots

    def _slots(self, runs: list[bytes]) -> np.ndarray:
        """Where the ids of these distinct runs are kept."""
        slots = np.fromiter(map(self.slot.get, runs, repeat(-1)), np.int64, len(runs))
        new = np.flatnonzero(slots < 0)
        if self.n and self.n + len(new) > KEPT_RUNS:
            self.forget()
            return self._learn(runs)
        if len(new):
            slots[new] = self._learn([runs[i] for i in new.tolist()])
        return slots

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents one after the other, number of ids of each)."""
        texts = Texts(column)
        raw = texts.data.tobytes()
        kind = np.frombuffer(raw.translate(_KIND_TABLE), np.uint8)
        if not self.by_parts or b"<|" in raw:  # a special token's name may stand in the text: cut at white space only
            data, cut = texts.data, (kind[:-1] == _BETWEEN) | (kind[1:] == _BETWEEN)
        else:
            data, cut = np.frombuffer(raw.lower(), np.uint8), np.frombuffer((kind[:-1] * np.uint8(5) + kind[1:]).tobytes().translate(_CUT_TABLE), bool)
        inside = kind != _BETWEEN
        start = np.flatnonzero(inside & np.concatenate(([True], cut)))
        end = np.flatnonzero(inside & np.concatenate((cut, [True]))) + 1
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(texts.n, np.int64)
        bounds = np.concatenate(([0], np.cumsum(end - start)))
        runs = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(data[inside])]).dictionary_encode()
        slot = self._slots(runs.dictionary.to_pylist())[runs.indices.to_numpy()]
        first, size = self.bounds[slot], self.bounds[slot + 1] - self.bounds[slot]
        stop = np.cumsum(size)
        ids = self.ids[np.repeat(first - stop + size, size) + np.arange(stop[-1])]
        before = np.concatenate(([0], stop))[np.searchsorted(start, np.concatenate(([0], texts.end)))]
        return ids, np.diff(before)

"""Token ids of whole texts, a batch at a time, with a memory of words.

For the kind of tokenizer that ``word_bpe`` is: NFC, white space to blanks, lower case,
then words by a fixed pattern, each encoded on its own. Texts of plain characters (ASCII,
Latin letters up to U+017F, some typographic marks) are cut into words by byte
classes in numpy, and each different word of a batch is looked up once. All other texts,
and all texts where the tokenizer is of another kind, go through the tokenizer itself.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Words an encoder remembers at most; then the half that was seen more rarely is forgotten.
MEMO = 200_000
#: Bytes of text cut into words at a time; longer texts are cut at blanks, which changes no id.
PIECE = 1 << 19
#: Unknown words handed to the tokenizer at a time.
LEARN = 2000

#: The tokenizer's parts that the byte classes stand for.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}

_BLANK, _LETTER, _DIGIT, _MARK = range(4)
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b in (9, 10, 13) else b for b in range(256))


def _classes() -> np.ndarray:
    """Class of each byte of a plain text. Continuation bytes count as letters; those of typographic marks are set later."""
    out = np.full(256, _MARK, dtype=np.uint8)
    out[32] = _BLANK
    out[[*range(97, 123), *range(0x80, 0xC0), 0xC3, 0xC4, 0xC5]] = _LETTER
    out[48:58] = _DIGIT
    return out


_CLASS = _classes()
#: Bytes that no plain text has: controls and leads of other characters.
_OTHER = np.array([b < 32 or b == 127 or b >= 0xC0 and b not in (0xC3, 0xC4, 0xC5, 0xE2) for b in range(256)])
#: Third bytes of the plain marks U+2013, 2014, 2018, 2019, 201C, 201D, 2026.
_TYPOGRAPHIC = np.isin(np.arange(256), [0x93, 0x94, 0x98, 0x99, 0x9C, 0x9D, 0xA6])
#: Second bytes after C4 and C5 of letters that are lower case already.
_LOWER = {lead: np.array([0x80 <= b < 0xC0 and (c := bytes([lead, b]).decode()).isalpha() and c.lower() == c for b in range(256)]) for lead in (0xC4, 0xC5)}


def _not_plain(data: np.ndarray) -> np.ndarray:
    """Positions of bytes that need the tokenizer itself."""
    found = [np.flatnonzero(_OTHER[data])]
    at = np.flatnonzero(data == 0xC3)
    found.append(at[np.isin(data[at + 1], (0x97, 0xB7))])
    for lead, lower in _LOWER.items():
        at = np.flatnonzero(data == lead)
        found.append(at[~lower[data[at + 1]]])
    at = np.flatnonzero(data == 0xE2)
    found.append(at[(data[at + 1] != 0x80) | ~_TYPOGRAPHIC[data[at + 2]]])
    return np.concatenate(found)


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of each word in data, its start in kept, kept) of plain text that ends with a blank; kept are the bytes without blanks."""
    at = np.flatnonzero(data == 0xC3) + 1
    at = at[(data[at] >= 0x80) & (data[at] <= 0x9E)]
    if len(at):
        data = data.copy()
        data[at] += 32
    kind = _CLASS[data]
    at = np.flatnonzero(data == 0xE2)
    kind[at + 1] = kind[at + 2] = _MARK
    solid = kind != _BLANK
    start = kind == _DIGIT
    start[0] = True
    start[1:] |= kind[1:] != kind[:-1]
    start &= solid
    # contractions: an apostrophe behind no other mark takes one or two letters with it
    at = np.flatnonzero(data == 39)
    at = at[(at == 0) | (kind[at - 1] != _MARK)]
    one, two = data[at + 1], data[np.minimum(at + 2, len(data) - 1)]
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = (two == 101) & ((one == 114) | (one == 118)) | (one == 108) & (two == 108)
    for spot, size in ((at[short], 2), (at[long], 3)):
        for i in range(1, size):
            start[spot + i] = False
        start[spot + size] = solid[spot + size]
    begin = np.flatnonzero(start)
    return begin, (np.cumsum(solid, dtype=np.int32) - 1)[begin], data[solid]


class WordEncoder:
    """``Tokenizer.encode`` without special tokens for batches of whole texts."""

    def __init__(self, path: str, memo: int = MEMO):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit = memo
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Every added token begins with this; texts that have it go through the tokenizer.
        self.special = os.path.commonprefix(added).encode()
        model = self.tokenizer.model
        # asked part by part: the whole description with its vocabulary would take tens of megabytes
        shape = lambda part: None if part is None else json.loads(part.__getstate__())
        #: Whether the byte classes stand for this tokenizer.
        self.plain = (
            type(model).__name__ == "BPE" and model.end_of_word_suffix == "</w>" and not model.dropout and not model.continuing_subword_prefix and not model.ignore_merges
            and shape(self.tokenizer.normalizer) == NORMALIZER and shape(self.tokenizer.pre_tokenizer) == PRE_TOKENIZER and (not added or bool(self.special))
        )
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        del vocabulary
        self._forget_all()

    def _forget_all(self) -> None:
        self.memo: dict[bytes, int] = {}
        self.first = np.zeros(1, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.uint32)
        self.seen = np.zeros(0, dtype=np.int64)

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _pieces_of(self, text: str) -> list[int]:
        """Ids of any text, at most PIECE characters at a time: with this kind of tokenizer nothing reaches across a blank."""
        if not self.plain or len(text) <= PIECE:
            return self._whole(text)
        out, at = [], 0
        while at < len(text):
            stop = at + PIECE
            if stop < len(text):
                cut = max(text.rfind(" ", at, stop), text.rfind("\n", at, stop))
                stop = cut + 1 if cut >= at else len(text)
            out += self._whole(text[at:stop])
            at = stop
        return out

    def _learn(self, words: list[bytes]) -> None:
        """Remember the ids of new words. Each is one word to the tokenizer's pattern, so its last id closes it."""
        for lo in range(0, len(words), LEARN):
            part = words[lo : lo + LEARN]
            ids = np.array(self._whole(b" ".join(part).decode()), dtype=np.uint32)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(part):
                each = [self._whole(w.decode()) for w in part]
                ids, ends = np.array([i for e in each for i in e], dtype=np.uint32), np.cumsum([len(e) for e in each])
            for word in part:
                self.memo[word] = len(self.memo)
            self.first = np.concatenate([self.first, self.first[-1] + ends])
            self.flat = np.concatenate([self.flat, ids])
        self.seen = np.concatenate([self.seen, np.zeros(len(words), dtype=np.int64)])

    def _forget(self) -> None:
        """Keep the half of the words that were seen in most batches."""
        kept = np.sort(np.argsort(-self.seen, kind="stable")[: self.limit // 2])
        names = list(self.memo)
        self.memo = {names[i]: n for n, i in enumerate(kept)}
        self.flat, sizes = self._gather(kept)
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.seen = self.seen[kept] // 2

    def _gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each word) of remembered words."""
        sizes = self.first[slots + 1] - self.first[slots]
        before = np.cumsum(sizes) - sizes
        return self.flat[np.repeat(self.first[slots] - before, sizes) + np.arange(sizes.sum())], sizes

    def _look_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        coded = words.dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.memo) > self.limit:
            self._forget()
        slots = [*map(self.memo.get, names)]
        fresh = [i for i, slot in enumerate(slots) if slot is None]
        if fresh:
            known = len(self.memo)
            self._learn([names[i] for i in fresh])
            for n, i in enumerate(fresh, known):
                slots[i] = n
        slots = np.array(slots, dtype=np.int64)
        self.seen[slots] += 1
        return self._gather(slots[coded.indices.to_numpy(zero_copy_only=False)])

    def encode_batch(self, texts: list[str | None], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, ids of each text). ``end_id`` closes each text; a null text is empty."""
        texts = [t or "" for t in texts]
        raw = [t.encode() for t in texts]
        ends = np.cumsum([len(r) + 1 for r in raw]).astype(np.int64)
        blob = (b" ".join(raw) + b" ").translate(_FOLD) if raw else b""
        whole = np.array([bool(self.special) and self.special in r for r in raw], dtype=bool) if self.plain else np.ones(len(raw), dtype=bool)
        counts = np.zeros(len(raw), dtype=np.int64)
        found = [np.zeros(0, dtype=np.uint32)]
        if self.plain:
            for at, data in _byte_pieces(blob):
                whole[np.searchsorted(ends, at + _not_plain(data), side="right")] = True
            for at, data in _byte_pieces(blob):
                begin, offset, kept = _words(data)
                if not len(begin):
                    continue
                owner = np.searchsorted(ends, at + begin, side="right")
                offsets = np.append(offset, len(kept)).astype(np.int32)
                words = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
                if (skip := whole[owner]).any():
                    words, owner = words.filter(pa.array(~skip)), owner[~skip]
                if not len(owner):
                    continue
                ids, sizes = self._look_up(words)
                found.append(ids)
                counts += np.bincount(owner, sizes, minlength=len(raw)).astype(np.int64)
        others = {int(i): self._pieces_of(texts[i]) for i in np.flatnonzero(whole)}
        for i, ids in others.items():
            counts[i] = len(ids)
        total = counts + (end_id is not None)
        stop = np.cumsum(total)
        out = np.empty(int(total.sum()), dtype=np.uint32)
        plain = np.repeat(~whole, total)
        if end_id is not None and len(out):
            plain[stop - 1] = False
            out[stop - 1] = end_id
        out[plain] = np.concatenate(found)
        for i, ids in others.items():
            out[stop[i] - total[i] : stop[i] - total[i] + counts[i]] = ids
        return out, total


def _byte_pieces(blob: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """(start, bytes) of pieces that end with a blank."""
    at = 0
    while at < len(blob):
        stop = min(len(blob), at + PIECE)
        if stop < len(blob):
            cut = blob.rfind(b" ", at, stop)
            stop = (cut if cut >= 0 else blob.index(b" ", stop)) + 1
        yield at, np.frombuffer(blob, np.uint8, stop - at, at)
        at = stop


@lru_cache(1)
def encoder_of(path: str) -> WordEncoder:
    """The process's encoder: a Python worker keeps its memory of words from task to task."""
    return WordEncoder(path)

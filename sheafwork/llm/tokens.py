"""Token ids of whole batches of texts, each distinct piece of text encoded once.

A byte-level BPE first cuts a text into pieces (a word with the space before it, a run of digits,
of signs or of white space) and then encodes every piece on its own.  So the pieces of a batch are
cut with array operations, each piece unknown to the task is encoded by the tokenizer, and the
ids of all pieces are put together again.  Texts with characters beyond U+024F, an apostrophe (which
starts pieces of its own) or the text of an added token are given to the tokenizer whole.  The
result is the tokenizer's, id by id.
"""

from __future__ import annotations

import os
import re
import unicodedata
from functools import lru_cache

import numpy as np

from sheafwork.llm.arrays import Slices, ranges

#: Pieces a worker remembers; beyond that it forgets them all, so its memory stays bounded.
REMEMBERED = 1_500_000

_LETTER, _NUMBER, _SPACE, _OTHER = 0, 1, 2, 3
_SAFE = 0x250
_BEYOND = re.compile("[^\0-\u024f]")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    kinds = np.full(_SAFE, _OTHER, np.uint8)
    for c in range(_SAFE):
        if chr(c).isspace() and c not in (0x1C, 0x1D, 0x1E, 0x1F):
            kinds[c] = _SPACE
        elif unicodedata.category(chr(c))[0] == "L":
            kinds[c] = _LETTER
        elif unicodedata.category(chr(c))[0] == "N":
            kinds[c] = _NUMBER
    return kinds


def piece_starts(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether a piece starts at each code point of texts laid end to end."""
    size = len(points)
    kind = _classes()[points]
    first = np.zeros(size + 1, bool)
    first[offsets] = True
    run = first[:-1].copy()
    run[1:] |= kind[1:] != kind[:-1]
    start = run & (kind == _SPACE)
    words = np.flatnonzero(run & (kind != _SPACE))
    after_blank = (words > 0) & ~first[words] & (points[words - 1] == 32)
    start[words - after_blank] = True
    # The last of several white spaces stands alone before a word, unless it is the word's blank.
    behind_space = words[(words > 0) & ~first[words] & (kind[words - 1] == _SPACE)]
    start[behind_space - 1] = True
    return start


class Encoder:
    """Encodes batches of texts; keeps the ids of the pieces it has met."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        added = self._tokenizer.get_added_tokens_decoder().values()
        self._added = [token.content for token in added]
        self._forget()

    def _forget(self) -> None:
        self._keys = np.empty(0, np.uint64)
        self._where = np.empty(0, np.int64)
        self._count = np.empty(0, np.int64)
        self._ids = np.empty(1 << 16, np.int32)
        self._spans = np.empty((1 << 16, 2), np.int32)
        self._used = 0

    def _add(self, keys: np.ndarray, pieces: list[str]) -> None:
        found = self._tokenizer.encode_batch(pieces, add_special_tokens=False)
        count = np.fromiter((len(e.ids) for e in found), np.int64, len(found))
        need = self._used + int(count.sum())
        if need > len(self._ids):
            size = max(need, 2 * len(self._ids))
            self._ids = np.resize(self._ids, size)
            self._spans = np.resize(self._spans, (size, 2))
        self._ids[self._used : need] = [i for e in found for i in e.ids]
        self._spans[self._used : need] = [span for e in found for span in e.offsets]
        where = self._used + np.concatenate(([0], np.cumsum(count)[:-1]))
        at = np.searchsorted(self._keys, keys)
        self._keys = np.insert(self._keys, at, keys)
        self._where = np.insert(self._where, at, where)
        self._count = np.insert(self._count, at, count)
        self._used = need

    def _whole(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        encoded = self._tokenizer.encode(text, add_special_tokens=False)
        spans = np.array(encoded.offsets, np.int64).reshape(-1, 2)
        return np.array(encoded.ids, np.int32), spans

    def encode(
        self, texts: list[str], with_spans: bool = True
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts end to end, their spans in code points, and where each text's start.

        Without ``with_spans`` the spans are left out: zeros.
        """
        plain = np.fromiter(
            (
                "'" not in t
                and not any(a in t for a in self._added)
                and (t.isascii() or not _BEYOND.search(t))
                for t in texts
            ),
            bool,
            len(texts),
        )
        ids, spans, count = self._pieces([t for t, p in zip(texts, plain) if p], with_spans)
        if plain.all():
            return ids, spans, np.concatenate(([0], np.cumsum(count)))
        all_ids, all_spans, counts, at, n = [], [], [], 0, 0
        for text, is_plain in zip(texts, plain):
            if is_plain:
                size = count[n]
                all_ids.append(ids[at : at + size])
                all_spans.append(spans[at : at + size])
                at, n = at + size, n + 1
            else:
                own_ids, own_spans = self._whole(text)
                all_ids.append(own_ids)
                all_spans.append(own_spans)
            counts.append(len(all_ids[-1]))
        return (
            np.concatenate(all_ids),
            np.concatenate(all_spans),
            np.concatenate(([0], np.cumsum(counts))),
        )

    def _pieces(self, texts: list[str], with_spans: bool):
        joined = "".join(texts)
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
        if not joined:
            return np.empty(0, np.int32), np.empty((0, 2), np.int64), np.zeros(len(texts), np.int64)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        starts = np.flatnonzero(piece_starts(points, offsets))
        ends = np.append(starts[1:], len(points))
        keys, first, inverse = np.unique(
            Slices(points).hash(starts, ends), return_index=True, return_inverse=True
        )
        at = np.minimum(np.searchsorted(self._keys, keys), max(0, len(self._keys) - 1))
        missing = self._keys[at] != keys if len(self._keys) else np.ones(len(keys), bool)
        if len(self._keys) + missing.sum() > REMEMBERED:
            self._forget()
            missing = np.ones(len(keys), bool)
        if missing.any():
            unknown = first[missing]
            self._add(keys[missing], [joined[starts[i] : ends[i]] for i in unknown])
        entry = np.searchsorted(self._keys, keys)[inverse]
        count = self._count[entry]
        at = ranges(self._where[entry], count)
        done = np.concatenate(([0], np.cumsum(count)))
        first = np.searchsorted(starts, offsets)
        per_text = np.diff(done[first])
        if not with_spans:
            return self._ids[at], np.broadcast_to(np.int64(0), (len(at), 2)), per_text
        shift = starts - np.repeat(offsets[:-1], np.diff(first))
        return self._ids[at], self._spans[at] + np.repeat(shift, count)[:, None], per_text


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The worker's encoder, kept between its tasks."""
    return Encoder(path)

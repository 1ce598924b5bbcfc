"""Ids of whole Arrow arrays of texts from a tokenizers file of lower-casing BPE with word ends.

White space is dropped by such a tokenizer, so a text's ids are those of its space-separated pieces in a row. Each
distinct piece is encoded once and kept for later batches of the same task, as long as they take no more than KEPT bytes.
Pieces of plain letters, digits and marks are encoded many at a time; the tokens that end a word tell where one piece
stops. Where the counts don't agree, and for other pieces, each piece is
encoded by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters that normalisation leaves alone, besides the apostrophe (contractions) and < (special tokens).
PLAIN = "^[!-&(-;=-~\\x{a1}-\\x{ff}]+$"
UNITS = r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
JOINED = 256
#: Tokens assembled at a time, about.
CHUNK = 1 << 21
#: Bytes of text that are split at a time.
SLICE = 8 << 20
#: Bytes of pieces and ids that a task keeps.
KEPT = 48 << 20

_loaded: dict[str, tuple] = {}


def _load(path: str) -> tuple:
    if path not in _loaded:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        vocab = tokenizer.get_vocab()
        ends = np.zeros(max(vocab.values()) + 1, bool)
        ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        _loaded[path] = (tokenizer, ends)
    return _loaded[path]


class WordEncoder:
    def __init__(self, path: str):
        self.tokenizer, self.ends = _load(path)
        self.kept = (pa.array([], pa.large_string()), np.zeros(0, np.uint32), np.zeros((2, 0), np.int64))

    def _each(self, pieces: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch(pieces, add_special_tokens=False)]

    def pieces(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and where each begins."""
        n = len(distinct)
        plain = np.asarray(pc.match_substring_regex(distinct, PLAIN))
        lengths = np.zeros(n, np.int64)
        which = np.flatnonzero(plain)
        text = distinct.take(pa.array(which))
        units = np.asarray(pc.count_substring_regex(text, UNITS))
        text = text.to_pylist()
        blocks = [slice(i, i + JOINED) for i in range(0, len(which), JOINED)]
        joined = self.tokenizer.encode_batch([" ".join(text[b]) for b in blocks], add_special_tokens=False)
        flat: list[np.ndarray] = []
        order: list[np.ndarray] = []
        for b, encoding in zip(blocks, joined, strict=True):
            got = np.array(encoding.ids, np.uint32)
            stops = np.flatnonzero(self.ends[got])
            upto = np.cumsum(units[b])
            if len(stops) != upto[-1] or (len(got) and stops[-1] != len(got) - 1):
                each = self._each(text[b])
                size = np.array([len(x) for x in each])
                got = np.array([y for x in each for y in x], np.uint32)
            else:
                size = np.diff(stops[upto - 1] + 1, prepend=0)
            flat.append(got)
            lengths[which[b]] = size
            order.append(which[b])
        rest = np.flatnonzero(~plain)
        if len(rest):
            each = self._each(distinct.take(pa.array(rest)).to_pylist())
            lengths[rest] = [len(x) for x in each]
            flat.append(np.array([y for x in each for y in x], np.uint32))
            order.append(rest)
        begins = np.zeros(n, np.int64)
        if order:
            places = np.concatenate(order)
            begins[places] = np.cumsum(lengths[places]) - lengths[places]
        return (np.concatenate(flat) if flat else np.zeros(0, np.uint32)), np.stack([begins, lengths])

    def known(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As pieces(), by way of what earlier batches have left."""
        have, ids, places = self.kept
        found = pc.index_in(distinct, value_set=have)
        missing = np.asarray(found.is_null())
        new = distinct.filter(pa.array(missing))
        more, at = self.pieces(new)
        at[0] += len(ids)
        have, ids, places = pa.concat_arrays([have, new]), np.concatenate([ids, more]), np.concatenate([places, at], axis=1)
        which = np.asarray(found.fill_null(0)).astype(np.int64)
        which[missing] = np.arange(places.shape[1] - len(new), places.shape[1])
        if have.nbytes + ids.nbytes + places.nbytes <= KEPT:
            self.kept = (have, ids, places)
        else:
            self.kept = (new[:0], ids[:0], places[:, :0])
        return ids, places[:, which]

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids in a row, where each text's begin) for consecutive texts; nulls are empty.

        Texts are split SLICE bytes at a time, a longer text by itself, so memory doesn't grow with a batch.
        """
        upto = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64))
        i = 0
        while i < len(texts):
            before = upto[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(upto, before + SLICE, "right")))
            yield from self._encode(texts.slice(i, j - i))
            i = j

    def _encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        which = np.asarray(coded.indices)
        at = np.asarray(split.offsets) - split.offsets[0].as_py()
        ids, (begins, lengths) = self.known(coded.dictionary)
        size = lengths[which]
        upto = np.concatenate([[0], np.cumsum(size)])
        bounds = upto[at]
        i, n = 0, len(texts)
        while i < n:
            j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + CHUNK, "right")) - 1)
            own, own_size = which[at[i] : at[j]], size[at[i] : at[j]]
            total = int(bounds[j] - bounds[i])
            shift = begins[own] - (np.cumsum(own_size) - own_size)
            yield ids[np.repeat(shift, own_size) + np.arange(total)], bounds[i : j + 1] - bounds[i]
            i = j

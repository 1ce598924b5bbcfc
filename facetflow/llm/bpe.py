"""Byte-level BPE by corpus-level merge replay.

The distinct pieces of a block of texts (what the tokenizer's pattern matches) are laid out as one array of byte
tokens. An inverted index maps each adjacent token pair that has a rank to the places where it stands; ranks are
replayed in order, each on all its places at once, and only the two neighbours of a merged place are looked up again
and entered in the index. A piece in which a merge would make a pair of a lower rank, where replay on all places at
once could differ from merging one pair at a time, is encoded by itself. Documents are then put together from their
pieces, and decoded again from the table of token bytes.

Each task encodes its own rows block by block: nothing is shuffled, and memory is bounded by an Arrow batch.
Null texts are empty: no tokens, and the digests are those of the empty string. Null ids and repeated rows are kept; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Bytes of text whose distinct pieces are replayed together.
CORPUS = 32 << 20
NONE = np.int32(1 << 30)
#: Segments that the pattern matches whole: an optional space and letters of Latin-1.
WHOLE = "^ ?[A-Za-z\\x{c0}-\\x{d6}\\x{d8}-\\x{f6}\\x{f8}-\\x{ff}]+$"
#: A space inside a run of white space, where a text must not be cut.
INNER = r"[\t-\r\x1c-\x1f\x85\pZ] ([\t-\r\x1c-\x1f\x85\pZ]|$)"

_loaded: dict[tuple, "RankTable"] = {}


class RankTable:
    def __init__(self, path: str, pattern: str):
        import regex

        self.find = regex.compile(pattern).findall
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        get, keys, values = self.ranks.get, [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                if (a := get(token[:cut])) is not None and (b := get(token[cut:])) is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.values = np.array(keys, np.int64)[order], np.array(values, np.int32)[order]

    @staticmethod
    def of(path: str, pattern: str) -> "RankTable":
        if (path, pattern) not in _loaded:
            _loaded[path, pattern] = RankTable(path, pattern)
        return _loaded[path, pattern]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge; NONE where there is none."""
        key = (left.astype(np.int64) << 32) | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.values[at], NONE)

    def single(self, piece: bytes) -> list[int]:
        """One piece, one pair at a time."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, get = len(piece), self.ranks.get
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the token that begins at each place; 0: merged away
        heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:  # the pair of the lowest rank, the first of equals
            _, i, stop = heapq.heappop(heap)
            middle = end[i]
            if not middle or middle >= n or end[middle] != stop:
                continue
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                if (rank := get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (rank, i, end[stop]))
            if (left := before[i]) >= 0 and (rank := get(piece[left:stop])) is not None:
                heapq.heappush(heap, (rank, left, stop))
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[piece[i : end[i]]])
            i = end[i]
        return ids

    def replay(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of pieces (bytes in a row, where each begins): ids in a row, and how many each piece has."""
        n, pieces = len(data), len(offsets) - 1
        if not n:
            return np.zeros(0, np.int32), np.zeros(pieces, np.int64)
        token = self.byte[data]
        after = np.arange(1, n + 1, dtype=np.int64)
        before = np.arange(-1, n - 1, dtype=np.int64)
        owner = np.repeat(np.arange(pieces), np.diff(offsets))
        last = np.append(owner[1:] != owner[:-1], True)
        after[last] = -1
        before[np.append(True, last[:-1])] = -1
        alive = np.ones(n, bool)
        pair = np.full(n, NONE, np.int32)
        inner = np.flatnonzero(~last)
        pair[inner] = self.rank(token[inner], token[inner + 1])
        odd = np.zeros(pieces, bool)

        places = np.flatnonzero(pair != NONE)
        places = places[np.argsort(pair[places], kind="stable")]
        ranks, cuts = np.unique(pair[places], return_index=True)
        index = {int(r): [p] for r, p in zip(ranks, np.split(places, cuts[1:]), strict=True)} if len(places) else {}
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            rank = heapq.heappop(heap)
            found = index.pop(rank)
            at = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
            at = at[pair[at] == rank]
            if not len(at):
                continue
            right = after[at]
            if len(at) > 1:
                follows = np.append(False, right[:-1] == at[1:])
                if follows.any():  # overlapping places: every second one of a run
                    start = np.maximum.accumulate(np.where(~follows, np.arange(len(at)), 0))
                    take = (np.arange(len(at)) - start) % 2 == 0
                    at, right = at[take], right[take]
            beyond = after[right]
            if len(at) > 1:
                touch = np.flatnonzero(beyond[:-1] == at[1:])
                if len(touch):
                    lower = self.rank(np.full(len(touch), rank, np.int32), token[at[touch + 1]]) < rank
                    odd[owner[at[touch[lower]]]] = True
            token[at] = rank
            alive[right] = False
            pair[right] = NONE
            after[at] = beyond
            before[beyond[beyond >= 0]] = at[beyond >= 0]
            prior = before[at]
            near = np.concatenate([at, prior[prior >= 0]])
            near = near[alive[near]]
            if len(near) > 1:
                near = np.unique(near)
            follow = after[near]
            ends = follow < 0
            new = self.rank(token[near], token[follow])
            new[ends] = NONE
            pair[near] = new
            keep = new != NONE
            if not keep.any():
                continue
            near, new = near[keep], new[keep]
            if (new < rank).any():
                odd[owner[near[new < rank]]] = True
            if len(near) > 1:
                order = np.argsort(new, kind="stable")
                near, new = near[order], new[order]
                bounds = np.flatnonzero(new[1:] != new[:-1]) + 1
                starts, stops = [0, *bounds.tolist()], [*bounds.tolist(), len(near)]
                heads = new[starts].tolist()
            else:
                starts, stops, heads = [0], [1], [int(new[0])]
            for a, b, r in zip(starts, stops, heads, strict=True):
                if r in index:
                    index[r].append(near[a:b])
                else:
                    index[r] = [near[a:b]]
                    heapq.heappush(heap, r)
        ids, counts = token[alive], np.bincount(owner[alive], minlength=pieces)
        redo = np.flatnonzero(odd | self._wholes(data, offsets, counts))
        if len(redo):
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for i in redo:
                parts[i] = np.array(self.single(data[offsets[i] : offsets[i + 1]].tobytes()), np.int32)
                counts[i] = len(parts[i])
            ids = np.concatenate(parts)
        return ids, counts

    def _wholes(self, data: np.ndarray, offsets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Pieces of several tokens whose bytes are a token by themselves."""
        found = np.zeros(len(counts), bool)
        raw = data.tobytes()
        for i in np.flatnonzero((counts > 1) & (np.diff(offsets) <= int(self.lengths.max()))):
            found[i] = raw[offsets[i] : offsets[i + 1]] in self.ranks
        return found

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids in a row, where each text's begin) for consecutive texts; nulls are empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        size = np.cumsum(np.asarray(pc.binary_length(texts)))
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + CORPUS, "right")))
            yield self._block(texts[i:j])
            i = j

    def _block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        uncut = np.asarray(pc.match_substring_regex(texts, INNER))
        split = pc.split_pattern(pc.if_else(pa.array(uncut), "", texts), " ")
        coded = split.flatten().dictionary_encode()
        at = np.asarray(split.offsets) - split.offsets[0].as_py()
        which = np.asarray(coded.indices).astype(np.int64)
        known = len(coded.dictionary)
        # a segment is led by its space, but for the first of a text
        leading = np.ones(len(which), np.int64)
        leading[at[:-1][at[:-1] < at[1:]]] = 0
        key = which * 2 + leading
        if uncut.any():
            key[at[:-1][uncut]] = 2 * known + np.arange(int(uncut.sum()))
        keys, key = np.unique(key, return_inverse=True)
        words, whole_texts = keys[keys < 2 * known], keys[keys >= 2 * known] - 2 * known
        segments = coded.dictionary.take(pa.array(words // 2))
        space = pc.if_else(pa.array(words % 2 == 1), " ", "").cast(pa.large_string())
        segments = pc.binary_join_element_wise(space, segments, pa.scalar("", pa.large_string()))
        if len(whole_texts):
            segments = pa.concat_arrays([segments, texts.filter(pa.array(uncut)).take(pa.array(whole_texts))])
        simple = np.asarray(pc.match_substring_regex(segments, WHOLE))
        found: list[str] = []
        pieces_of = np.ones(len(segments), np.int64)
        others = np.flatnonzero(~simple)
        for i, text in zip(others, segments.take(pa.array(others)).to_pylist(), strict=True):
            own = self.find(text)
            pieces_of[i] = len(own)
            found += own
        pieces = pa.concat_arrays([segments.filter(pa.array(simple)), pa.array(found, pa.large_string())]).dictionary_encode()
        distinct = pieces.dictionary
        start = np.cumsum(pieces_of) - pieces_of
        piece = np.zeros(int(pieces_of.sum()), np.int64)
        codes, n_simple = np.asarray(pieces.indices), int(simple.sum())
        piece[start[simple]] = codes[:n_simple]
        size = pieces_of[others]
        piece[np.repeat(start[others] - (np.cumsum(size) - size), size) + np.arange(len(found))] = codes[n_simple:]

        _, offs, raw = distinct.buffers()
        offsets = np.frombuffer(offs, np.int64, len(distinct) + 1, distinct.offset * 8) if len(distinct) else np.zeros(1, np.int64)
        data = (np.frombuffer(raw, np.uint8) if raw else np.zeros(0, np.uint8))[offsets[0] : offsets[-1]]
        ids, counts = self.replay(data, offsets - offsets[0])
        ids, counts = gather(ids, counts, piece)  # tokens of segments
        n_tokens = np.add.reduceat(np.append(counts, 0), start)[: len(start)] if len(start) else np.zeros(0, np.int64)
        n_tokens[pieces_of == 0] = 0
        ids, counts = gather(ids, n_tokens, key)
        upto = np.concatenate([[0], np.cumsum(counts)])
        return ids, upto[at]

    def decode(self, ids: np.ndarray) -> bytes:
        return gather(self.blob, self.lengths, ids)[0].tobytes()


def gather(flat: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs that lie in a row in flat: the runs ``which`` in a row, and their sizes."""
    begins = np.cumsum(sizes) - sizes
    own = sizes[which]
    return flat[np.repeat(begins[which] - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))], own


def encode_documents(documents: DataFrame, ranks: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """Token counts and digests of ids and decoded bytes for all documents; with keep_ids, also ``ids`` (array of int)."""
    import pyspark.sql.types as T

    schema = T._parse_datatype_string(SCHEMA + (", ids array<int>" if keep_ids else ""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = RankTable.of(ranks, pattern)
        for batch in batches:
            k = 0
            for ids, at in table.encode(batch.column(1)):
                n = len(at) - 1
                stored = ids.astype("<u4")
                out = [
                    batch.column(0)[k : k + n],
                    pa.array(np.diff(at), pa.int64()),
                    pa.array([hashlib.sha256(stored[at[i] : at[i + 1]]).hexdigest() for i in range(n)]),
                    pa.array([hashlib.sha256(table.decode(ids[at[i] : at[i + 1]])).hexdigest() for i in range(n)]),
                ]
                if keep_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32())))
                yield pa.RecordBatch.from_arrays(out, names=schema.names)
                k += n

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def decode_ids(encoded: DataFrame, ranks: str, pattern: str, ids_column: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded`` (binary): the bytes of each row's ids; null ids give null."""
    import pyspark.sql.types as T

    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = RankTable.of(ranks, pattern)
        for batch in batches:
            got = [None if x is None else table.decode(np.array(x, np.int64)) for x in batch.column(batch.schema.get_field_index(ids_column)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.binary())], names=schema.names)

    return encoded.mapInArrow(run, schema)

"""Best-fit packing of tokenised documents into fixed-length sequences.

``encode`` turns every text into token pieces, ``pack`` places pieces into
sequences.  Packing is bounded-space online best-fit: at most ``open_bins``
sequences are open in a task, a bitset has one bit for each amount of free space
that an open sequence has, the best place for a piece is the lowest set bit at or
above its length, and when too many are open the fullest one closes first.  Pieces
are dealt evenly to tasks of about ``task_pieces``; a task takes them in shares of
``share``, a share's longest pieces first, and keeps its open sequences from one
share to the next, so short pieces of later shares fill what earlier ones left.

Defined results: a null text counts as empty and gives one piece that holds the
closing id only; repeated rows and repeated ids are separate documents; an empty
table gives an empty result; columns besides the id and the text are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textcore as tc
from .shared import released, settle

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Texts of chunks that a worker remembers; the memory is emptied when full.
REMEMBERED = 150_000
SPECIAL = "<|endoftext|>"

# Bytes that surely are no white space in any alphabet: printable ASCII, and lead bytes outside
# the blocks that hold Unicode's other spaces.
_AFTER = np.zeros(256, bool)
_AFTER[0x21:0x7F] = True
_AFTER[0xC3:0xE1] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[0x21:0x7F] = True
_TWO = np.zeros(256, bool)
_TWO[0xC3:0xE0] = True


class Encoder:
    """Ids of whole texts, with chunks between safe spaces encoded once.

    A space between two characters that are not white space always opens a new
    token of the byte-level pattern, so text may be cut before it and each
    distinct chunk encoded alone.
    """

    def __init__(self, tokenizer: str, ranks: str | None) -> None:
        self.tokenizer = tokenizer
        self.whole = None
        self.fast = None
        self.known: dict[bytes, list[int]] = {}
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def full(self, texts: list[str]) -> list[list[int]]:
        if self.whole is None:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.tokenizer)
        return [x.ids for x in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def chunks(self, pieces: list[bytes]) -> list[list[int]]:
        known, out, missing = self.known, [], []
        for x in pieces:
            ids = known.get(x)
            if ids is None:
                missing.append(len(out))
            out.append(ids)
        if missing:
            texts = [pieces[i].decode() for i in missing]
            found = list(map(self.fast.encode_ordinary, texts)) if self.fast else self.full(texts)
            if len(known) + len(found) > REMEMBERED:
                known.clear()
            for i, ids in zip(missing, found):
                out[i] = ids
                if len(pieces[i]) < 64:
                    known[pieces[i]] = ids
        return out

    def batch(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a batch with 0 after each text, and where each text's ids begin."""
        body, off = tc.raw(text)
        rows = len(off) - 1
        before = np.zeros(len(body), bool)
        if len(body) > 2:
            left = _PLAIN[body[:-2]]
            left[1:] |= (body[1:-2] >= 0x80) & _TWO[body[:-3]]
            before[1:-1] = (body[1:-1] == 0x20) & left & _AFTER[body[2:]]
        # A cut next to a row's edge is no cut inside the row.
        inner = off[(off > 0) & (off < len(body))]
        before[inner] = False
        before[inner - 1] = False
        cuts = np.union1d(np.flatnonzero(before), off[:-1][off[:-1] < off[1:]])
        ends = np.append(cuts[1:], len(body)) if len(cuts) else cuts
        arrow = pa.Array.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(np.append(cuts, ends[-1:]).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(body))])
        coded = arrow.dictionary_encode()
        lists = self.chunks(coded.dictionary.to_pylist())
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.searchsorted(off, cuts, "right") - 1
        lists.append([0])
        code = np.insert(code, np.searchsorted(row, np.arange(rows), "right"), len(lists) - 1)
        row = np.sort(np.concatenate([row, np.arange(rows)]), kind="stable")
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum()))
        starts = np.cumsum(sizes) - sizes
        n = sizes[code]
        at = np.repeat(starts[code] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return flat[at], np.append(0, np.cumsum(np.bincount(row, weights=n, minlength=rows).astype(np.int64)))


@lru_cache(2)
def _encoder(tokenizer: str, ranks: str | None) -> Encoder:
    return Encoder(tokenizer, ranks)


def cut(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """Start and length of each piece of a document of ``n`` ids: only the first may be shorter."""
    at = 0
    if n > capacity and n % capacity:
        at = n % capacity
        yield 0, at
    while at < n:
        yield at, min(capacity, n - at)
        at += capacity


def encode(df: DataFrame, tokenizer: str, ranks: str | None = None, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    ``tokenizer`` is a file of the library ``tokenizers``; ``ranks`` may name the
    same vocabulary as ranks, which encodes single chunks faster.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer, ranks)
        for batch in batches:
            key, text = batch.column(0), batch.column(1)
            for lo, hi in tc.slices(text):
                part, ids = text.slice(lo, hi - lo), key.slice(lo, hi - lo).to_pylist()
                flat, off = encoder.batch(part)
                special = [] if SPECIAL not in "".join(x or "" for x in part.to_pylist()) else [i for i, x in enumerate(part.to_pylist()) if x and SPECIAL in x]
                apart = dict(zip(special, encoder.full([part[i].as_py() for i in special]))) if special else {}
                flat = flat.astype("<u4")
                rows = []
                for i, doc in enumerate(ids):
                    own = np.array([*apart[i], 0], "<u4") if i in apart else flat[off[i] : off[i + 1]]
                    for k, (start, n) in enumerate(cut(len(own), capacity)):
                        piece = own[start : start + n]
                        rows.append((doc, k, start, n, zlib.crc32(piece.tobytes()), piece if with_ids else None))
                cols = list(zip(*rows))
                arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:5])]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array(cols[5], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    return df.select("doc_id", "text").mapInArrow(released(run), PIECES + (", ids array<int>" if with_ids else ""))


class Bins:
    """Open sequences by free space; pieces are placed as they come."""

    def __init__(self, capacity: int, open_bins: int) -> None:
        self.capacity, self.open_bins = capacity, open_bins
        self.free_bits, self.open, self.bins = 0, 0, 0
        self.stacks: list[list[int]] = [[] for _ in range(capacity + 1)]

    def take(self, free: int) -> int:
        """A bin with so much free space, no longer among the open ones."""
        b = self.stacks[free].pop()
        if not self.stacks[free]:
            self.free_bits &= ~(1 << free)
        self.open -= 1
        return b

    def place(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bin and offset of each piece, in the given order."""
        where, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
        for i, size in enumerate(sizes.tolist()):
            fits = self.free_bits >> size
            if fits:
                free = size + (fits & -fits).bit_length() - 1
                b = self.take(free)
            else:
                free, b = self.capacity, self.bins
                self.bins += 1
            where[i], offset[i] = b, self.capacity - free
            free -= size
            if free:
                self.stacks[free].append(b)
                self.free_bits |= 1 << free
                self.open += 1
                if self.open > self.open_bins:
                    self.take((self.free_bits & -self.free_bits).bit_length() - 1)
        return where, offset


def best_fit(sizes: np.ndarray, capacity: int, open_bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, taken in the given order, by bounded-space best-fit."""
    return Bins(capacity, open_bins).place(sizes)


def pack(pieces: DataFrame, capacity: int = 2048, open_bins: int = 4096, task_pieces: int = 64_000, share: int = 8000) -> DataFrame:
    """Adds sequence_id and offset to pieces of at most ``capacity`` ids.

    The pieces are settled first, as their number decides how many tasks pack.
    They are dealt in turn, so repeated rows spread like others.  A task holds its
    pieces without ids, 64,000 rows of some 50 bytes, and sorts them first, so one
    that runs again gives the same places.
    """
    pieces = settle(pieces)
    tasks = max(1, -(-pieces.count() // task_pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        table = table.take(pa.compute.sort_indices(table, [("ids_crc32", "ascending"), ("doc_id", "ascending"), ("piece", "ascending"), ("length", "descending")]))
        bins = Bins(capacity, open_bins)
        for at in range(0, len(table), share):
            own = table.slice(at, share)
            own = own.take(pa.compute.sort_indices(own, [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")]))
            where, offset = bins.place(own["length"].to_numpy())
            where += TaskContext.get().partitionId() << 32
            own = own.append_column("sequence_id", pa.array(where)).append_column("offset", pa.array(offset))
            yield from own.combine_chunks().to_batches(max_chunksize=20_000)

    return pieces.repartition(tasks).mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long")

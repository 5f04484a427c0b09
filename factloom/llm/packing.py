"""Best-fit packing of documents into sequences by swap-based local search.

Documents longer than a sequence are cut; a piece that fills a sequence is a sequence. The other pieces are dealt at
random to groups of about GROUP_PIECES, and each group is packed on its own: each piece, as it comes, goes to the bin that it
fits best, and local search then moves pieces and exchanges one for one or two for one between any two bins that aren't full. Each
exchange raises the sum of squared fills, which drains the emptiest bins until they can go; it ends when no exchange does or no bin
can go. Where more bins are left than the sum of lengths needs, a kick opens some full bins (OPENED for each that isn't), and the
search goes on among these and the others, until KICKS kicks (more in a small group) have saved none. If more are left still, the search also starts
from the pieces in descending order, and the better packing counts. A group loses at most a part of its last bins, so that the loss stays at about 1 / (bins of a group) at
any size of the input.

Nulls: a null text is an empty one; a null doc_id is kept. Every text holds at least the end id, so that empty texts have
one piece. Repeated rows are packed once each. Empty table: no piece. Other columns aren't read.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import ship, text_of, written
from .encoding import encoder

GROUP_PIECES = 16_000
KICKS, OPENED = 2, 6
#: A group of few pieces is kicked more often: so many pieces may be looked at again in vain.
IDLE_PIECES = 10_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


# --- packing one group ----------------------------------------------------------------------------------------------


def best_fit(lengths: list[int], capacity: int, as_given: bool = False) -> list[list[int]]:
    """Best fit, of the pieces in descending order or as they are given. Open bins are kept by what they have left; a bit set finds the least that is enough."""
    by_left: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_sizes, bins = 0, []
    for i in range(len(lengths)) if as_given else sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        fits = open_sizes >> n
        if fits:
            left = n + (fits & -fits).bit_length() - 1
            b = by_left[left].pop()
            if not by_left[left]:
                open_sizes &= ~(1 << left)
            bins[b].append(i)
        else:
            left, b = capacity, len(bins)
            bins.append([i])
        left -= n
        if left:
            by_left[left].append(b)
            open_sizes |= 1 << left
    return bins


class _Open:
    """Open bins by what they hold and the pieces in them: which lengths can come out of a bin with a given fill."""

    def __init__(self, bins: list[list[int]], lengths: list[int], capacity: int):
        self.capacity, self.clock = capacity, 0
        self.items = [sorted((lengths[i], i) for i in b) for b in bins]
        self.fill = [sum(n for n, _ in x) for x in self.items]
        self.where: dict[int, dict[int, set[int]]] = {}  # fill, length: bins
        self.bits: dict[int, int] = {}  # fill: its lengths, and 0 if there is a bin
        self.added: dict[int, int] = {}  # fill: when a bin was last put there
        self.count = self.total = 0
        for b, n in enumerate(self.fill):
            if 0 < n < capacity:
                self.put(b)

    def put(self, b: int, fresh: bool = True) -> None:
        n = self.fill[b]
        at = self.where.setdefault(n, {})
        for x in {0, *(x for x, _ in self.items[b])}:
            at.setdefault(x, set()).add(b)
            self.bits[n] = self.bits.get(n, 0) | 1 << x
        if fresh:
            self.clock += 1
            self.added[n] = self.clock
        self.count, self.total = self.count + 1, self.total + n

    def take(self, b: int) -> None:
        n = self.fill[b]
        at = self.where[n]
        for x in {0, *(x for x, _ in self.items[b])}:
            at[x].discard(b)
            if not at[x]:
                del at[x]
                self.bits[n] &= ~(1 << x)
        if not at:
            del self.where[n], self.bits[n]
        self.count, self.total = self.count - 1, self.total - n

    def exchange(self, s: int, since: int) -> tuple[int, int, int, bool] | None:
        """For a bin s that isn't among the open ones: the fullest bin with an exchange that raises the squared fill, and of its
        exchanges the one that moves most: (bin, length out of s, length back, whether two pieces go). Only fills at which bins
        were put after `since` are looked at; the others had none then, and bins that left can't make one."""
        own, lens = self.fill[s], [n for n, _ in self.items[s]]
        one = two = 0
        for n in lens:
            one |= 1 << n
        seen = 0
        for k, n in enumerate(lens):  # sums of two pieces: those before, moved up by this one
            two |= seen << n
            seen |= 1 << n
        top = max(one.bit_length(), two.bit_length()) - 1
        for n in sorted((n for n in self.where if self.added[n] > since and n + top > own), reverse=True):
            room, least = min(self.capacity - n, top), max(1, own - n + 1)
            have = self.bits[n]
            pieces = have & ~1
            best = (0, 0, 0, False)
            for sums, inside, pair in ((one, have, False), (two, pieces, True)):
                if sums.bit_count() < room - max(least, best[0] + 1):  # by sums, else by gains
                    while sums:
                        a = sums.bit_length() - 1
                        sums ^= 1 << a
                        low = max(0, a - room)
                        if rest := inside >> low:
                            x = low + (rest & -rest).bit_length() - 1
                            if a - x >= least and a - x > best[0]:
                                best = (a - x, a, x, pair)
                else:
                    for gain in range(room, max(least, best[0] + 1) - 1, -1):
                        if met := (sums >> gain) & inside:
                            x = met.bit_length() - 1
                            best = (gain, x + gain, x, pair)
                            break
            if best[0]:
                return min(self.where[n][best[2]]), *best[1:]
        return None

    def pick(self, b: int, length: int, pair: bool) -> list[tuple[int, int]]:
        """Takes one piece, or two pieces, of that length out of b's items."""
        items = self.items[b]
        if not pair:
            return [items.pop(bisect_left(items, (length, -1)))]
        i, j = 0, len(items) - 1
        while items[i][0] + items[j][0] != length:
            i, j = (i + 1, j) if items[i][0] + items[j][0] < length else (i, j - 1)
        return [items.pop(j), items.pop(i)]


def improve(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Local search: takes from the emptiest bins and fills others, until no exchange between any two bins raises the squared
    fill, or the sum of lengths needs all bins that there are."""
    now = _Open(bins, lengths, capacity)
    looked = [0] * len(bins)  # when a bin was last found to have no exchange
    changed = True
    while changed:
        changed = False
        for s in sorted((b for b, n in enumerate(now.fill) if 0 < n < capacity), key=lambda b: now.fill[b]):
            if now.total > (now.count - 1) * capacity:
                return [[i for _, i in x] for x in now.items if x]  # no bin can be saved
            if not 0 < now.fill[s] < capacity:
                continue  # filled meanwhile
            now.take(s)
            fresh = False
            while now.fill[s] and (found := now.exchange(s, looked[s])):
                to, out, back, pair = found
                now.take(to)
                moved = now.pick(s, out, pair)
                returned = now.pick(to, back, False) if back else []
                for x in moved:
                    insort(now.items[to], x)
                for x in returned:
                    insort(now.items[s], x)
                now.fill[s] += back - out
                now.fill[to] += out - back
                looked[s] = looked[to] = 0
                fresh = changed = True
                if now.fill[to] < capacity:
                    now.put(to)
            if now.fill[s]:
                looked[s] = now.clock
                now.put(s, fresh)
    return [[i for _, i in x] for x in now.items if x]


def pack_lengths(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indexes, each of at most `capacity`."""
    found = improve(best_fit(lengths, capacity, as_given=True), lengths, capacity)
    need, draw, idle = -(-sum(lengths) // capacity), random.Random(len(lengths)), 0
    while len(found) > need and idle < max(KICKS, IDLE_PIECES // len(lengths)):
        left = [sum(lengths[i] for i in b) < capacity for b in found]
        shut = [b for b, open_ in enumerate(left) if not open_]
        again = {b for b, open_ in enumerate(left) if open_} | set(draw.sample(shut, min(len(shut), OPENED * (len(found) - len(shut)))))
        items = [i for b in sorted(again) for i in found[b]]
        own = [lengths[i] for i in items]
        better = improve(best_fit(own, capacity), own, capacity)
        idle = 0 if len(better) < len(again) else idle + 1
        if not idle:
            found = [x for b, x in enumerate(found) if b not in again] + [[items[i] for i in x] for x in better]
    if len(found) <= need:
        return found  # no packing has fewer
    return min(found, improve(best_fit(lengths, capacity), lengths, capacity), key=len)


# --- tables ---------------------------------------------------------------------------------------------------------


def _pieces(tokenizer: str, end_id: int | None, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        tail = b"" if end_id is None else np.array([end_id], enc.dtype).tobytes()
        for batch in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.frombuffer(enc.encode(text) + tail, enc.dtype).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    own = ids[start : start + capacity].tobytes()
                    for to, v in zip(rows, (doc, piece, start, len(own) // 4, zlib.crc32(own), own), strict=True):
                        to.append(v)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 6 if with_ids else 5]
            yield pa.record_batch([pa.array(v, t) for v, t in zip(rows, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(kinds)])

    return run


def pieces(df: DataFrame, tokenizer: str, end_id: int | None = None, capacity: int = 2048, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Each document's pieces of at most `capacity` ids: (doc_id, piece, start, length, ids_crc32) and, if asked for, ids
    as little-endian unsigned 32-bit integers."""
    ship(df.sparkSession)
    own = df.select(df[doc_id].cast("long").alias("doc_id"), text_of(df, text).alias("text"))
    return own.mapInArrow(_pieces(tokenizer, end_id, capacity, with_ids), PIECES + (", ids binary" if with_ids else ""))


def _packed(capacity: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        lengths = group["length"].tolist()
        base = int(group["_group"].iloc[0]) << 32
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for b, items in enumerate(pack_lengths(lengths, capacity)):
            at = 0
            for i in items:
                sequence[i], offset[i] = base + b, at
                at += lengths[i]
        return group[["doc_id", "piece", "start", "length", "ids_crc32"]].assign(sequence_id=sequence, offset=offset)

    return run


def pack(found: DataFrame, capacity: int = 2048, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds sequence_id and offset to pieces(). found is written first: the groups are dealt by a row's place in it."""
    table = written(found, "pieces")
    full, rest = table.filter(F.col("length") >= capacity), table.filter(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // group_pieces))
    # sequence numbers of full pieces lie below zero
    whole = full.withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    dealt = rest.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    packed = dealt.groupBy("_group").applyInPandas(_packed(capacity), PIECES + ", sequence_id long, offset long")
    return whole.unionByName(packed)


def sequences(packed: DataFrame, found_with_ids: DataFrame, fill_id: int = 0) -> DataFrame:
    """(sequence_id, length, ids array<int>): the sequences themselves. packed: of pack(); found_with_ids: pieces(with_ids=True)
    of the same documents, which must have distinct doc_ids. A group is one sequence."""
    joined = packed.join(found_with_ids.select("doc_id", "piece", "ids"), ["doc_id", "piece"])

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("offset")
        ids = np.frombuffer(b"".join(rows["ids"]), "<u4").astype(np.int32)
        return pd.DataFrame({"sequence_id": [rows["sequence_id"].iloc[0]], "length": [len(ids)], "ids": [ids]})

    return joined.groupBy("sequence_id").applyInPandas(whole, "sequence_id long, length long, ids array<int>")

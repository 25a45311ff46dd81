"""Near-duplicate records over tables too large for pairwise comparison (problem 5).

Each record is the set of its character shingles. Two sets as similar as asked differ in a bounded number of shingles, so if the
universe of all shingles is partitioned, they differ in few of the parts (pigeonhole). The partition has two levels.

* Parts. Hashing splits the universe into a few parts, a part a bucket of its own. A similar pair is at least as similar as asked
  within one part at least, for if it differed by more everywhere, it would differ by more altogether. So every bucket
  is a small similarity join of its own: records of some forty shingles of two bytes each.
* Segments. Within a bucket and a band of sizes (of the smaller record) hashing splits the part into segments. The larger record
  is indexed with all its segments and their one-deletion neighbourhoods. The smaller one is allocated as many units as
  a similar record can differ in, and one more: one unit on a segment looks its contents up, so the segments must be equal; a second
  unit looks up its one-deletion neighbourhood, so they may differ in one shingle. If a pair is similar, at least one
  segment differs by less than its units. The units go where they cost least, by the lengths of the lists in the index of
  the bucket, counted exactly but for collisions of slots.

Pairs found are compared by parity sketches of the part, which never differ in more bits than the sets in shingles, and then
exactly, on the whole sets.

Guarantee. Every pair of at least the threshold is found, whatever the texts; costs decide only about the work. Nothing is capped.

Scale. Records are identified by a 64-bit hash of their text, so exact copies fold into one already in the map task; of n different
texts two share a hash with a chance of n^2 / 2^65. What is shuffled is two bytes for each shingle and some twenty bytes for each
record and part, packed in one blob per map batch and bucket. However large a bucket is, that is shuffled once: a task keeps these bytes and makes
hashes of a few segments at a time; where a bucket would hold more than ``records_per_bucket`` records, several tasks read
the same shuffled bytes, each for its share of the bands of sizes. No table, link or component is collected or broadcast.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawloom.session import materialize, spread

_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)
_BATCH_CHARS = 6_000_000
_FEW = 250_000
#: Parts of the universe for records of at least ``_WHOLE`` shingles; smaller records have one part.
_PARTS = 12
_WHOLE = 128
#: Sizes within a band differ by this factor at most; segments for each unit a record of the band may need.
_RATIO = 1.4
_SEGMENTS = 0.6
#: Shingles whose hashes are made at a time.
_CHUNK = 1_000_000


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values in order. Sorting is several times faster here than the hash table of ``np.unique``."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def shingle_sets(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the distinct shingles of each text, one after the other, and the number of each text's."""
    sizes = np.zeros(len(texts), np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(_U)
    if len(codes) < width:
        return np.zeros(0, _U), sizes
    h = np.zeros(len(codes) - width + 1, _U)
    for j in range(width):
        h = h * _U(0x100000001B3) + codes[j : len(codes) - width + 1 + j] + _U(1)
        h ^= h >> _U(29)
        h *= _GOLD
    out, at = [], 0
    for i, t in enumerate(texts):
        end = at + len(t) - width + 1
        if end > at:
            u = _distinct(h[at:end])
            sizes[i] = len(u)
            out.append(u)
        at += len(t)
    return (np.concatenate(out) if out else np.zeros(0, _U)), sizes


def _runs(keys: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(entries by key, distinct keys, their first places, their counts); both of 32 bits, sorted as one number of 64."""
    both = keys.astype(_U)
    both <<= _U(32)
    both |= entries.astype(np.uint32)
    both.sort()
    k = (both >> _U(32)).astype(np.uint32)
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return both.astype(np.uint32), k[first], first, np.diff(np.append(first, len(k)))


def _slices(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The indices of slices, one after the other."""
    return np.repeat(start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))


def _bands(largest: int) -> Iterator[tuple[int, int]]:
    """(least, greatest) sizes of the bands up to ``largest``."""
    low = 1
    while low <= largest:
        high = max(low, int(low * _RATIO))
        yield low, high
        low = high + 1


def _most(threshold: float, sizes) -> np.ndarray:
    """In how many shingles a record of these sizes and a larger one as similar as asked can differ."""
    return np.floor((1 - threshold) / threshold * np.asarray(sizes) + 1e-9).astype(np.int64)


def _value(token: np.ndarray) -> np.ndarray:
    """The hash of each token that segments and sums of contents go by."""
    return _mix(token.astype(_U) + _GOLD)


def _sketches(record: np.ndarray, value: np.ndarray, records: int, words: int) -> np.ndarray:
    """Parity sketches: bit i tells whether an odd number of tokens fell on i."""
    bit = value & _U(64 * words - 1)
    out = np.zeros(records * words, _U)
    np.bitwise_xor.at(out, record * words + (bit >> _U(6)).astype(np.int64), _U(1) << (bit & _U(63)))
    return out.reshape(records, words)


class _Band:
    """The records of a bucket from place ``s0`` to ``l1`` cut into ``m`` segments. Nothing is kept of a shingle but its two bytes and one for
    its segment; the contents of segments are made for some segments at a time, from chunks of records."""

    def __init__(self, start: np.ndarray, token: np.ndarray, s0: int, l1: int, m: int, band: int, words: int):
        self.start, self.token, self.m, self.records = start[s0 : l1 + 1] - start[s0], token[start[s0] : start[l1]], m, l1 - s0
        self.salt = _mix(np.arange(m).astype(_U) + _U(band * 1_000_003 + 1))
        cuts = np.searchsorted(self.start, np.arange(_CHUNK, len(self.token), _CHUNK))
        self.chunks = [(int(a), int(b)) for a, b in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [self.records]])) if b > a]
        self.segment = np.empty(len(self.token), np.uint8 if m <= 256 else np.uint32)
        self.sketch = np.zeros((self.records, words), _U)
        for a, b in self.chunks:
            value = _value(self.token[self.start[a] : self.start[b]])
            self.segment[self.start[a] : self.start[b]] = (value >> _U(40)) % _U(m)
            self.sketch[a:b] = _sketches(self._owner(a, b), value, b - a, words)

    def _owner(self, a: int, b: int) -> np.ndarray:
        return np.repeat(np.arange(b - a), np.diff(self.start[a : b + 1]))

    def contents(self, g0: int, g1: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of segments ``g0`` to ``g1``: 32 bits of the contents of each cell (record and segment), empty ones included; and for each
        shingle there its record, its cell and the contents of the cell without it."""
        k, all_of_them = g1 - g0, g1 - g0 == self.m
        exact, at = np.empty(self.records * k, np.uint32), 0
        held = len(self.token) if all_of_them else sum(int(np.count_nonzero((x >= g0) & (x < g1))) for x in np.array_split(self.segment, len(self.chunks)))
        record, all_cells, all_less = np.empty(held, np.uint32), np.empty(held, np.uint32), np.empty(held, np.uint32)
        for a, b in self.chunks:
            t0, t1 = self.start[a], self.start[b]
            owner, segment = self._owner(a, b), self.segment[t0:t1].astype(np.int64)
            inside = slice(None) if all_of_them else np.flatnonzero((segment >= g0) & (segment < g1))
            owner, segment, value = owner[inside], segment[inside], _value(self.token[t0:t1][inside])
            cell = owner * k + (segment - g0)
            sums = np.zeros((b - a) * k, _U)
            np.add.at(sums, cell, value)
            exact[a * k : b * k] = _mix(sums + np.tile(self.salt[g0:g1], b - a)) >> _U(32)
            here = slice(at, at := at + len(value))
            record[here], all_cells[here] = owner + a, cell + a * k
            all_less[here] = _mix(sums[cell] - value + self.salt[segment]) >> _U(32)
        return exact, record, all_cells, all_less


def _counted(keys: np.ndarray, shift: int, slots: int) -> np.ndarray:
    """How many keys fall into each slot."""
    out = np.zeros(slots, np.int32)
    for x in range(0, len(keys), _CHUNK):
        np.add.at(out, keys[x : x + _CHUNK] >> shift, np.int32(1))
    return out


def _bucket_pairs(total: np.ndarray, size: np.ndarray, held: np.ndarray, token: np.ndarray, threshold: float, spent: dict | None = None, chunk: int = 1_000_000, at_once: int = 3_000_000, bands: tuple[int, int] = (0, 1)) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of records of a bucket that may be similar within its part. Records come in the order of ``size``, their shingles
    in the part; ``total`` are their shingles altogether, ``held`` how many of the flat ``token`` (fingerprints) are theirs.

    A band with more than ``at_once`` shingles is worked through in groups of segments, for only segments of one place are
    compared: costs first, group by group, then the units of each group. ``bands`` (i, n): every n-th band, from the i-th."""
    if not len(size):
        return
    start = np.concatenate([[0], np.cumsum(held)])
    share = (1 - threshold) / (1 + threshold)
    for low, high in list(_bands(int(size[-1])))[bands[0] :: bands[1]]:
        s0, s1 = np.searchsorted(size, [low, high + 1])
        l1 = int(np.searchsorted(size, int(high / threshold + 1e-9) + 1))
        small, large = int(s1 - s0), int(l1 - s0)
        if not small or large < 2:
            continue
        m = max(1, int(np.ceil(_SEGMENTS * (int(_most(threshold, high)) + 1))))
        words = 1 << max(2, int(np.ceil(np.log2(high / 16))))
        band = _Band(start, token, int(s0), l1, m, high, min(words, 1024))
        n_groups = min(m, max(1, -(-len(band.token) // at_once)))
        groups = [(g * m // n_groups, (g + 1) * m // n_groups) for g in range(n_groups)]
        shift = 32 - max(10, min(24, int(np.ceil(np.log2((len(band.token) + large * m) / n_groups + 4)))))
        slots = 1 << (32 - shift)
        # lengths of lists, counted in slots: those of equal contents, and those reached by one deletion on either side
        cost = np.empty((small, 2 * m), np.int32)
        for g0, g1 in groups:
            k = g1 - g0
            made = exact = record = cell = less = n_exact = n_less = one = two = None  # before the next ones are made
            exact, record, cell, less = made = band.contents(g0, g1)
            n_exact, n_less = _counted(exact, shift, slots), _counted(less, shift, slots)
            mine = int(np.searchsorted(record, small))  # shingles of the smaller records
            one = n_exact[exact[: small * k] >> shift].reshape(small, k)
            two = np.zeros(small * k, np.int64)
            np.add.at(two, cell[:mine], n_exact[less[:mine] >> shift])
            two = (two + n_less[exact[: small * k] >> shift]).reshape(small, k)
            # a second unit comes after the first of its segment, so it must not be cheaper
            cost[:, g0:g1] = np.minimum(one, 1 << 29) * 2
            cost[:, m + g0 : m + g1] = np.minimum(np.maximum(one, two), 1 << 29) * 2 + 1
        take = np.empty((small, 2 * m), bool)
        for x in range(0, small, max(1, _CHUNK // m)):
            part = slice(x, x + max(1, _CHUNK // m))
            rank = np.empty(cost[part].shape, np.int64)
            np.put_along_axis(rank, np.argsort(cost[part], axis=1, kind="stable"), np.arange(2 * m)[None, :], 1)
            take[part] = rank < (_most(threshold, size[s0:s1][part]) + 1)[:, None]
        del cost
        for g0, g1 in groups:
            k = g1 - g0
            if n_groups > 1:
                made = exact = record = cell = less = n_exact = n_less = lists = None
            exact, record, cell, less = made or band.contents(g0, g1)
            made = None
            n_exact = _counted(exact, shift, slots) if n_exact is None else n_exact
            mine = int(np.searchsorted(record, small))
            first, second = take[:, g0:g1].ravel(), take[:, m + g0 : m + g1].ravel()
            cells, cells2 = np.flatnonzero(first), np.flatnonzero(second)
            dropped = np.flatnonzero(second[cell[:mine]])
            dropped = dropped[n_exact[less[dropped] >> shift] > 0]
            asked = np.zeros(slots, bool)
            asked[exact[cells] >> shift] = True
            asked[less[dropped] >> shift] = True
            e = np.flatnonzero(asked[exact >> shift])
            e_records, e_keys, e_first, e_count = _runs(exact[e], e // k)
            asked[:] = False
            asked[exact[cells2] >> shift] = True
            d = np.flatnonzero(asked[less >> shift])
            d_records, d_keys, d_first, d_count = _runs(less[d], record[d])
            if spent is not None:
                spent["one"] = spent.get("one", 0) + len(cells) - len(cells2)
                spent["two"] = spent.get("two", 0) + len(cells2)
            lists = (
                (cells // k, exact[cells], e_keys, e_first, e_count, e_records),
                (cells2 // k, exact[cells2], d_keys, d_first, d_count, d_records),
                (record[dropped].astype(np.int64), less[dropped], e_keys, e_first, e_count, e_records),
            )
            del exact, record, cell, less, e, d, dropped
            for who, asks, keys, starts, counts, entries in ((w[x : x + _CHUNK // 2], q[x : x + _CHUNK // 2], *index) for w, q, *index in lists if len(index[0]) for x in range(0, len(w), _CHUNK // 2)):
                i = np.minimum(np.searchsorted(keys, asks), len(keys) - 1)
                hit = keys[i] == asks
                who, places, width = who[hit], starts[i[hit]], counts[i[hit]]
                ends, at = np.cumsum(width), 0
                while at < len(who):
                    stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + chunk, "right")))
                    a, b = np.repeat(who[at:stop], width[at:stop]), entries[_slices(places[at:stop], width[at:stop])].astype(np.int64)
                    at = stop
                    ok = b > a
                    a, b = a[ok] + s0, b[ok] + s0
                    ok = (size[a] >= threshold * size[b] - 1e-9) & (np.minimum(total[a], total[b]) >= threshold * np.maximum(total[a], total[b]) - 1e-9)
                    a, b = a[ok], b[ok]
                    step = max(1, chunk // band.sketch.shape[1])
                    keep = [np.zeros(0, np.int64)]
                    for x in range(0, len(a), step):
                        differ = np.bitwise_count(band.sketch[a[x : x + step] - s0] ^ band.sketch[b[x : x + step] - s0]).sum(1, dtype=np.int64)
                        keep.append(x + np.flatnonzero(differ <= share * (size[a[x : x + step]] + size[b[x : x + step]]) + 1e-9))
                    kept = np.concatenate(keep)
                    pair = _distinct(a[kept] * np.int64(len(size)) + b[kept])
                    yield pair // len(size), pair % len(size)


_ROW = np.dtype([("doc", "<i8"), ("total", "<u4"), ("size", "<u4"), ("held", "<u4")])


def _pack(ids: np.ndarray, tok: np.ndarray, sizes: np.ndarray, threshold: float) -> Iterator[tuple[int, bytes]]:
    """(bucket, blob) of a batch of records: heads of the records in the bucket, then their fingerprints, two bytes each."""
    mixed = _mix(tok)
    record = np.repeat(np.arange(len(sizes)), sizes).astype(_U)
    finger = (record << _U(16)) | ((mixed >> _U(16)) & _U(0xFFFF))
    big, near = sizes >= _WHOLE, sizes * threshold < _WHOLE
    whole = np.sort(finger[np.repeat(near, sizes)])
    parted = np.sort((((mixed % _U(_PARTS)) << _U(56)) | finger)[np.repeat(big, sizes)])
    ends = np.searchsorted(parted, np.arange(_PARTS + 1).astype(_U) << _U(56))
    for p in range(_PARTS + 1):
        found = whole if p == 0 else parted[ends[p - 1] : ends[p]] & _U((1 << 56) - 1)
        if not len(found):
            continue
        size = np.bincount((found >> _U(16)).astype(np.int64), minlength=len(sizes))
        # fingerprints of a record that coincide count once
        key = found[np.concatenate([[True], found[1:] != found[:-1]])]
        token = (key & _U(0xFFFF)).astype("<u2")
        held = np.bincount((key >> _U(16)).astype(np.int64), minlength=len(sizes))
        docs = np.flatnonzero(held)
        head = np.empty(len(docs), _ROW)
        head["doc"], head["total"], head["size"], head["held"] = ids[docs], sizes[docs], size[docs], held[docs]
        yield p, np.uint32(len(docs)).tobytes() + head.tobytes() + token.tobytes()


def _within(blob, threshold: float, bands: tuple[int, int]):
    """What a blob holds of the records in reach of the bands asked for."""
    if bands[1] == 1:
        return blob
    n = int(np.frombuffer(blob, np.uint32, 1)[0])
    head, tokens = np.frombuffer(blob, _ROW, n, 4), np.frombuffer(blob, "<u2", -1, 4 + n * _ROW.itemsize)
    reach = np.zeros(int(head["size"].max()) + 1, bool)
    for low, high in list(_bands(len(reach) - 1))[bands[0] :: bands[1]]:
        reach[low : int(high / threshold + 1e-9) + 1] = True
    mine, held = np.flatnonzero(reach[head["size"]]), head["held"].astype(np.int64)
    return np.uint32(len(mine)).tobytes() + head[mine].tobytes() + tokens[_slices((np.cumsum(held) - held)[mine], held[mine])].tobytes()


def _unpack(blobs: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, totals, sizes, held and flat tokens of the records in the order of their sizes; copies folded into one. The list is
    emptied on the way."""
    counts = [int(np.frombuffer(blob, np.uint32, 1)[0]) for blob in blobs]
    heads = [np.frombuffer(blob, _ROW, n, 4) for blob, n in zip(blobs, counts)]
    first = np.cumsum([0, *counts])
    head = np.concatenate(heads)
    del heads
    chosen = np.unique(head["doc"], return_index=True)[1]
    chosen = chosen[np.argsort(head["size"][chosen], kind="stable")]
    held = head["held"][chosen].astype(np.int64)
    to = np.full(len(head), -1, np.int64)  # where the tokens of each row go
    to[chosen] = np.cumsum(held) - held
    flat = np.empty(int(held.sum()), "<u2")
    for i, n in enumerate(counts):
        tokens, rows = np.frombuffer(blobs[i], "<u2", -1, 4 + n * _ROW.itemsize), head["held"][first[i] : first[i + 1]].astype(np.int64)
        mine = np.flatnonzero(to[first[i] : first[i + 1]] >= 0)
        flat[_slices(to[first[i] : first[i + 1]][mine], rows[mine])] = tokens[_slices((np.cumsum(rows) - rows)[mine], rows[mine])]
        blobs[i] = None
    blobs.clear()
    return head["doc"][chosen].astype(np.int64), head["total"][chosen].astype(np.int64), head["size"][chosen].astype(np.int64), held, flat


def _pairs(blobs: list, threshold: float, at_once: int, bands: tuple[int, int] = (0, 1)) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of ids that may be similar within the part of a bucket."""
    ids, total, size, held, token = _unpack(blobs)
    for a, b in _bucket_pairs(total, size, held, token, threshold, at_once=at_once, bands=bands):
        a, b = ids[a], ids[b]
        yield np.minimum(a, b), np.maximum(a, b)


def _batches(lengths: list[int]) -> Iterator[slice]:
    """Slices of at most ``_BATCH_CHARS`` characters, a longer text alone."""
    at = run = 0
    for i, n in enumerate(lengths):
        if i > at and run + n > _BATCH_CHARS:
            yield slice(at, i)
            at, run = i, 0
        run += n
    if at < len(lengths):
        yield slice(at, len(lengths))


def _similarities(left: list[int], right: list[int], texts: dict[int, str], width: int) -> np.ndarray:
    """Jaccard similarity of the shingle sets of the pairs of classes; each text is cut once however many pairs it has."""
    ids = sorted(texts)
    tok, sizes = shingle_sets([texts[i] for i in ids], width)
    start = np.concatenate([[0], np.cumsum(sizes)])
    sets = {i: tok[start[k] : start[k + 1]] for k, i in enumerate(ids)}
    out = np.zeros(len(left))
    for k, (x, y) in enumerate(zip(left, right)):
        a, b = sets[x], sets[y]
        if len(a) > len(b):
            a, b = b, a
        if len(a):
            common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
            out[k] = common / (len(a) + len(b) - common)
    return out


def _partition_keys(spark, partitions: int) -> np.ndarray:
    """One int for each partition that Spark's hash partitioning sends to just that partition: buckets named so lie one in
    each, instead of two or three in some and none in others."""
    ids = spark.range(partitions * 30).select(F.col("id").cast("int").alias("v"))
    found = ids.groupBy(F.pmod(F.hash("v"), F.lit(partitions)).alias("p")).agg(F.min("v").alias("v")).collect()
    keys = np.arange(partitions, dtype=np.int64) + partitions * 30  # a partition no int was found for: any int of its own
    for r in found:
        keys[r.p] = r.v
    return keys


def normalized_text(*columns: str):
    """The columns (null as empty) joined by a space, without white space, in lower case."""
    joined = F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return F.lower(F.regexp_replace(joined, r"(?U)\s+", ""))


def near_duplicate_classes(
    records: DataFrame, id_col: str, text, width: int = 5, threshold: float = 0.7, records_per_bucket: int = 1_000_000, at_once: int = 3_000_000,
) -> tuple[DataFrame, DataFrame]:
    """(membership, links): membership has record_id and class_id, one row per record with a text; records of equal
    text form a class. links has class_a < class_b and similarity, one row per pair of classes with Jaccard similarity
    of their shingle sets of at least ``threshold``.

    ``text`` is the column expression compared. Records whose text is null or shorter than ``width`` have no shingles:
    they are members of a class without links. Repeated ids, other columns and empty tables do no harm; whole texts
    are compared however long.

    ``records_per_bucket`` and ``at_once`` only bound the memory of a task, neither what is compared nor what is shuffled: beyond the
    first a bucket is read by several tasks, each with its share of the bands of sizes; the second is the number
    of shingles of a band that are worked on at a time.
    """
    base = spread(records).select(F.col(id_col).cast("bigint").alias("record_id"), text.alias("t")).where("t is not null")
    base = base.select("record_id", "t", F.xxhash64("t").alias("class_id"))
    count = records.count()
    shares = 1 if count <= records_per_bucket else -(-2 * count // records_per_bucket)
    names_of = _partition_keys(records.sparkSession, _PARTS + 1)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            ids, where = np.unique(whole.column(0).to_numpy(), return_index=True)
            texts = whole.column(1).take(pa.array(where)).to_pylist()
            for cut in _batches([len(t) for t in texts]):
                tok, sizes = shingle_sets(texts[cut], width)
                packed = list(_pack(ids[cut], tok, sizes, threshold))
                names = np.array([name for name, _ in packed], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(names_of[names], pa.int32()), pa.array([blob for _, blob in packed], pa.binary())], ["bucket", "blob"])

    def match(share: int):
        def close(blobs):
            for a, b in _pairs(blobs, threshold, at_once, (share, shares)):
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["class_a", "class_b"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            buckets: dict[int, list] = {}
            for batch in batches:
                for name, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                    buckets.setdefault(name, []).append(_within(blob.as_buffer(), threshold, (share, shares)))
            batch = blob = None
            while buckets:
                yield from close(buckets.popitem()[1])

        return run

    packed = base.select("class_id", "t").mapInArrow(sign, "bucket int, blob binary").repartition(_PARTS + 1, "bucket")
    # every share reads the same shuffled buckets, which are written once
    pairs = functools.reduce(DataFrame.union, [packed.mapInArrow(match(i), "class_a bigint, class_b bigint") for i in range(shares)])
    candidates = materialize(pairs.distinct(), "candidates")

    needed = candidates.select(F.explode(F.array("class_a", "class_b")).alias("class_id")).distinct()
    if needed.limit(_FEW + 1).count() <= _FEW:  # counted: so many ids are a few megabytes; beyond, both sides are shuffled
        needed = F.broadcast(needed)
    texts = base.select("class_id", "t").join(needed, "class_id", "left_semi").groupBy("class_id").agg(F.first("t").alias("t"))
    texts = materialize(texts, "texts")
    full = candidates.join(texts.select(F.col("class_id").alias("class_a"), F.col("t").alias("ta")), "class_a")
    full = full.join(texts.select(F.col("class_id").alias("class_b"), F.col("t").alias("tb")), "class_b")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for cut in _batches((pdf.ta.str.len() + pdf.tb.str.len()).tolist()):
                p = pdf.iloc[cut]
                texts = dict(zip(p.class_a.tolist(), p.ta)) | dict(zip(p.class_b.tolist(), p.tb))
                s = _similarities(p.class_a.tolist(), p.class_b.tolist(), texts, width)
                ok = s >= threshold - 1e-12
                yield pd.DataFrame({"class_a": p.class_a[ok], "class_b": p.class_b[ok], "similarity": s[ok]})

    links = full.select("class_a", "class_b", "ta", "tb").mapInPandas(verify, "class_a bigint, class_b bigint, similarity double")
    return base.select("record_id", "class_id"), materialize(links, "links")


def near_duplicate_groups(membership: DataFrame, links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """record_id, class_id, group_id (the least class of a connected component) and n_links, the links of the class.

    Labels spread along the links, each round also over the labels' own labels, so the rounds grow with the logarithm
    of a component's length; every round is written to the shared folder, nothing is collected but a count. Raises if
    ``max_rounds`` do not suffice, rather than give partial groups.
    """
    edges = links.select(F.col("class_a").alias("a"), F.col("class_b").alias("b"))
    edges = materialize(edges.union(edges.select("b", "a")), "edges")
    labels = edges.select(F.col("a").alias("v")).distinct().withColumn("label", F.col("v"))
    for _ in range(max_rounds):
        near = edges.join(labels, edges["b"] == labels["v"]).select(F.col("a").alias("v"), "label")
        least = near.union(labels).groupBy("v").agg(F.min("label").alias("low"))
        jumps = labels.select(F.col("v").alias("low"), F.col("label").alias("low2"))
        new = least.join(jumps, "low", "left").select("v", F.least("low", F.coalesce("low2", "low")).alias("label"))
        new = materialize(new, "labels")
        moved = new.join(labels.withColumnRenamed("label", "old"), "v").where("label <> old").limit(1).count()
        labels = new
        if not moved:
            break
    else:
        raise RuntimeError("the components did not settle")
    degree = edges.groupBy("a").count().select(F.col("a").alias("class_id"), F.col("count").alias("n_links"))
    out = membership.join(labels.select(F.col("v").alias("class_id"), "label"), "class_id", "left").join(degree, "class_id", "left")
    return out.select("record_id", "class_id", F.coalesce("label", "class_id").alias("group_id"), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"))


def _articles(spark, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/articles.parquet").select("id", "title", "content_text")


def p5_found(spark, root: str) -> DataFrame:
    members, links = near_duplicate_classes(_articles(spark, root).where(F.length("content_text") >= 200), "id", normalized_text("title", "content_text"))
    members = members.join(
        links.select(F.explode(F.array("class_a", "class_b")).alias("class_id")).union(members.groupBy("class_id").count().where("count > 1").select("class_id")).distinct(),
        "class_id", "left_semi",
    )
    members = materialize(members, "members")
    a = members.select(F.col("class_id").alias("class_a"), F.col("record_id").alias("ra"))
    b = members.select(F.col("class_id").alias("class_b"), F.col("record_id").alias("rb"))
    linked = links.join(a, "class_a").join(b, "class_b").select("ra", "rb")
    copies = a.join(b, (F.col("class_a") == F.col("class_b")) & (F.col("ra") < F.col("rb"))).select("ra", "rb")
    both = linked.unionByName(copies)
    return both.select(F.least("ra", "rb").alias("article_id_a"), F.greatest("ra", "rb").alias("article_id_b"))


def p5_groups(spark, root: str) -> DataFrame:
    """One row per article with its class, its group and its number of links; copies are not expanded into pairs. An article
    without any text is like no other: it is a class and a group of its own."""
    articles = _articles(spark, root).withColumn("t", normalized_text("title", "content_text"))
    groups = near_duplicate_groups(*near_duplicate_classes(articles, "id", F.expr("nullif(t, '')")))
    alone = articles.where("t = ''").select(F.col("id").alias("record_id"), F.xxhash64(F.lit("no text"), "id").alias("class_id"))
    return groups.unionByName(alone.select("record_id", "class_id", F.col("class_id").alias("group_id"), F.lit(0).cast("bigint").alias("n_links")))

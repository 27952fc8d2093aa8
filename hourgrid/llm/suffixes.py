"""Suffix-array dedup: bytes covered by a long string that also starts earlier.

A string of LENGTH bytes (a window) is found by its anchor, the K-gram of least hash in it, the leftmost on ties;
equal windows have equal anchors at equal places. Windows of one anchor follow each other and make a segment.
Only segments whose anchor occurs elsewhere can hold a repeated window. Segments that are equal as a whole are
settled by their digests; those that share an anchor but differ go, text and all, into shards by anchor. A shard's
suffix array is made by Larsson-Sadakane refinement, Kasai's common prefixes of LENGTH and more give the classes of
equal windows, and all but the first of a class are repeats. An anchor with very many different segments is split
over several shards; the distinct windows of their suffix arrays are dealt to ranges, where the arrays are merged two by
two, the windows of one sought in the other by binary search."""

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from hourgrid.llm.common import bytes_of, guarded, mixed, spans, staged, table

LENGTH, K = 100, 32
REACH = LENGTH - K + 1
#: Segments of one anchor beyond which the anchor is split over shards, as estimated from every SAMPLE-th one.
HOT, SAMPLE = 1000, 64
#: Bytes of text that are scanned at once, whose equal segments are found before the shuffle, and of segments in one
#: suffix array; more only for one text or anchor.
CHUNK, SCAN, SHARD = 1 << 19, 8 << 20, 1 << 20

_RANDOM = np.random.default_rng(6)
_BYTE = _RANDOM.integers(0, 2**64, 256, np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_STEP), -1, 2**64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, p, np.uint64)])) for p in (_STEP, _BACK))


def segments(buffer: np.ndarray, offsets: np.ndarray, powers: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, ...]:
    """Of all texts: anchor hash, segment digest, text number, first window and number of windows. powers: _powers of
    the buffer's length or more."""
    n = len(buffer)
    none = np.zeros(0, np.int64)
    if n < LENGTH or (np.diff(offsets) < LENGTH).all():
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    ahead, back = powers or _powers(n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[buffer] * ahead[:n])])
    grams = mixed((sums[K:] - sums[:-K]) * back[: n - K + 1])
    bits = np.uint64(int(n).bit_length())
    low = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while width * 2 <= REACH:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < REACH:
        low = np.minimum(low[: len(low) - (REACH - width)], low[REACH - width :])
    anchor = (low & ((np.uint64(1) << bits) - np.uint64(1))).view(np.int64)
    del low
    inside = np.zeros(n + 1, np.int32)
    long = np.diff(offsets) >= LENGTH
    np.add.at(inside, offsets[:-1][long], 1)
    np.add.at(inside, offsets[1:][long] - LENGTH + 1, -1)
    windows = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    at = anchor[windows]
    del anchor, inside
    new = np.ones(len(windows), bool)
    new[1:] = (at[1:] != at[:-1]) | (np.diff(windows) > 1)
    text = np.searchsorted(offsets, windows, "right") - 1
    new[1:] |= text[1:] != text[:-1]
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(windows)))
    start, at, text = windows[begin], at[begin], text[begin]
    del windows
    whole = (sums[start + count + LENGTH - 1] - sums[start]) * back[start]
    digest = mixed(whole + mixed((count * 256 + (at - start)).astype(np.uint64)))
    return grams[at], digest, text, start - offsets[text], count


_PLACE = 8  # bits of the number of windows in `place`: first window * 256 + number


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, digest, id, place, repeat): a row for each occurrence of a segment; repeat: an equal segment stands
    earlier among the SCAN bytes of text that are looked at together. A repeated row is no other occurrence."""
    powers = _powers(CHUNK)
    for batch in batches:
        ids = batch.column("id").to_numpy()
        buffer, offsets = bytes_of(batch.column("text"))
        for first, last in spans(offsets, SCAN):
            parts = [[] for _ in range(4)]
            for i, j in spans(offsets[first : last + 1] - offsets[first], CHUNK):
                i, j = i + first, j + first
                data = buffer[offsets[i] : offsets[j]]
                anchor, digest, text, start, count = segments(data, offsets[i : j + 1] - offsets[i], powers if len(data) <= CHUNK else None)
                for p, x in zip(parts, (anchor, digest, ids[i:j][text], start << _PLACE | count)):
                    p.append(x)
            anchor, digest, doc, place = (np.concatenate(parts.pop(0)) for _ in range(4))
            if not len(anchor):
                continue
            if (np.diff(doc) < 0).any():
                order = np.lexsort((place, doc))
                anchor, digest, doc, place = anchor[order], digest[order], doc[order], place[order]
            order = np.argsort(mixed(anchor ^ digest), kind="stable")
            anchor, digest, doc, place = anchor[order], digest[order], doc[order], place[order]
            head = np.ones(len(anchor), bool)
            head[1:] = (anchor[1:] != anchor[:-1]) | (digest[1:] != digest[:-1])
            fresh = head.copy()
            fresh[1:] |= (doc[1:] != doc[:-1]) | (place[1:] != place[:-1])
            columns = [pa.array(x[fresh].view(np.int64)) for x in (anchor, digest, doc, place)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(~head[fresh])], ["anchor", "digest", "id", "place", "repeat"])


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Rows sorted by keys, as tables that never divide a group, for every batch one (of no row, where the batch ends
    no group); what is held back is the last group alone."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            yield pa.Table.from_batches([batch])
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            x = batch.column(k).to_numpy()
            change[1:] |= x[1:] != x[:-1]
            change[0] |= bool(held) and held[-1].column(k)[-1].as_py() != x[0]
        cut = np.flatnonzero(change)
        done = batch.slice(0, cut[-1] if len(cut) else 0)
        yield pa.Table.from_batches([*held, done] if len(cut) else [done])
        held = [*([] if len(cut) else held), batch.slice(len(done))]
    if held:
        yield pa.Table.from_batches(held)


_SETTLED = ["anchor", "id", "place", "different", "hot"]


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor, split, digest, id, place -> repeats of whole segments (different 0), and the first
    occurrence of every digest of an anchor that has several (different 1). Held back are only the first occurrences
    of the last anchor."""
    before: list | None = None  # the last row so far, and the id and place of its digest's first occurrence

    def heads() -> Iterator[pa.RecordBatch]:
        nonlocal before
        for batch in batches:
            if not batch.num_rows:
                yield batch
                continue
            anchor, split, digest, doc, place = columns = [batch.column(c).to_numpy() for c in ("anchor", "split", "digest", "id", "place")]
            change = [np.concatenate([[before is None or before[k] != x[0]], x[1:] != x[:-1]]) for k, x in enumerate(columns)]
            head = change[0] | change[1] | change[2]
            first = np.maximum.accumulate(np.where(head, np.arange(len(head)), -1))
            of = [np.where(first < 0, before[5 + k] if before else 0, x[first]) for k, x in enumerate((doc, place))]
            again = ~head & ((doc != of[0]) | (place != of[1])) & (change[3] | change[4])
            before = [*(x[-1] for x in columns), of[0][-1], of[1][-1]]
            out = [*(pa.array(x[again]) for x in (anchor, doc, place)), pa.array(np.zeros(again.sum(), np.int32)), pa.array(np.zeros(again.sum(), bool))]
            repeats.append(pa.RecordBatch.from_arrays(out, _SETTLED))
            yield batch.filter(pa.array(head))

    repeats: list[pa.RecordBatch] = []
    for rows in _groups(heads(), ("anchor", "split")):
        yield from repeats
        repeats.clear()
        if not rows.num_rows:
            continue
        anchor, split, doc, place, hot = (rows.column(c).to_numpy() for c in ("anchor", "split", "id", "place", "hot"))
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (split[1:] != split[:-1])
        group = np.cumsum(new) - 1
        keep = (np.bincount(group)[group] > 1) | hot
        yield pa.RecordBatch.from_arrays([*(pa.array(x[keep]) for x in (anchor, doc, place)), pa.array(np.ones(keep.sum(), np.int32)), pa.array(hot[keep])], _SETTLED)
    yield from repeats


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the segments wanted of them -> a row with its bytes for each segment."""
    for batch in batches:
        buffer, offsets = bytes_of(batch.column("text"))
        docs, lists = batch.column("id"), batch.column("wanted")
        bounds, wanted = lists.offsets.to_numpy(), lists.values
        anchor, place, hot = (wanted.field(c) for c in ("anchor", "place", "hot"))
        at = place.to_numpy()
        text = np.repeat(np.arange(len(docs)), np.diff(bounds))
        start = offsets[text] + (at[bounds[0] : bounds[-1]] >> _PLACE)
        end = start + (at[bounds[0] : bounds[-1]] & 255) + LENGTH - 1
        for i, j in spans(offsets, CHUNK):
            a, b = bounds[i], bounds[j]
            data, base = buffer[offsets[i] : offsets[j]].tobytes(), offsets[i]
            mine = slice(a - bounds[0], b - bounds[0])
            cut = [data[x:y] for x, y in zip((start[mine] - base).tolist(), (end[mine] - base).tolist())]
            columns = [anchor.slice(a, b - a), docs.take(pa.array(text[mine])), place.slice(a, b - a), hot.slice(a, b - a), pa.array(cut, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["anchor", "id", "place", "hot", "segment"])


def _stable_order(key: np.ndarray, most: int) -> np.ndarray:
    """argsort of keys below `most` that keeps the order of equal ones: faster as a sort of numbers that end in the
    place, where these fit into 63 bits."""
    n = len(key)
    if most * n < 2**63:
        return np.sort(key * n + np.arange(n)) % n
    return np.argsort(key, kind="stable")


def suffix_array(buffer: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The suffixes' order, by Larsson-Sadakane: suffixes are ranked by their first 7 bytes, then groups of equal
    rank alone are refined by the rank of the suffix as many bytes on as are sorted, which doubles. left: bytes
    up to the end of each suffix's own string, beyond which it is not compared. Equal ones keep the order of their
    places, which common_prefixes relies on."""
    n = len(buffer)
    wide = np.concatenate([buffer, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for k in range(7):
        key = key << np.uint64(8) | np.where(left > k, wide[k : n + k], 0).astype(np.uint64)
    key = key << np.uint64(8) | np.minimum(left, 7).astype(np.uint64)
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    head = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    del wide, key, sorted_key
    h = 7
    place = np.flatnonzero(~(head & np.append(head[1:], True)))  # places in the order that are not settled
    while len(place):
        active = order[place]
        beyond = left[active] <= h
        after = np.where(beyond, -1, rank[np.minimum(active + h, n - 1)])
        again = _stable_order(rank[active] * (n + 1) + after + 1, n * (n + 1))
        active, after, old = active[again], after[again], rank[active][again]
        order[place] = active
        head = np.ones(len(place), bool)
        head[1:] = (old[1:] != old[:-1]) | (after[1:] != after[:-1])
        rank[active] = place[np.maximum.accumulate(np.where(head, np.arange(len(place)), 0))]
        ended = after < 0  # equal to the end: no longer prefix tells them apart
        place = place[~(head & np.append(head[1:], True)) & ~ended]
        h *= 2
    return order


def common_prefixes(buffer: np.ndarray, left: np.ndarray, order: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """By place in the order, the common prefix with the suffix before, by Kasai's rule: that of a suffix is at
    least that of the suffix one byte earlier, less one. All strings (from starts) advance together."""
    n = len(buffer)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    found = np.zeros(n, np.int64)
    at, common = starts.copy(), np.zeros(len(starts), np.int64)
    while len(at):
        other = before[at]
        common = np.where(other < 0, 0, np.minimum(np.maximum(common - 1, 0), np.minimum(left[at], left[other])))
        going = np.flatnonzero(other >= 0)
        while len(going):
            a, b, c = at[going], other[going], common[going]
            more = (c < left[a]) & (c < left[b])
            going, a, b, c = going[more], a[more], b[more], c[more]
            same = buffer[a + c] == buffer[b + c]
            going = going[same]
            common[going] += 1
        found[at] = common
        on = left[at] > 1
        at, common = at[on] + 1, common[on]
    return found[order]


def _repeats_of(rows: pa.Table) -> tuple[np.ndarray, ...]:
    """Windows of a shard in the order of its suffix array: id, first byte, number of its class, whether it is
    the first of its class, hot, place of the window in the shard's bytes; and the bytes."""
    buffer, offsets = bytes_of(rows.column("segment"))
    size = np.diff(offsets)
    doc, place, hot, anchor = (rows.column(c).to_numpy() for c in ("id", "place", "hot", "anchor"))
    left = np.repeat(offsets[1:], size) - np.arange(len(buffer))
    order = suffix_array(buffer, left)
    common = common_prefixes(buffer, left, order, offsets[:-1][size > 0])
    window = left[order] >= LENGTH
    segment = np.repeat(np.arange(len(size)), size)[order[window]]
    # a suffix shorter than a window may stand between two windows only where their common prefix is short, too
    cls = np.cumsum(common < LENGTH)[window]
    at = order[window]
    del left, order, common, window
    owner, first_byte = doc[segment], (place[segment] >> _PLACE) + at - offsets[:-1][segment]
    rank = np.lexsort((first_byte, owner, anchor[segment], cls))
    cls, owner, first_byte, at, segment = cls[rank], owner[rank], first_byte[rank], at[rank], segment[rank]
    head = np.ones(len(cls), bool)
    head[1:] = (cls[1:] != cls[:-1]) | (anchor[segment][1:] != anchor[segment][:-1])
    return owner, first_byte, head, hot[segment], at, buffer


def _runs(owner: np.ndarray, first_byte: np.ndarray) -> list[np.ndarray]:
    """Windows that follow each other as one row: id, first window, number of windows."""
    order = np.lexsort((first_byte, owner))
    owner, first_byte = owner[order], first_byte[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (np.diff(first_byte) != 1)
    begin = np.flatnonzero(new)
    return [owner[begin], first_byte[begin], np.diff(np.append(begin, len(owner)))]


_NAMES = ["id", "start", "windows", "window", "shard"]


def _sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments sorted by anchor, split, id and place -> repeated windows (window null), and of split anchors each
    distinct window with its bytes and the number of its suffix array, for the merge."""
    held, size, arrays = [], 0, itertools.count(TaskContext.get().partitionId() << 32)

    def done(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        owner, first_byte, head, hot, at, buffer = _repeats_of(pa.concat_tables(tables).combine_chunks())
        repeats = _runs(owner[~head], first_byte[~head])
        none = pa.nulls(len(repeats[0]), pa.binary()), pa.nulls(len(repeats[0]), pa.int64())
        yield pa.RecordBatch.from_arrays([*map(pa.array, repeats), *none], _NAMES)
        number = next(arrays)
        open_ = np.flatnonzero(head & hot)
        for part in np.array_split(open_, len(open_) // 10_000 + 1):
            windows = np.ascontiguousarray(buffer[at[part][:, None] + np.arange(LENGTH)])
            bytes_ = pa.FixedSizeBinaryArray.from_buffers(pa.binary(LENGTH), len(part), [None, pa.py_buffer(windows)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(owner[part]), pa.array(first_byte[part]), pa.array(np.ones(len(part), np.int64)), bytes_, pa.array(np.full(len(part), number))], _NAMES)

    for group in _groups(batches, ("anchor", "split")):
        for rows in _parts(_without_repeated(group)):
            more = rows.column("segment").nbytes
            if held and size + more > SHARD:
                yield from done(held)
                held, size = [], 0
            held.append(rows)
            size += more
    if held:
        yield from done(held)


def _without_repeated(rows: pa.Table) -> pa.Table:
    """Sorted segments without those of repeated rows."""
    if not rows.num_rows:
        return rows
    keys = [rows.column(c).to_numpy() for c in ("anchor", "split", "id", "place")]
    return rows.filter(pa.array(np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])))


def _parts(table_: pa.Table) -> Iterator[pa.Table]:
    """A table cut between groups into parts of about SHARD bytes."""
    if not table_.num_rows:
        return
    table_ = table_.combine_chunks()
    size = bytes_of(table_.column("segment"))[1][1:]
    anchor, split = table_.column("anchor").to_numpy(), table_.column("split").to_numpy()
    begins = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (split[1:] != split[:-1])]))
    at = 0
    while at < table_.num_rows:
        stop = np.searchsorted(size, (size[at - 1] if at else 0) + SHARD, "right")
        k = np.searchsorted(begins, max(stop, at + 1), "right" if stop > at else "left")
        end = int(begins[k - 1]) if stop > at and begins[k - 1] > at else int(begins[k]) if k < len(begins) else table_.num_rows
        if stop >= table_.num_rows:
            end = table_.num_rows
        yield table_.slice(at, end - at)
        at = end


def _joined(windows: np.ndarray, a: np.ndarray, b: np.ndarray, repeat: np.ndarray) -> np.ndarray:
    """The rows of two arrays as one without equal windows. a and b: rows in order, of distinct windows each. Each
    window of a is sought among those of b by binary search; of two equal ones the later row is a repeat."""
    place = np.searchsorted(windows[b], windows[a])
    met = np.flatnonzero(windows[b[np.minimum(place, len(b) - 1)]] == windows[a])
    pair = a[met], b[place[met]]
    repeat[np.maximum(*pair)] = True
    both = np.concatenate([a, b])
    return np.sort(both[~repeat[both]])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range of the distinct windows of several suffix arrays, sorted by window, id and start: the arrays are merged
    two by two until one is left. Equal windows on both sides of a batch's border are told by the last one before it."""
    last = None
    for rows in batches:
        if not rows.num_rows:
            continue
        windows = np.frombuffer(bytes_of(rows.column("window"))[0].tobytes(), f"S{LENGTH}")
        shard = rows.column("shard").to_numpy()
        by = np.argsort(shard, kind="stable")
        arrays = np.split(by, np.flatnonzero(np.diff(shard[by])) + 1)
        repeat = np.zeros(len(windows), bool)
        while len(arrays) > 1:
            arrays = [_joined(windows, *arrays[k : k + 2], repeat) if k + 1 < len(arrays) else arrays[k] for k in range(0, len(arrays), 2)]
        if last is not None:
            repeat |= windows == last
        last = windows[-1]
        owner, first_byte, count = _runs(rows.column("id").to_numpy()[repeat], rows.column("start").to_numpy()[repeat])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (owner, first_byte, count)], _NAMES[:3])


def repeated_windows(texts: DataFrame) -> DataFrame:
    """(id, start, windows): all windows of `texts` (id, text) that also start earlier, in runs, each once or
    more."""
    rows = staged(texts.mapInArrow(_scanned, "anchor bigint, digest bigint, id bigint, place bigint, repeat boolean"))
    as_run = [F.col("id"), F.shiftright("place", _PLACE).alias("start"), F.col("place").bitwiseAND(F.lit(255)).alias("windows")]
    repeats = rows.where("repeat").select(*as_run)
    firsts = rows.where("NOT repeat").drop("repeat")
    sample = firsts.where(F.pmod(F.xxhash64("id", "place"), F.lit(SAMPLE)) == 0).groupBy("anchor").agg((F.count("*") * SAMPLE).alias("n"))
    hot = staged(sample.where(F.col("n") > HOT).select("anchor", F.expr(f"cast(n div {HOT} + 1 as int)").alias("splits")))
    dealt = firsts.join(hot, "anchor", "left")
    split = F.coalesce(F.pmod(F.xxhash64("digest"), F.col("splits")).cast("int"), F.lit(0))
    dealt = dealt.select("anchor", split.alias("split"), "digest", "id", "place", F.col("splits").isNotNull().alias("hot"))
    dealt = dealt.repartition("anchor", "split").sortWithinPartitions("anchor", "split", "digest", "id", "place")
    settled = staged(dealt.mapInArrow(_settled, "anchor bigint, id bigint, place bigint, different int, hot boolean"))
    repeats = repeats.unionByName(settled.where("different = 0").select(*as_run))
    wanted = settled.where("different = 1").groupBy("id").agg(F.collect_list(F.struct("anchor", "place", "hot")).alias("wanted"))
    cut = texts.join(wanted, "id").mapInArrow(_cut_out, "anchor bigint, id bigint, place bigint, hot boolean, segment binary")
    cut = cut.join(hot, "anchor", "left").withColumn("split", F.coalesce(F.pmod(F.xxhash64("id", "place"), F.col("splits")).cast("int"), F.lit(0))).drop("splits")
    cut = cut.repartition("anchor", "split").sortWithinPartitions("anchor", "split", "id", "place")
    shards = staged(cut.mapInArrow(_sharded, "id bigint, start bigint, windows bigint, window binary, shard bigint"))
    repeats = repeats.unionByName(shards.where("window IS NULL").select("id", "start", "windows"))
    open_ = shards.where("window IS NOT NULL").drop("windows").repartitionByRange("window").sortWithinPartitions("window", "id", "start")
    return repeats.unionByName(open_.mapInArrow(_merged, "id bigint, start bigint, windows bigint"))


def covered(start: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Ascending [start, end) of the bytes of a text that its repeated windows cover."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate((start + windows)[order] + LENGTH - 1)
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > reach[:-1]
    begin = np.flatnonzero(new)
    return np.stack([start[begin], reach[np.append(begin[1:], len(start)) - 1]], axis=1) if len(start) else np.zeros((0, 2), np.int64)


def _gone(runs: pa.ListArray) -> Iterator[np.ndarray]:
    """For each text (null: none) what its runs cover."""
    runs = runs.combine_chunks() if isinstance(runs, pa.ChunkedArray) else runs
    start, windows = (runs.values.field(c).to_numpy() for c in ("start", "windows"))
    bounds = runs.offsets.to_numpy()
    for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
        yield covered(start[a:b], windows[a:b])


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buffer, offsets = bytes_of(batch.column("text"))
        sizes, removed, spans_, digests = [], [], [], []
        for a, b, gone in zip(offsets.tolist(), offsets[1:].tolist(), _gone(batch.column("runs"))):
            data = buffer[a:b]
            edges = [0, *gone.ravel().tolist(), len(data)]
            digest, n = hashlib.sha256(), 0
            for x, y in zip(edges[::2], edges[1::2]):
                digest.update(data[x:y])
                n += y - x
            sizes.append(len(data)), removed.append(len(data) - n), spans_.append(len(gone)), digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, (sizes, removed, spans_)), pa.array(digests, pa.string())], schema=_KEPT)


def _id(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("bigint"), F.lit(-(2**63)))


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with `_id`, a number of each distinct (doc_id, text), in the order of doc_id, null first.

    It is doc_id itself where no id stands for two texts. Else the distinct pairs of id and digest are sorted and
    numbered, and texts are shuffled once more to get their numbers."""
    keys = docs.select(_id(F.col("doc_id")).alias("_id"), F.struct(F.col("doc_id").isNotNull().alias("known"), F.md5("text").alias("digest")).alias("_text"))
    shared = keys.groupBy("_id").agg(F.min("_text").alias("low"), F.max("_text").alias("high")).where("low <> high")
    if shared.isEmpty():
        return docs.withColumn("_id", _id(F.col("doc_id")))
    order = ["_id", "_text.known", "_text.digest"]
    keys = staged(keys.distinct().repartitionByRange(*order).sortWithinPartitions(*order).withColumn("number", F.monotonically_increasing_id()))
    keys = keys.select(F.col("_id").alias("_key"), F.col("_text.known").alias("_known"), F.col("_text.digest").alias("_digest"), F.col("number").alias("_id"))
    same = (_id(F.col("doc_id")) == F.col("_key")) & (F.col("doc_id").isNotNull() == F.col("_known")) & (F.md5("text") == F.col("_digest"))
    return staged(docs.join(keys, same).select(*docs.columns, "_id"))


def _with_runs(docs: DataFrame) -> DataFrame:
    """docs (text not null) with `runs`, the repeated windows of each text (null: none).

    Rows of one id and text are one document and get the same runs. Different texts of one id, or without an id, are
    different documents; null ids come before all others."""
    docs = _numbered(docs)
    runs = repeated_windows(docs.select(F.col("_id").alias("id"), "text")).groupBy("id").agg(F.collect_set(F.struct("start", "windows")).alias("runs"))
    return docs.join(runs.withColumnRenamed("id", "_id"), "_id", "left").drop("_id")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs (doc_id, text).

    Each byte that a string of LENGTH bytes covers which also starts earlier (at a smaller id, or earlier in the
    same text; texts of one id, or without an id, are ordered by digest) is removed, by the texts as they are. Null texts count as empty; texts shorter than LENGTH stay."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return _with_runs(texts).mapInArrow(_kept, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def _shortened(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, runs in columns:
        buffer, offsets = bytes_of(texts)
        for i, j in spans(offsets, CHUNK):
            out = []
            for a, b, gone in zip(offsets[i:j].tolist(), offsets[i + 1 : j + 1].tolist(), _gone(runs.slice(i, j - i))):
                data = buffer[a:b]
                if len(gone):
                    lead = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
                    # whole characters within what is covered
                    edges = np.stack([lead[np.searchsorted(lead, gone[:, 0], "left")], lead[np.searchsorted(lead, gone[:, 1], "right") - 1]], axis=1)
                    edges = [0, *edges[edges[:, 0] < edges[:, 1]].ravel().tolist(), len(data)]
                    data = np.concatenate([data[x:y] for x, y in zip(edges[::2], edges[1::2])])
                out.append(data.tobytes())
            yield pa.array(out, pa.binary()).cast(pa.string())


@F.arrow_udf(StringType())
def without(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """The texts without what their runs cover; of a character that is covered in part nothing is taken."""
    return _shortened(columns)


def shorten(docs: DataFrame) -> DataFrame:
    """docs with the repeated bytes taken out of `text` (null: ''), other columns as they are."""
    rows, back = guarded(docs.withColumn("text", F.coalesce("text", F.lit(""))), ["doc_id", "text"])
    return _with_runs(rows).withColumn("text", without("text", "runs")).select(*back)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes without those of passages that stand earlier; null texts are empty."""
    return remove_repeats(table(spark, sf_dir, "documents"))


def stage_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document stays, without the passages that stand earlier; n_chars follows the text."""
    return shorten(docs).withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])).select(*docs.columns)

"""Removal of long repeated byte strings, by suffix arrays.

Two equal strings of the minimum length have the same anchor, the least hash of the short
strings inside them, at the same place. Texts are cut into segments of neighbouring start
places with one anchor, and segments meet by anchor: what is equal meets in one task. There a
Burrows-Wheeler transform of what the segments may share tells which strings repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.batches import gram_hash, mix, prefix_hash, slices, substring_hash
from tarn.llm.passages import covered, shared_segments, shared_windows, wanted_segments, window_hashes
from tarn.session import durable

LENGTH = 400
#: Bytes of the strings whose hashes are anchors.
GRAM = 32
#: Distinct segments of an anchor that meet as they are; above it they are cut finer.
CROWD = 64
#: Start places in the pieces of crowded anchors, level by level; the last meets by the whole string.
FINER = (16, 1)
#: Bytes of pieces that a task takes into one transform.
TRANSFORM_BYTES = 1 << 19
#: Neighbouring start places that are left out of a transform together.
GRID = 16
#: Bytes of text that a task cuts at once.
FETCH_BYTES = 1 << 19
END = 0xFF  # no byte of UTF-8

#: Bytes of text whose anchors are found at once, at least; places in it take so many low bits.
CHUNK_BITS = 16

SEGMENTS = "meet long, piece long, at int, size int, doc_id long, doc_name long, start long"
#: Pieces with their bytes; or the windows of a piece, without bytes.
FETCHED = "meet long, piece long, at int, bytes binary, copies int, crowd long, low long, high long, window long"
CHILDREN = "meet long, piece long, at int, size int, up_meet long, up_piece long, start long, copies int"
RUNS = "meet long, piece long, runs array<struct<first:int,last:int>>"


def anchors(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """For each string of ``length`` bytes: its anchor's hash and place, the leftmost of the
    least hashes of the short strings inside it."""
    n = len(data) - length + 1
    out_hash, out_place = np.empty(n, np.uint64), np.empty(n, np.int64)
    bits = max(CHUNK_BITS, (2 * length).bit_length())
    step = (1 << bits) - length
    low = np.uint64((1 << bits) - 1)
    for start in range(0, n, step):
        part = data[start : start + step + length - 1]
        hashes = gram_hash(prefix_hash(part), GRAM)
        best = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
        span, width = 1, length - GRAM + 1
        while span * 2 <= width:
            best = np.minimum(best[:-span], best[span:])
            span *= 2
        count = len(part) - length + 1
        best = np.minimum(best[:count], best[width - span : width - span + count])
        place = (best & low).astype(np.int64)
        out_hash[start : start + count] = hashes[place]
        out_place[start : start + count] = place + start
    return out_hash, out_place


def _segments(length: int):
    """Runs of neighbouring start places with one anchor, in every text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches):
            if len(data) < length:
                continue
            anchor, place = anchors(data, length)
            ends = np.repeat(offsets[1:], np.diff(offsets))[: len(place)]
            start = np.flatnonzero(np.arange(len(place)) + length <= ends)
            if not len(start):
                continue
            # The strings of two texts have another anchor place or are not neighbours.
            opens = np.append(True, (np.diff(start) != 1) | (np.diff(place[start]) != 0))
            first = start[opens]
            size = np.diff(np.append(np.flatnonzero(opens), len(start))) + length - 1
            name = substring_hash(prefix_hash(data), first, first + size)
            row = np.searchsorted(offsets, first, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(anchor[first].view(np.int64)),
                    pa.array(name.view(np.int64)),
                    pa.array(place[first] - first, pa.int32()),
                    pa.array(size, pa.int32()),
                    rows.column("doc_id").cast(pa.int64()).take(pa.array(row)),
                    rows.column("doc_name").take(pa.array(row)),
                    pa.array(first - offsets[row], pa.int64()),
                ],
                names=["meet", "piece", "at", "size", "doc_id", "doc_name", "start"],
            )

    return cut


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted pieces of each parent, and the window hashes of its wanted segments."""
    names = [x.split()[0] for x in FETCHED.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), *[pa.int64()] * 4]

    def table(n: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
        full = [columns.get(c, pa.nulls(n, kind)) for c, kind in zip(names, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(full, names=names)

    for rows, data, offsets in slices(batches, "bytes", FETCH_BYTES):
        wanted = rows.column("wanted")
        flat = wanted.flatten()
        if len(flat):
            home = np.repeat(np.arange(len(wanted)), wanted.value_lengths().to_numpy(zero_copy_only=False))
            first = offsets[home] + flat.field("start").to_numpy()
            size = flat.field("size").to_numpy().astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(size)])
            raw = data[np.arange(ends[-1]) + np.repeat(first - ends[:-1], size)]
            cut = pa.Array.from_buffers(
                pa.binary(), len(size), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw)]
            )
            same = {c: flat.field(c) for c in ("meet", "piece", "at", "copies", "crowd")}
            yield table(len(size), same | {"bytes": cut})
        if "windows" in rows.schema.names and len(rows.column("windows").flatten()):
            windows = window_hashes(rows.column("windows"), data, offsets)
            yield table(len(windows["at"]), windows)


def _finer(block: int, length: int):
    """Blocks of start places, counted from the anchor. Equal strings meet by what all
    strings of their block have in common."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 512) for b in batches for k in range(0, b.num_rows, 512)):
            out: list[list[np.ndarray]] = []
            for r in batch.to_pylist():
                text = np.frombuffer(r["bytes"], np.uint8)
                prefix = prefix_hash(text)
                starts = np.arange(len(text) - length + 1)
                number = (r["at"] - starts) // block
                first = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
                size = np.diff(np.append(first, len(starts))) + length - 1
                nearest = r["at"] - number[first] * block
                core = substring_hash(prefix, nearest, nearest - (block - 1) + length)
                seed = np.uint64(r["meet"] & (2**64 - 1))
                meet = mix(core ^ mix(number[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + seed))
                name = substring_hash(prefix, first, first + size)
                same = np.ones(len(first), np.int64)
                out.append(
                    [meet.view(np.int64), name.view(np.int64), r["at"] - first, size, same * r["meet"],
                     same * r["piece"], first, same * r["copies"]]
                )
            if out:
                i64, i32 = pa.int64(), pa.int32()
                kinds = [i64, i64, i32, i32, i64, i64, i64, i32]
                names = ["meet", "piece", "at", "size", "up_meet", "up_piece", "start", "copies"]
                columns = [np.concatenate(c) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=names
                )

    return cut


def burrows_wheeler(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix array, transform, common prefixes) of ``data``, suffixes sorted by their first
    ``depth`` bytes; common prefixes of neighbours as far as eight bytes.

    Prefix doubling from eight bytes on; only suffixes that are still tied are sorted again.
    Equal strings up to ``depth`` are neighbours, which is all that intervals of strings up
    to that length need.
    """
    n = len(data)
    padded = np.append(data, np.zeros(8, np.uint8))
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k : k + n]
    order = np.argsort(key)
    differ = key[order][1:] ^ key[order][:-1]
    common = np.zeros(n - 1, np.int8)
    for k in range(8):
        common += differ < np.uint64(1 << (56 - 8 * k))
    new = np.append(True, differ != 0)
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    active = order[~(new & np.append(new[1:], True))]
    width = 8
    while width < depth and len(active):
        follow = np.where(active + width < n, rank[np.minimum(active + width, n - 1)] + 1, 0)
        both = rank[active] * (n + 1) + follow
        turn = np.argsort(both)
        active, both = active[turn], both[turn]
        group = both // (n + 1)
        at = np.arange(len(active))
        # A group's suffixes keep its places in the array.
        opens = np.append(True, group[1:] != group[:-1])
        slot = group + at - at[opens][np.cumsum(opens) - 1]
        order[slot] = active
        new = np.append(True, both[1:] != both[:-1])
        rank[active] = slot[new][np.cumsum(new) - 1]
        active = active[~(new & np.append(new[1:], True))]
        width *= 2
    return order, data[order - 1], common


def repeated_starts(data: np.ndarray, length: int) -> np.ndarray:
    """Which places of ``data`` start a string of ``length`` bytes that starts elsewhere too.

    Common prefixes of neighbours in the suffix array are found by increasing value. An
    interval of suffixes with a common string is extended backwards by each byte that
    precedes it; the interval so found ends where the next common prefix is settled. At
    ``length`` the expansion stops: what is not settled by then is at least as long. Common
    prefixes under eight bytes, those of almost all neighbours, come with the sorting, and
    the expansion starts from the intervals of eight bytes.
    """
    n = len(data)
    order, bwt, common = burrows_wheeler(data, length)
    by_byte = np.argsort(bwt, kind="stable")
    back = np.empty(n, np.int64)  # where the suffix one byte longer lies
    back[by_byte] = np.arange(n)
    same = bwt[by_byte][1:] == bwt[by_byte][:-1]
    later = np.full(n, n)  # the next place with the same preceding byte, and the last one
    later[by_byte[:-1][same]] = by_byte[1:][same]
    earlier = np.full(n, -1)
    earlier[by_byte[1:][same]] = by_byte[:-1][same]
    settled = np.concatenate([[True], common < 8, [True]])
    edges = np.flatnonzero(settled)
    at_eight = np.append(common, np.int8(0))[edges[1:] - 1] == 7  # the ends found last
    low, high = edges[:-1][at_eight], edges[1:][at_eight]
    for _ in range(8, length):
        if not len(low):
            break
        sizes = high - low
        owner = np.repeat(np.arange(len(low)), sizes)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[owner]
        # Intervals of different strings do not overlap, so sorting pairs first with last.
        begin = np.sort(back[inside[earlier[inside] < low[owner]]])
        end = np.sort(back[inside[later[inside] >= high[owner]]]) + 1
        fresh = ~settled[end]
        low, high = begin[fresh], end[fresh]
        settled[high] = True
    joined = ~settled[1:n]  # with the neighbour before
    repeated = np.zeros(n, bool)
    repeated[order[1:][joined]] = True
    repeated[order[:-1][joined]] = True
    return repeated


def _spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def may_repeat(
    data: np.ndarray, begin: np.ndarray, size: np.ndarray, at: np.ndarray, group: np.ndarray, length: int
) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) start places in ``data`` whose strings of ``length`` bytes may be in another
    piece of the group too, as runs.

    Pieces have their anchor ``at`` bytes from their ``begin``, and equal strings have it at the
    same place. Start places are taken in blocks counted from the anchor; where no other piece
    has what all strings of a block have in common, none of them repeats.
    """
    block = min(GRID, length)
    high, low = at // block, (at - (size - length)) // block
    count = high - low + 1
    owner = np.repeat(np.arange(len(begin)), count)
    number = high[owner] - (np.arange(len(owner)) - (np.cumsum(count) - count)[owner])
    nearest = (begin + at)[owner] - number * block
    core = substring_hash(prefix_hash(data), nearest, nearest - (block - 1) + length)
    place = number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix(group[owner].astype(np.uint64))
    _, which, counts = np.unique(core ^ mix(place), return_inverse=True, return_counts=True)
    wanted = np.flatnonzero(counts[which] > 1)
    owner = owner[wanted]
    first = np.maximum(nearest[wanted] - (block - 1), begin[owner])
    last = np.minimum(nearest[wanted], (begin + size - length)[owner])
    opens = np.append(True, (np.diff(wanted) != 1) | (np.diff(owner) != 0))[: len(wanted)]
    return first[opens], last[np.append(opens[1:], True)[: len(wanted)]]


def repeated_among(pieces: list[bytes], at: list[int], group: list[int], length: int) -> np.ndarray:
    """``repeated_starts`` of the pieces, each followed by an end, without what cannot repeat."""
    end = bytes([END])
    data = np.frombuffer(end.join(pieces) + end, np.uint8)
    repeated = np.zeros(len(data), bool)
    if not pieces:
        return repeated
    size = np.array([len(p) for p in pieces])
    begin = np.cumsum(size + 1) - size - 1
    first, last = may_repeat(data, begin, size, np.array(at), np.array(group), length)
    if len(first):
        starts = last - first + 1
        full = starts + length  # with the end
        ends = np.cumsum(full)
        inside = np.arange(ends[-1]) - np.repeat(ends - full, full)
        source = inside + np.repeat(first, full)
        part = data[source]
        part[ends - 1] = END
        found = repeated_starts(part, length) & (inside < np.repeat(starts, full))
        repeated[source[found]] = True
    return repeated


def _repeats(length: int):
    """For distinct pieces sorted by ``meet``: the repeated starts of each, as runs."""

    def solve(rows: list[dict]) -> pa.RecordBatch | None:
        # Pieces that meet no other need no transform: they are here for their copies.
        met = [a["meet"] == b["meet"] for a, b in zip(rows[:-1], rows[1:], strict=True)]
        alone = [not (a or b) for a, b in zip([False, *met], [*met, False], strict=True)]
        several = [r for r, one in zip(rows, alone, strict=True) if not one]
        number = np.cumsum([False, *(a["meet"] != b["meet"] for a, b in zip(several[:-1], several[1:], strict=True))])
        repeated = repeated_among([r["bytes"] for r in several], [r["at"] for r in several], number, length)
        out, at = [], 0
        for r, one in zip(rows, alone, strict=True):
            n = len(r["bytes"])
            # A piece that stands for copies counts twice: all its strings start elsewhere too.
            a, b = _spans(repeated[at : at + n - length + 1] if r["copies"] < 2 else np.ones(n - length + 1, bool))
            if len(a):
                runs = [{"first": x, "last": y - 1} for x, y in zip(a.tolist(), b.tolist(), strict=True)]
                out.append((r["meet"], r["piece"], runs))
            at += 0 if one else n + 1
        if not out:
            return None
        meet, piece, runs = zip(*out, strict=True)
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        return pa.RecordBatch.from_arrays(
            [pa.array(meet, pa.int64()), pa.array(piece, pa.int64()), pa.array(runs, kind)],
            names=["meet", "piece", "runs"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        group: list[dict] = []
        size = 0
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                for r in batch.slice(k, 256).to_pylist():
                    if group and r["meet"] != group[0]["meet"]:
                        held += group
                        group = []
                        if size >= TRANSFORM_BYTES:
                            if (out := solve(held)) is not None:
                                yield out
                            held, size = [], 0
                    group.append(r)
                    size += len(r["bytes"])
        if (held or group) and (out := solve(held + group)) is not None:
            yield out

    return run


def _finish(length: int):
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches):
            spans_out, removed, digest, left, shared = [], [], [], [], []
            for starts in rows.column("starts"):
                shared.append(covered(starts.values.to_numpy()) if starts.is_valid else 0)
            for i, runs in enumerate(rows.column("runs").to_pylist()):
                text = data[offsets[i] : offsets[i + 1]]
                edge = np.zeros(len(text) + 1, np.int64)
                if runs:
                    np.add.at(edge, [r["first"] for r in runs], 1)
                    np.add.at(edge, [r["last"] + length for r in runs], -1)
                gone = np.cumsum(edge[:-1]) > 0
                a, b = _spans(gone)
                kept = text[~gone].tobytes()
                spans_out.append([{"start": int(x), "stop": int(y)} for x, y in zip(a, b, strict=True)])
                removed.append(int(gone.sum()))
                digest.append(hashlib.sha256(kept).hexdigest())
                left.append(kept.decode("utf-8", "ignore"))
            span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"),
                    pa.array(np.diff(offsets), pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(spans_out, span),
                    pa.array(digest, pa.string()),
                    pa.array(left, pa.string()),
                    pa.array(shared, pa.int64()),
                ],
                names=["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256", "kept_text", "n_shared_words"],
            )

    return finish


def _meeting(rows: DataFrame, parent: list[str]) -> DataFrame:
    """One row for each distinct piece that is not alone at its meeting place, with one of its
    parents, its copies (2 stands for more), and the crowd: how many distinct ones meet.

    Copies are summed before the shuffle, so a passage in a third of all rows is one row
    for each task.
    """
    place = F.xxhash64(*parent, "start")
    one = [F.min_by(c, place).alias(c) for c in (*parent, "start", "size", "at")]
    distinct = rows.groupBy("meet", "piece").agg(F.sum("copies").alias("copies"), *one)
    distinct = durable(distinct)
    places = distinct.groupBy("meet").agg(F.count(F.lit(1)).alias("crowd"), F.sum("copies").alias("all"))
    found = distinct.join(places.where("all > 1").select("meet", "crowd"), "meet")
    w = F.struct(
        "meet", "piece", "at", "start", "size",
        F.least("copies", F.lit(2)).cast("int").alias("copies"), "crowd",
    )
    return found.select(*parent, w.alias("w"))


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept_sha256, kept_text, n_shared_words) of each of ``docs``.

    Every byte of the UTF-8 text that is covered by a string of ``length`` bytes which starts
    anywhere else in ``docs``, the same text included, is removed. Spans are the maximal
    removed runs; ``kept_text`` leaves out characters cut in two, ``kept_sha256`` is of all
    remaining bytes. ``n_shared_words`` counts the words in passages of 50 words and more
    that another row holds too, also where these are shorter than ``length`` bytes; they are
    told by ``passages.shared_windows`` and not removed.

    Segments are exchanged as hashes; bytes are fetched for one of each distinct segment
    whose anchor occurs twice. Anchors with more than ``CROWD`` distinct segments, such as
    the edges of a passage found everywhere, are cut into finer pieces that meet by more of
    their content, down to single strings, so no task gets a hot anchor whole.

    Null texts are empty; texts under ``length`` bytes keep everything. Repeated rows are
    copies of each other and are removed like others. Null ids are answered. Columns of
    ``docs`` other than doc_id and text play no part.
    """
    if length <= GRAM:  # also keeps the expansion above the eight bytes it starts from
        raise ValueError(f"strings must be longer than {GRAM} bytes")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs = docs.withColumn("doc_name", F.xxhash64(F.col("doc_id").isNull(), "text"))
    docs = docs.withColumn("key", F.coalesce("doc_id", F.lit(-1)))
    segments = durable(docs.select("doc_id", "doc_name", "text").mapInArrow(_segments(length), SEGMENTS))
    segments = segments.withColumn("key", F.coalesce("doc_id", F.lit(-1)))
    rows, parent = segments.withColumn("copies", F.lit(1)), ["key", "doc_name"]
    parents = docs.select(*parent, F.coalesce("text", F.lit("")).cast("binary").alias("bytes"))
    met_words, word_pieces = shared_segments(docs)
    levels: list[tuple[DataFrame, DataFrame]] = []
    windows = None
    for block in (*FINER, 0):
        wanted, lists = _meeting(rows, parent), [F.collect_list("w").alias("wanted")]
        if windows is None:  # texts are fetched once for both
            wanted = wanted.unionByName(wanted_segments(word_pieces), allowMissingColumns=True)
            lists.append(F.collect_list("v").alias("windows"))
        wanted = wanted.groupBy(*parent).agg(*lists)
        fetched = parents.join(wanted, parent).drop(*parent)
        fetched = durable(fetched.mapInArrow(_fetch, FETCHED))
        if windows is None:
            windows = fetched.where("window is not null").select("meet", "piece", "low", "high", "at", "window")
        fetched = fetched.where("bytes is not null").drop("low", "high", "window")
        calm = fetched.where(F.col("crowd") <= CROWD) if block else fetched
        met = calm.repartition("meet").sortWithinPartitions("meet", "piece")
        levels.append((rows, durable(met.drop("crowd").mapInArrow(_repeats(length), RUNS))))
        crowded = fetched.where(F.col("crowd") > CROWD).select("meet", "piece", "at", "bytes", "copies")
        if not block or crowded.isEmpty():
            break
        rows, parent = durable(crowded.mapInArrow(_finer(block, length), CHILDREN)), ["up_meet", "up_piece"]
        parents = crowded.select(F.col("meet").alias("up_meet"), F.col("piece").alias("up_piece"), "bytes")

    runs = None  # from the finest level up, in places of the parent
    for rows, solved in reversed(levels):
        runs = solved if runs is None else solved.union(runs)
        if rows is levels[0][0]:
            break
        lifted = rows.select("meet", "piece", "up_meet", "up_piece", "start").join(runs, ["meet", "piece"])
        lifted = lifted.groupBy(F.col("up_meet").alias("meet"), F.col("up_piece").alias("piece"))
        runs = durable(lifted.agg(F.flatten(F.collect_list(_moved())).alias("runs")))
    hits = segments.select("meet", "piece", "key", "doc_name", "start").join(runs, ["meet", "piece"])
    hits = hits.groupBy("key", "doc_name").agg(F.flatten(F.collect_list(_moved())).alias("runs"))
    shared = shared_windows(met_words, word_pieces, windows)
    out = docs.join(hits, ["key", "doc_name"], "left").join(shared, ["key", "doc_name"], "left")
    schema = (
        "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,stop:long>>, "
        "kept_sha256 string, kept_text string, n_shared_words long"
    )
    return out.select("doc_id", "text", "runs", "starts").mapInArrow(_finish(length), schema)


def _moved():
    """Runs in the places of what the piece was cut from."""
    start = F.col("start").cast("int")
    return F.transform(
        "runs", lambda r: F.struct((r["first"] + start).alias("first"), (r["last"] + start).alias("last"))
    )

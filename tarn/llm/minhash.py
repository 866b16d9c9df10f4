"""Near-duplicate documents by circulant MinHash."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.functions.sizes import broadcast_if_small
from tarn.llm.batches import lists, lower_ascii, mix, row_starts, shingles, slices, word_hashes
from tarn.llm.components import components
from tarn.session import durable

WORDS = 5
BANDS, ROWS = 40, 4
SIGNATURE = BANDS * ROWS
#: A pair linked at 0.75 agrees in fewer than 88 of 160 coordinates once in ten million.
SCREEN = 88
#: Members of a bucket that meet in one task, in the second pass.
BLOCK = 512
#: Ids that are sent to every task; above it the texts are joined by a shuffle.
BROADCAST_ROWS = 500_000

SIGNED = "doc_id long, n_shingles long, set_hash binary, signature binary, bands array<long>"


def _permute(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A permutation of the 32-bit numbers."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(a)
    x ^= x >> np.uint32(13)
    x *= np.uint32(b)
    x ^= x >> np.uint32(16)
    return x


def circulant_signatures(sets: list[np.ndarray], size: int = SIGNATURE) -> np.ndarray:
    """(size, len(sets)) coordinates of non-empty shingle sets.

    The first permutation scatters the shingle ids over the ring of 32-bit numbers; the
    second one, shifted around the ring by k, gives coordinate k.
    """
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    ring = _permute(flat, 0x85EBCA6B, 0xC2B2AE35)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((size, len(sets)), np.uint32)
    for k in range(size):
        out[k] = np.minimum.reduceat(_permute(ring - np.uint32(k), 0x7FEB352D, 0x846CA68B), starts)
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """(documents, BANDS) keys; equal where all rows of the band are equal."""
    rows = signatures.reshape(BANDS, ROWS, -1).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64)[:, None], rows[:, 0].shape)
    for r in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + rows[:, r])
    return np.ascontiguousarray(keys.T).view(np.int64)


def _sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    words, row = word_hashes(lower_ascii(data), offsets)
    return shingles(words, row_starts(row, len(offsets) - 1), WORDS)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in slices(batches):
        sets = _sets(data, offsets)
        sizes = np.array([len(s) for s in sets])
        some = np.flatnonzero(sizes)
        signature: list[bytes | None] = [None] * len(sets)
        digest: list[bytes | None] = [None] * len(sets)
        keys = np.empty((0, BANDS), np.int64)
        if len(some):
            signed = circulant_signatures([sets[i] for i in some])
            keys = band_keys(signed)
            low = np.ascontiguousarray(signed.astype(np.uint8).T)
            for j, i in enumerate(some.tolist()):
                signature[i] = low[j].tobytes()
                digest[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
        yield pa.RecordBatch.from_arrays(
            [
                rows.column("doc_id").cast(pa.int64()),
                pa.array(sizes, pa.int64()),
                pa.array(digest, pa.binary()),
                pa.array(signature, pa.binary()),
                lists(keys.ravel(), np.where(sizes > 0, BANDS, 0), pa.int64()),
            ],
            names=["doc_id", "n_shingles", "set_hash", "signature", "bands"],
        )


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in slices(batches):
        sets = _sets(data, offsets)
        yield pa.RecordBatch.from_arrays(
            [
                rows.column("doc_id").cast(pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                lists(np.concatenate(sets).view(np.int64), np.array([len(s) for s in sets]), pa.int64()),
            ],
            names=["doc_id", "set_hash", "shingles"],
        )


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures agree often enough to be worth an exact look."""
    for batch in batches:
        if batch.num_rows:
            a, b = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SIGNATURE)
                for c in ("sig_a", "sig_b")
            )
            yield batch.select(["a", "b"]).filter(pa.array((a == b).sum(axis=1) >= SCREEN))


def _links_across(group: pa.Table, similarity: int) -> list[tuple[int, int]]:
    """Links between different components of a block, one for each two components at most.

    Signatures choose whom to compare, full shingle sets decide.
    """
    doc, part, side = (group.column(c).to_numpy() for c in ("rep", "component", "side"))
    sig = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint8).reshape(-1, SIGNATURE)
    flat = group.column("shingles").combine_chunks()
    values = flat.flatten().to_numpy().view(np.uint64)
    ends = np.cumsum(flat.value_lengths().to_numpy())
    sizes = np.diff(np.append(0, ends))
    up: dict[int, int] = {}

    def top(c: int) -> int:
        while c in up:
            c = up[c]
        return c

    right = np.flatnonzero(side >= 1)
    found = []
    for x in np.flatnonzero(side <= 1).tolist():
        others = right[right > x] if side[x] == 1 else right
        near = others[(part[others] != part[x]) & ((sig[others] == sig[x]).sum(axis=1) >= SCREEN)]
        near = near[[top(c) != top(int(part[x])) for c in part[near].tolist()]] if len(near) else near
        if not len(near):
            continue
        own = values[ends[x] - sizes[x] : ends[x]]
        theirs = np.concatenate([values[ends[y] - sizes[y] : ends[y]] for y in near.tolist()])
        hit = own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs
        common = np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes[near]) - sizes[near])
        for y in near[100 * common >= similarity * (sizes[x] + sizes[near] - common)].tolist():
            a, b = top(int(part[x])), top(int(part[y]))
            if a != b:
                up[max(a, b)] = min(a, b)
                found.append((int(doc[x]), int(doc[y])))
    return found


def _block_links(similarity: int):
    """The links found in each of the sorted (bucket, i, j) groups."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        parts: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("bucket", "i", "j")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                now = tuple(keys[:, start])
                if key is not None and now != key:
                    yield pa.Table.from_batches(parts)
                    parts = []
                key = now
                parts.append(batch.slice(start, end - start))
        if parts:
            yield pa.Table.from_batches(parts)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches):
            if found := _links_across(group, similarity):
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return link


def _shingle_sets(wanted: DataFrame, docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(doc_id, shingles) of the representatives in ``wanted`` (doc_id)."""
    texts = docs.select("doc_id", "text").join(broadcast_if_small(wanted, BROADCAST_ROWS), "doc_id")
    # The set hash keeps rows apart that share an id.
    sets = texts.mapInArrow(_full_sets, "doc_id long, set_hash binary, shingles array<long>")
    sets = sets.join(reps.select(F.col("rep").alias("doc_id"), "set_hash"), ["doc_id", "set_hash"], "left_semi")
    return durable(sets.dropDuplicates(["doc_id", "set_hash"]).select("doc_id", "shingles"))


def _verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets meet the similarity in percent."""
    pairs = durable(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    sets = _shingle_sets(wanted, docs, reps)
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a").join(
        sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b"
    )
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    sizes = F.size("sa").cast("long") + F.size("sb")
    return durable(
        both.select("a", "b", common.alias("common"), sizes.alias("sizes"))
        .where(F.col("common") * 100 >= similarity * (F.col("sizes") - F.col("common")))
        .select("a", "b")
    )


def near_duplicates(docs: DataFrame, similarity: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text).

    Texts with equal shingle sets are one class; classes that share a band key are
    candidates. In each bucket every class is compared with the smallest one first. Then
    only buckets that still hold two components are opened: their members meet in blocks
    inside tasks, which compare all members of different components and emit one link for
    two of them at most. Every link is confirmed on the full sets, so components are right up to the chance
    that no band matches: (1 - 0.75**4)**40, three in ten million at 0.75 exactly.

    Null or blank texts have no shingles and are linked with nothing: component_id is
    their own id. A null id stays null. Repeated rows each give a row. Other columns of
    ``docs`` play no part. Bands are tuned for similarities of 70 and more.
    """
    if similarity < 70:
        raise ValueError("bands and screen are tuned for a similarity of 70 % and more")
    docs = docs.select("doc_id", "text")
    signed = durable(docs.mapInArrow(_sign, SIGNED))
    classes = signed.where("n_shingles > 0").groupBy("set_hash").agg(F.min("doc_id").alias("rep"))
    classes = durable(classes.where("rep is not null"))
    reps = durable(
        signed.join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", "set_hash"])
        .select(F.col("doc_id").alias("rep"), "set_hash", "signature", "bands")
    )
    members = reps.select("rep", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z")
    # Only shared buckets are kept: most texts have no relative.
    members = durable(members.join(shared.select("bucket", "a"), "bucket"))
    star = members.where("rep <> a").select("a", F.col("rep").alias("b")).distinct()
    signature = reps.select("rep", "signature")
    star = star.join(signature.toDF("a", "sig_a"), "a").join(signature.toDF("b", "sig_b"), "b")
    links = _verified(star.mapInArrow(_agree, "a long, b long"), docs, reps, similarity)

    first = components(links)
    placed = members.join(first.withColumnRenamed("node", "rep"), "rep", "left").select(
        "bucket", "rep", F.coalesce("component", "rep").alias("component")
    )
    placed = durable(placed)
    open_buckets = placed.groupBy("bucket").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n")
    )
    open_buckets = open_buckets.where("lo < hi").select(
        "bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")
    )
    rows = durable(placed.join(open_buckets, "bucket"))
    sets = _shingle_sets(rows.select(F.col("rep").alias("doc_id")).distinct(), docs, reps)
    held = signature.join(sets.withColumnRenamed("doc_id", "rep"), "rep")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = rows.select("bucket", "rep", "component", "block", other).select(
        "bucket",
        F.least("block", "other").alias("i"),
        F.greatest("block", "other").alias("j"),
        F.when(F.col("block") == F.col("other"), 1).when(F.col("block") < F.col("other"), 0).otherwise(2).alias("side"),
        "rep",
        "component",
    )
    met = rows.join(held, "rep").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    more = durable(met.mapInArrow(_block_links(similarity), "a long, b long"))
    whole = components(links.union(more))
    named = classes.join(whole.withColumnRenamed("node", "rep"), "rep", "left").select(
        "set_hash", F.coalesce("component", "rep").alias("component_id")
    )
    result = signed.select("doc_id", "n_shingles", "set_hash").join(named, "set_hash", "left")
    component = F.coalesce("component_id", "doc_id")
    return result.select(
        "doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept")
    )

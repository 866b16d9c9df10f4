"""Prefix trie of conversations, from padded matrices of turn ids."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions.rowid import with_row_id
from tarn.functions.sizes import broadcast_if_small
from tarn.llm.repair import CRC32, crc32_sql
from tarn.session import durable

#: A conversation takes up to HEAD - 1 turns from the one at the start of its FAMILY of ids.
FAMILY, HEAD = 5, 9
#: Turns of a matrix; longer conversations go on in another one.
WIDTH = 64
#: Rows of a range shard.
SHARD = 32_768
#: Turns up to which a conversation is put together in one row before it is cut.
LONG = 4096
BROADCAST_ROWS = 100_000

NODE, BORDER, ENDS = range(3)
OUT = (
    "kind int, depth long, kh long, kl long, ph long, pl long, conv_id long, parent_conv_id long, size long,"
    "n_convs long, n_on long, n_children long, n_leaves long, saved long, base long, path array<long>, ends string"
)
KEY = ["depth", "kh", "kl"]
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
NOTHING = hashlib.sha256(b"").hexdigest()


def _rank(*columns: np.ndarray) -> np.ndarray:
    """Dense ranks of rows by their columns."""
    out = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        out = (out << 32) | np.unique(c, return_inverse=True)[1]
        out = np.unique(out, return_inverse=True)[1]
    return out


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return values, column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


class Matrix:
    """The rows of a shard in lexicographic order of their turns, and where nodes begin."""

    def __init__(self, rows: pa.RecordBatch):
        base, ph, pl, conv, more = (
            rows.column(c).to_numpy(zero_copy_only=False) for c in ("base", "ph", "pl", "conv_id", "more")
        )
        z, cells = _flat(rows.column("z"))
        sizes, lens = _flat(rows.column("sizes"))
        n, width = len(lens), int(lens.max(initial=0))
        row = np.repeat(np.arange(n), lens)
        col = np.arange(len(row)) - np.repeat(np.cumsum(lens) - lens, lens)
        ids = np.full((n, width), -1, np.int64)
        ids[row, col] = _rank(z[::2], z[1::2])
        group = _rank(base, ph, pl)
        # The order of the ranges the rows were dealt by: ids by rank, shorter rows first.
        order = np.lexsort((conv, *ids.T[::-1], group))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        row = place[row]
        self.conv, self.base, self.more, self.lens = conv[order], base[order], more[order].astype(bool), lens[order]
        ids, group = ids[order], group[order]
        self.n, self.width = n, width
        self.sizes = np.zeros((n, width), np.int64)
        self.sizes[row, col] = sizes
        # Keys of all prefixes: running exclusive-or of position-dependent turn hashes.
        self.kh, self.kl = np.zeros((n, width + 1), np.int64), np.zeros((n, width + 1), np.int64)
        for keys, first, half in ((self.kh, ph, 0), (self.kl, pl, 1)):
            keys[:, 0] = first[order]
            keys[row, col + 1] = z[half::2]
            np.bitwise_xor.accumulate(keys, axis=1, out=keys)
        # A node begins where a row differs from the one before in any column up to its own.
        changed = np.ones((n, width + 1), bool)
        changed[1:, 0] = group[1:] != group[:-1]
        changed[1:, 1:] = ids[1:] != ids[:-1]
        self.opens = np.logical_or.accumulate(changed, axis=1)


class Level:
    """All nodes of one depth of a shard; level 0 holds the tops of its groups."""

    def __init__(self, m: Matrix, j: int, above: Level | None):
        start = np.flatnonzero(m.opens[:, j])
        end = np.append(start[1:], m.n)
        real = m.lens[start] >= j
        low = np.minimum.reduceat(m.conv, start)
        stops = (m.lens == j) & ~m.more
        ends = np.add.reduceat(stops.astype(np.int64), start)
        self.of_row = np.where(real, np.cumsum(real) - 1, -1)[np.cumsum(m.opens[:, j]) - 1]
        self.start, self.end, self.low, self.ends = start[real], end[real], low[real], ends[real]
        self.size = m.sizes[self.start, j - 1] if j else np.zeros(len(self.start), np.int64)
        self.n = self.end - self.start
        self.parent = above.of_row[self.start] if above else None
        # Only nodes of the first and the last row can go on in another shard.
        self.border = (self.start == 0) | (self.end == m.n) if j else np.ones(len(self.start), bool)
        self.children = np.zeros(len(self.start), np.int64)
        self.leaves, self.saved = self.children.copy(), self.children.copy()
        self.stops = np.flatnonzero(stops)

    def members_ending(self, m: Matrix, k: int) -> list[int]:
        a, b = np.searchsorted(self.stops, (self.start[k], self.end[k]))
        return m.conv[self.stops[a:b]].tolist()


def _levels(m: Matrix) -> list[Level]:
    """Nodes of every depth, with the sums over their subtrees. What lies below a border node
    is added to it, but no border node is added to its parent: that is done when all shards
    are known."""
    levels: list[Level] = []
    for j in range(m.width + 1):
        levels.append(Level(m, j, levels[-1] if levels else None))
    for j in range(m.width, 0, -1):
        here, above = levels[j], levels[j - 1]
        whole = ~here.border
        here.leaves[whole] += (here.ends == here.n)[whole]
        here.saved[whole] += ((here.n - 1) * here.size)[whole]
        np.add.at(above.children, here.parent[whole], 1)
        np.add.at(above.leaves, here.parent[whole], here.leaves[whole])
        np.add.at(above.saved, here.parent[whole], here.saved[whole])
    return levels


def _joined(ids: list[int]) -> str:
    return ",".join(map(str, ids))


def _shard_rows(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    m = Matrix(rows)
    names = [c.split()[0] for c in OUT.split(",")]
    above = None
    for j, here in enumerate(_levels(m)):
        n = len(here.start)
        parent = np.zeros(n, np.int64) if above is None else above.low[here.parent]
        unknown = np.ones(n, bool) if above is None else above.border[here.parent]
        # Each top of a group that goes on from a narrower matrix is no node by itself.
        top = (m.base[here.start] > 0) if j == 0 else np.zeros(n, bool)
        ends = np.full(n, NOTHING, object)
        lists_ = []
        for k in np.flatnonzero(here.ends > 0).tolist():
            members = here.members_ending(m, k)
            if here.border[k]:
                lists_.append((k, members[0], _joined(members)))
            else:
                ends[k] = hashlib.sha256(_joined(members).encode()).hexdigest()
        kinds = np.where(here.border, BORDER, NODE)
        path = [
            np.stack([m.kh[s, :j], m.kl[s, :j]], 1).reshape(-1) if b else None
            for s, b in zip(here.start.tolist(), here.border.tolist(), strict=True)
        ]
        before = max(j - 1, 0)
        columns = [
            pa.array(kinds, pa.int32()),
            pa.array(m.base[here.start] + j),
            pa.array(m.kh[here.start, j]),
            pa.array(m.kl[here.start, j]),
            pa.array(m.kh[here.start, before]),
            pa.array(m.kl[here.start, before]),
            pa.array(here.low),
            pa.array(parent, mask=unknown),
            pa.array(here.size),
            pa.array(np.where(top, 0, here.n)),
            pa.array(here.n - here.ends),
            pa.array(here.children),
            pa.array(here.leaves),
            pa.array(here.saved),
            # A top goes by the depth it stands at, other rows by that of their top.
            pa.array(np.where(top, -1, m.base[here.start])),
            pa.array(path, pa.list_(pa.int64())),
            pa.array(ends, pa.string()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=names)
        if lists_:
            at = pa.array([k for k, _, _ in lists_])
            part = pa.RecordBatch.from_arrays(columns, names=names).take(at)
            part = part.set_column(0, "kind", pa.array([ENDS] * len(lists_), pa.int32()))
            part = part.set_column(6, "conv_id", pa.array([low for _, low, _ in lists_]))
            yield part.set_column(16, "ends", pa.array([s for _, _, s in lists_], pa.string()))
        above = here


def _shards(chunks: DataFrame) -> DataFrame:
    """Rows of ``OUT`` for all shards of ``chunks``; each shard is a range of the sorted rows.

    The id of the conversation ends the sort key, so copies of one conversation are spread
    over as many shards as they need.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield from _shard_rows(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    cores = chunks.sparkSession.sparkContext.defaultParallelism
    n = chunks.count()
    shards = max(-(-n // SHARD), min(cores, -(-n // 1024)), 1)
    dealt = chunks.repartitionByRange(shards, "base", "ph", "pl", "z", "conv_id")
    return durable(dealt.mapInArrow(run, OUT))


def _turns(conversations: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    name = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    size = F.octet_length(text).cast("long")
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    rows = conversations.where("conv_id is not null")
    return rows.select(conv.alias("conv_id"), turn.alias("turn"), name.alias("id"), size.alias("size"))


def _own() -> Column:
    return F.crc32(F.col("conv_id").cast("string")) % HEAD


def _cells(turns: Column, first: Column) -> list[Column]:
    """Two hashes of position and id for each turn, flat, and the sizes of the texts."""
    z = F.transform(
        turns, lambda t, i: F.array(F.xxhash64(first + i, t["id"]), F.xxhash64(F.lit(1), t["id"], first + i))
    )
    return [F.flatten(z).alias("z"), F.transform(turns, lambda t: t["size"]).alias("sizes")]


def _rebuilt_short(turns: DataFrame, heads: DataFrame) -> DataFrame:
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "id", "size"))).alias("own"))
    rows = _with_head(rows.withColumn("h", _own().cast("int")), heads)
    own = F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0)))
    rows = rows.select("conv_id", F.concat(F.slice("head", 1, F.col("h")), own).alias("all"))
    last = F.greatest(F.size("all") - 1, F.lit(0))
    rows = rows.select("conv_id", "all", F.explode(F.sequence(F.lit(0), last, F.lit(WIDTH))).alias("at"))
    base = F.col("at").cast("long")
    part = F.slice("all", F.col("at") + 1, WIDTH)
    more = (F.size("all") > F.col("at") + WIDTH).alias("more")
    return rows.select("conv_id", base.alias("base"), *_cells(part, base), more)


def _rebuilt_long(numbered: DataFrame, heads: DataFrame) -> DataFrame:
    """The same from rows (conv_id, n, at, id, size), without a row for a whole conversation."""
    convs = numbered.select("conv_id", "n").distinct().withColumn("h", _own())
    convs = _with_head(convs, heads).withColumn("head", F.slice("head", 1, F.col("h").cast("int")))
    convs = durable(convs.withColumn("moved", F.size("head") - F.col("h")))
    rows = numbered.drop("n").join(convs.drop("head"), "conv_id").where("at >= h")
    rows = rows.select("conv_id", (F.col("at") + F.col("moved")).alias("at"), "id", "size", (F.col("n") + F.col("moved")).alias("n"))
    first = convs.select("conv_id", F.posexplode("head").alias("at", "t"), (F.col("n") + F.col("moved")).alias("n"))
    rows = rows.unionByName(first.select("conv_id", F.col("at").cast("long"), "t.id", "t.size", "n"))
    base = (F.col("at") - F.col("at") % WIDTH).alias("base")
    parts = rows.groupBy("conv_id", base, "n").agg(F.sort_array(F.collect_list(F.struct("at", "id", "size"))).alias("part"))
    return parts.select("conv_id", "base", *_cells(F.col("part"), F.col("base")), (F.col("n") > F.col("base") + WIDTH).alias("more"))


def _with_head(convs: DataFrame, heads: DataFrame) -> DataFrame:
    """``convs`` with the first turns of the conversation at the start of the family."""
    heads = heads.withColumnRenamed("conv_id", "family")
    family = F.col("conv_id") - F.col("conv_id") % FAMILY == F.col("family")
    none = F.array().cast("array<struct<id:string,size:bigint>>")
    return convs.join(heads, family, "left").drop("family").withColumn("head", F.coalesce("head", none)).transform(_same_type)


def _same_type(convs: DataFrame) -> DataFrame:
    """Own turns as the head holds them, so that both can be put together."""
    if "own" not in convs.columns:
        return convs
    return convs.withColumn("own", F.transform("own", lambda t: F.struct(t["id"].alias("id"), t["size"].alias("size"))))


def _chunks(conversations: DataFrame, long: int) -> DataFrame:
    """(conv_id, base, z, sizes, more, ph, pl): rebuilt conversations in rows of ``WIDTH`` turns
    from turn ``base`` on, with the key of all turns before."""
    turns = _turns(conversations)
    # A long conversation has more turns than it may take from another one.
    sizes = turns.groupBy("conv_id").count().where(F.col("count") > max(long, HEAD))
    sizes = durable(sizes.select("conv_id"))
    item = F.struct("id", "size")
    if sizes.isEmpty():
        short, numbered = turns, None
    else:
        ids = broadcast_if_small(sizes, BROADCAST_ROWS)
        short = turns.join(ids, "conv_id", "left_anti")
        numbered = with_row_id(turns.join(ids, "conv_id", "left_semi"), ["conv_id", "turn", "id"], "at")
        ends = durable(numbered.groupBy("conv_id").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")))
        numbered = numbered.join(broadcast_if_small(ends, BROADCAST_ROWS), "conv_id")
        numbered = durable(numbered.select("conv_id", "n", (F.col("at") - F.col("first")).alias("at"), "id", "size"))
    firsts = short.where(F.col("conv_id") % FAMILY == 0).groupBy("conv_id")
    firsts = firsts.agg(F.slice(F.sort_array(F.collect_list(F.struct("turn", "id", "size"))), 1, HEAD).alias("head"))
    firsts = firsts.withColumn("head", F.transform("head", lambda t: F.struct(t["id"].alias("id"), t["size"].alias("size"))))
    if numbered is None:
        rows = _rebuilt_short(short, firsts)
    else:
        front = numbered.where(F.col("at") < HEAD).groupBy("conv_id")
        front = front.agg(F.sort_array(F.collect_list(F.struct("at", item.alias("t")))).alias("head"))
        heads = durable(firsts.unionByName(front.withColumn("head", F.transform("head", lambda t: t["t"]))))
        rows = _rebuilt_short(short, heads).unionByName(_rebuilt_long(numbered, heads))
    rows = durable(rows)
    # Only conversations that go on have a key to carry from row to row.
    single = rows.where("base = 0 and not more").withColumns({"ph": F.lit(0).cast("long"), "pl": F.lit(0).cast("long")})
    halves = {"h": 0, "l": 1}
    fold = "aggregate(sequence(0, size(sizes) - 1), 0L, (a, i) -> a ^ element_at(z, 2 * i + {} + 1))"
    sums = {f"x{c}": F.expr(fold.format(half)) for c, half in halves.items()}
    before = "over (partition by conv_id order by base rows between unbounded preceding and 1 preceding)"
    many = rows.where("base > 0 or more").withColumns(sums)
    many = many.withColumns({f"p{c}": F.expr(f"coalesce(bit_xor(x{c}) {before}, 0L)") for c in halves}).drop("xh", "xl")
    return durable(single.unionByName(many))


def _border(out: DataFrame) -> DataFrame:
    """Border nodes put together from all shards, with the sums over their subtrees.

    ``top`` marks the top of a group that is a node of another matrix. Every border node adds
    what is its own and what hangs whole below it to all nodes on its path.
    """
    rows = out.where(F.col("kind") == BORDER).withColumn("top", F.col("base") < 0)
    one = rows.groupBy("top", *KEY).agg(
        *(F.sum(c).alias(c) for c in ("n_convs", "n_on", "n_children", "n_leaves", "saved")),
        F.min("conv_id").alias("conv_id"),
        *(F.max(c).alias(c) for c in ("size", "ph", "pl", "base", "path")),
    )
    own = ~F.col("top")
    one = one.withColumns(
        {
            "n_leaves": F.col("n_leaves") + F.when(own & (F.col("n_on") == 0), 1).otherwise(0),
            "saved": F.col("saved") + F.when(own, (F.col("n_convs") - 1) * F.col("size")).otherwise(0),
        }
    )
    one = durable(one)
    last = F.expr("size(path) div 2 - 1")
    above = F.transform(
        F.sequence(F.lit(0).cast("long"), last),
        lambda i: F.struct(
            ((i == 0) & (F.col("base") > 0)).alias("top"),
            (F.col("base") + i).alias("depth"),
            F.element_at("path", (2 * i + 1).cast("int")).alias("kh"),
            F.element_at("path", (2 * i + 2).cast("int")).alias("kl"),
            F.when((i == last) & ~F.col("top"), 1).otherwise(0).cast("long").alias("n_children"),
        ),
    )
    given = one.where(F.size("path") > 0).select(F.explode(above).alias("to"), "n_leaves", "saved")
    given = given.select("to.*", "n_leaves", "saved")
    both = one.select("top", *KEY, "n_children", "n_leaves", "saved", "conv_id", "n_convs", "ph", "pl")
    both = both.unionByName(given, allowMissingColumns=True)
    return durable(
        both.groupBy("top", *KEY).agg(
            *(F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved")),
            *(F.max(c).alias(c) for c in ("conv_id", "n_convs", "ph", "pl")),
        )
    )


def _border_ends(out: DataFrame) -> DataFrame:
    """Digests of the members that end at border nodes. The lists of the shards follow each
    other; a task reads those of one node in turn, as a digest has no parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for batch in batches:
            for *at, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != key:
                    if sha:
                        yield row(key, sha)
                    key, sha = at, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids.encode())
        if sha:
            yield row(key, sha)

    def row(key: list[int], sha) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(dict(zip([*KEY, "ends"], ([x] for x in (*key, sha.hexdigest())), strict=True)))

    rows = out.where(F.col("kind") == ENDS).select(*KEY, "conv_id", "ends")
    rows = rows.repartition(*KEY).sortWithinPartitions(*KEY, "conv_id")
    return rows.mapInArrow(run, "depth long, kh long, kl long, ends string")


def _wider(nodes: DataFrame, border: DataFrame, chunks: DataFrame) -> DataFrame:
    """``nodes`` with what lies below them in further matrices.

    The sums of each group are laid on one of its conversations, added up from the end of that
    conversation, and given to all nodes on its way.
    """
    tops = border.where("top").select(*KEY, "n_children", "n_leaves", "saved", "conv_id")
    laid = tops.select("conv_id", F.col("depth").alias("base"), "n_leaves", "saved")
    rows = chunks.where("base > 0 or more").join(laid, ["conv_id", "base"], "left")
    after = "over (partition by conv_id order by base desc rows between unbounded preceding and 1 preceding)"
    rows = rows.withColumns({f"t_{c}": F.expr(f"sum({c}) {after}") for c in ("n_leaves", "saved")})
    rows = rows.where("t_n_leaves is not null").select("conv_id", "base", "ph", "pl", "z", "t_n_leaves", "t_saved")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, ph, pl, z, leaves, saved in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                walk = np.array([[ph, pl], *zip(z[::2], z[1::2], strict=True)], np.int64)
                walk = np.bitwise_xor.accumulate(walk, axis=0)
                depth = base + np.arange(len(walk))
                # The top of a later matrix is the last node of the one before.
                walk, depth = (walk, depth) if base == 0 else (walk[1:], depth[1:])
                n = len(depth)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(depth), pa.array(walk[:, 0]), pa.array(walk[:, 1]), pa.array([leaves] * n), pa.array([saved] * n)],
                    names=["depth", "kh", "kl", "n_leaves", "saved"],
                )

    given = rows.mapInArrow(keys, "depth long, kh long, kl long, n_leaves long, saved long")
    given = given.unionByName(tops.select(*KEY, "n_children"), allowMissingColumns=True)
    more = given.groupBy(*KEY).agg(*(F.sum(c).alias(f"more_{c}") for c in ("n_children", "n_leaves", "saved")))
    nodes = nodes.join(more, KEY, "left")
    zero = F.lit(0).cast("long")
    return nodes.withColumns(
        {c: F.col(c) + F.coalesce(f"more_{c}", zero) for c in ("n_children", "n_leaves", "saved")}
    ).drop(*(f"more_{c}" for c in ("n_children", "n_leaves", "saved")))


def prefix_trie(conversations: DataFrame, long: int = LONG) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations (columns of ``RESULT``).

    Turns come in the order of ``turn``, nulls first, equal ones by a hash of role and text;
    null roles and texts are empty. Conversation c takes the first h turns of conversation
    c - c % 5 (with the sign of c) and goes on with its own after its first h. Rows without an
    id belong to no conversation and are left out; an empty table has no nodes. Repeated rows
    are turns like others. Other columns are ignored.

    Turns travel as hashes. Rows of up to ``WIDTH`` turns are dealt out by ranges; each task
    sorts its range as a matrix and reports its nodes, and only nodes of the first and last row
    of a range are put together afterwards. Conversations of more than ``long`` turns are never
    in one row.
    """
    chunks = _chunks(conversations, long)
    out = _shards(chunks)
    border = _border(out)
    ends = _border_ends(out)
    inner = out.where(F.col("kind") == NODE)
    fields = [*KEY, "ph", "pl", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends"]
    edge = border.where("not top").withColumn("parent_conv_id", F.lit(None).cast("long"))
    edge = edge.join(ends, KEY, "left").withColumn("ends", F.coalesce("ends", F.lit(NOTHING)))
    nodes = inner.select(*fields).unionByName(edge.select(*fields))
    parents = border.where("not top").select(*KEY, "conv_id")
    if not chunks.where("more").isEmpty():
        nodes = _wider(nodes, border, chunks)
        parents = parents.unionByName(inner.where(F.col("depth") % WIDTH == 0).select(*KEY, "conv_id"))
    parents = parents.select(
        (F.col("depth") + 1).alias("depth"), F.col("kh").alias("ph"), F.col("kl").alias("pl"), F.col("conv_id").alias("up")
    )
    named = nodes.join(broadcast_if_small(parents, BROADCAST_ROWS), ["depth", "ph", "pl"], "left")
    return named.select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "up").alias("parent_conv_id"), "n_convs", "n_children",
        "n_leaves", F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"),
    )


SQL = rf"""
WITH {CRC32},
own AS (
  SELECT conv_id, {crc32_sql("CAST(conv_id AS VARCHAR)")} % {HEAD} AS h, conv_id - conv_id % {FAMILY} AS family, ts
  FROM (SELECT conv_id, list({{'id': id, 'size': size}} ORDER BY turn NULLS FIRST, id) AS ts FROM (
          SELECT conv_id, turn, md5(CAST(length(role) AS VARCHAR) || ':' || role || text) AS id, strlen(text) AS size
          FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                WHERE conv_id IS NOT NULL))
        GROUP BY conv_id), bits),
rebuilt AS (
  SELECT o.conv_id, list_concat(coalesce(f.ts[1:o.h], []), o.ts[o.h + 1:]) AS ts
  FROM own o LEFT JOIN own f ON f.conv_id = o.family),
steps AS (
  SELECT conv_id, len(ts) AS n, unnest(range(0, len(ts) + 1)) AS depth, list_transform(ts, lambda t: t.id) AS ids, ts FROM rebuilt),
nodes AS (
  SELECT depth, ids[1:depth] AS path, min(conv_id) AS conv_id, count(*) AS n_convs,
         any_value(CASE WHEN depth > 0 THEN ts[depth].size ELSE 0 END) AS size, bool_and(n = depth) AS leaf,
         string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth) AS ends
  FROM steps GROUP BY depth, ids[1:depth]),
sums AS (
  SELECT path[1:d] AS path, count(*) FILTER (leaf) AS n_leaves, sum((n_convs - 1) * size) AS saved,
         count(*) FILTER (depth = d + 1) AS n_children
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM nodes) GROUP BY path[1:d])
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, s.n_children, s.n_leaves,
       CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM nodes n JOIN sums s ON s.path = n.path LEFT JOIN nodes p ON n.depth > 0 AND p.path = n.path[1:n.depth - 1]
"""

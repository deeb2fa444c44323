"""The prefix trie of conversations, its subtree totals by peeling leaves.

Turns are ordered and numbered, conversations may be forked from others, and each distinct
sequence of first turns becomes a node. What a subtree holds comes up from the leaves.

Order. A turn is known by the MD5 of its role and text; only that, the text's length, the
conversation and the turn's number travel. The short rows are partitioned by ranges of
(conversation, turn, digest), so a conversation with a third of all rows lies in many partitions.
What one partition must know of those before it is a row for each partition: its last conversation, how many turns
of it were seen, the first turns of the block's head. ``_passes`` brings these rows together (as
many as there are partitions) and hands each task its own.

Forks. With ``forked``, conversation c is rebuilt: the first h turns of the head of its block, c - c mod
``BLOCK``, then its own after its first h; h = crc32(decimal c) mod ``FORKS``. A head comes before its
block in the order, so its first turns are at hand when they are needed.

Nodes. A prefix's key is the sum of its turns' digests, each spread together with its place, in 128
bits; equal keys at a depth are one node. Rows are added up before they are shuffled.

Peeling. A node of one member has one leaf below (or is it) and saves nothing, so it is complete at once. Each other
node holds a counter of its remaining children. In each round the nodes with none left are complete and send
their totals to their parents, whose counters go down. Where that completes less than half of the nodes,
chains of nodes with one remaining child are drawn together by doubling pointers: the lowest
node's message passes the chain by with what the chain has gathered, and its nodes get their totals at
the end. So rounds are logarithmic in the number of nodes, also for a long conversation that
another one branches off from at each turn.

Ends. A node's ending members are hashed in the order of their ids. They are gathered in chunks of ids (a
bounded range each) and a node's chunks are hashed one after the other as they stream by, for SHA-256 has no
other order; nothing but a chunk is held.

Defined results: null role and text are empty; a null turn comes first; turns of equal number are ordered by
digest; repeated rows are turns of their own; rows without a conversation id belong to none and are left
out; c mod ``BLOCK`` is never negative; other columns are ignored; an empty table has no node, not even a root.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import checkpointed, column, compacted, prepare, tidy
from lodestone.llm.jaccard import mix

#: Conversations of a block, and the number of fork depths (0 to FORKS - 1).
BLOCK, FORKS = 100, 6
#: Conversation ids of a chunk of ends: a bound on what one group holds (memory, not results).
CHUNK = 1 << 14
_U = np.uint64
_KEY = ["depth", "k1", "k2"]


@dataclass
class State:
    """What the partitions before have seen of the conversation and the block that may go on here."""

    conv: int | None = None
    seen: int = 0
    block: int | None = None
    head: list[tuple[int, int, int]] = field(default_factory=list)
    #: All rows of the last conversation of this partition, wherever they are.
    tail_rows: int = 0
    #: (depth, k1, k2) of the conversation that goes on.
    depth: int = 0
    sums: tuple[int, int] = (0, 0)


def taken(conv: int) -> int:
    """Of a forked conversation, how many turns come from its block's head."""
    return zlib.crc32(str(conv).encode()) % FORKS


def _short(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, chars), ordered by ranges, checkpointed."""
    role, text = (F.coalesce(column(turns, c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = turns.select(column(turns, "conv_id").cast("long").alias("conv_id"), column(turns, "turn").cast("long").alias("turn"), digest.alias("digest"), F.length(text).cast("long").alias("chars")).filter("conv_id is not null")
    order = ["conv_id", F.col("turn").asc_nulls_first(), "digest"]
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The sample that the ranges need reads the short rows, not the texts.
    return checkpointed(checkpointed(rows).repartitionByRange(parts, *order).sortWithinPartitions(*order))


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Conversations, digests as two numbers each, lengths."""
    digests = np.frombuffer(b"".join(batch.column("digest").to_pylist()), _U).reshape(-1, 2)
    return batch.column("conv_id").to_numpy(), digests, batch.column("chars").to_numpy()


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition: its first and last conversation and their rows, the first turns of the last block's head."""
    from pyspark import TaskContext

    first = last = None
    counts, head, block = {}, [], None
    for batch in batches:
        conv, digests, chars = _arrays(batch)
        if not len(conv):
            continue
        first = conv[0].item() if first is None else first
        last = conv[-1].item()
        for c in {first, last}:
            counts[c] = counts.get(c, 0) + int(np.count_nonzero(conv == c))
        counts = {c: n for c, n in counts.items() if c in (first, last)}
        if last - last % BLOCK != block:
            block, head = last - last % BLOCK, []
        at = np.flatnonzero(conv == block)[: FORKS - 1 - len(head)]
        head += [(*digests[i].tolist(), chars[i].item()) for i in at]
    if first is not None:
        flat = np.array([x for row in head for x in row], _U)
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (TaskContext.get().partitionId(), first, counts[first], last, counts[last], flat.tobytes())], ["part", "first", "first_rows", "last", "last_rows", "head"])


def _states(found: list) -> dict[int, State]:
    """Each partition's state from the summaries of all, in order."""
    out, now = {}, State()
    for row in found:
        out[row.part] = State(now.conv, now.seen, now.block, list(now.head))
        block = row.last - row.last % BLOCK
        head = [tuple(x) for x in np.frombuffer(row.head, _U).reshape(-1, 3).tolist()]
        seen = row.last_rows + (now.seen if now.conv == row.last else 0)
        now = State(row.last, seen, block, ((now.head if now.block == block else []) + head)[: FORKS - 1])
    # How many rows of its last conversation lie in this partition and before, and then after.
    after: tuple[int | None, int] = (None, 0)
    for row in reversed(found):
        state = out[row.part]
        before = row.last_rows + (state.seen if state.conv == row.last else 0)
        later = after[1] if after[0] == row.last else 0
        state.tail_rows = before + later
        after = (row.first, row.first_rows + (later if row.first == row.last else 0))
    return out


def _length(conv: int, rows: int, head: int, forked: bool) -> int:
    """Turns of a (rebuilt) conversation."""
    if not forked or conv % BLOCK == 0:
        return rows
    return min(taken(conv), head) + max(0, rows - taken(conv))


def _rebuilt(batches: Iterator[pa.RecordBatch], state: State, forked: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """Each batch's rebuilt rows: conversation, depth (0: the root, once each), digests, lengths; in order."""
    now, seen, block, head = state.conv, state.seen, state.block, list(state.head)
    for batch in batches:
        conv, digests, chars = _arrays(batch)
        if not len(conv):
            continue
        begin = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
        ids, rows = conv[begin], np.diff(np.r_[begin, len(conv)])
        goes_on = now == ids[0].item()
        place = np.arange(1, len(conv) + 1) - np.repeat(begin, rows)
        if goes_on:
            place[: rows[0]] += seen
        # First turns of the heads in this batch, after those of the block that goes on.
        heads = {block: head} if block is not None else {}
        for i in np.flatnonzero((conv % BLOCK == 0) & (place < FORKS)):
            heads.setdefault(conv[i].item(), []).append((*digests[i].tolist(), chars[i].item()))
        own = ids % BLOCK == 0 if forked else np.ones(len(ids), bool)
        h = np.array([0 if o else taken(c) for c, o in zip(ids.tolist(), own.tolist())], np.int64)
        given = [() if o else heads.get(c - c % BLOCK, [])[:k] for c, o, k in zip(ids.tolist(), own.tolist(), h.tolist())]
        m = np.array([len(g) for g in given], np.int64)
        stays = place > np.repeat(h, rows)
        depth = (place + np.repeat(m - h, rows))[stays]
        starts = np.ones(len(ids), bool)
        starts[0] = not goes_on
        fresh = [g for g, s in zip(given, starts) if s]
        copied = np.array([x for g in fresh for x in g], _U).reshape(-1, 3)
        copies = m[starts]
        where = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies) + 1
        all_conv = np.concatenate([ids[starts], np.repeat(ids[starts], copies), conv[stays]])
        all_depth = np.concatenate([np.zeros(starts.sum(), np.int64), where, depth])
        all_digests = np.concatenate([np.zeros((starts.sum(), 2), _U), copied[:, :2], digests[stays]])
        all_chars = np.concatenate([np.zeros(starts.sum(), np.int64), copied[:, 2].astype(np.int64), chars[stays]])
        order = np.lexsort((all_depth, all_conv))
        yield all_conv[order], all_depth[order], all_digests[order], all_chars[order]
        now, seen = ids[-1].item(), int(place[-1])
        block = now - now % BLOCK
        head = heads.get(block, [])


def _spread(depth: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """Digests spread together with their places; the root's is 0."""
    at = mix(depth.astype(_U) * _U(0x9E3779B97F4A7C15))
    out = np.stack([mix(digests[:, 0] ^ at), mix(digests[:, 1] + at)], 1)
    out[depth == 0] = 0
    return out


def _tail_sums(states: dict[int, State], forked: bool):
    """Of a partition: its last conversation, the sums of that one's keys here, and whether it begins here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        conv, sums, depth = None, np.zeros(2, _U), 0
        for ids, depths, digests, _ in _rebuilt(batches, states.get(part, State()), forked):
            if not len(ids):
                continue
            if ids[-1] != conv:
                conv, sums = ids[-1].item(), np.zeros(2, _U)
            mine = ids == conv
            sums = sums + _spread(depths[mine], digests[mine]).sum(0, dtype=_U)
            depth = int(depths[-1])
        if conv is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (part, conv, depth, sums.tobytes())], ["part", "conv", "depth", "sums"])

    return run


def _members(states: dict[int, State], forked: bool):
    """Rows of a partition to (conv_id, depth, key, parent's key, chars, whether the conversation ends here)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        state = states.get(TaskContext.get().partitionId(), State())
        now, sums = state.conv, np.array(state.sums, _U)
        heads = {state.block: len(state.head)}
        held: list[np.ndarray] | None = None  # the last row, until it is known what follows
        for ids, depths, digests, chars in _rebuilt(batches, state, forked):
            if not len(ids):
                continue
            spread = _spread(depths, digests)
            if ids[0] == now:
                spread[0] += sums
            running = np.cumsum(spread, 0, dtype=_U)
            begin = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            before = np.zeros((len(begin), 2), _U)
            before[1:] = running[begin[1:] - 1]
            keys = running - np.repeat(before, np.diff(np.r_[begin, len(ids)]), axis=0)
            above = np.zeros_like(keys)
            above[1:] = keys[:-1]
            above[0] = sums if ids[0] == now else 0
            for c, n in zip(ids[begin].tolist(), np.diff(np.r_[begin, len(ids)]).tolist()):
                if c % BLOCK == 0:
                    heads = {c: min(FORKS - 1, heads.get(c, 0) + n - (c != now))}  # less its root
            now, sums = ids[-1].item(), keys[-1]
            rows = [ids, depths, keys, above, chars]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows)]
            held = [x[-1:] for x in rows]
            yield _out([x[:-1] for x in rows], rows[0][1:] != rows[0][:-1])
        if held is not None:
            conv = held[0][0].item()
            full = _length(conv, state.tail_rows, heads.get(conv - conv % BLOCK, 0), forked)
            yield _out(held, held[1] == full)

    return run


def _out(rows: list[np.ndarray], ends: np.ndarray) -> pa.RecordBatch:
    ids, depths, keys, above, chars = rows
    signed = [np.ascontiguousarray(x[:, i]).view(np.int64) for x in (keys, above) for i in (0, 1)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, depths, *signed, chars, ends)], ["conv_id", "depth", "k1", "k2", "q1", "q2", "chars", "ends"])


def members(turns: DataFrame, forked: bool = False) -> DataFrame:
    """A row for each prefix of each (rebuilt) conversation, the empty one too: conv_id, depth, the key
    (k1, k2) and its parent's (q1, q2), the last text's code points, whether the conversation ends with it."""
    prepare(turns.sparkSession)
    rows = _short(turns)
    found = rows.mapInArrow(_summary, "part long, first long, first_rows long, last long, last_rows long, head binary").orderBy("part").collect()
    states = _states(found)
    tails = {t.part: t for t in rows.mapInArrow(_tail_sums(states, forked), "part long, conv long, depth long, sums binary").collect()}
    now, sums = None, np.zeros(2, _U)
    for row in found:
        state = states[row.part]
        state.sums = tuple(sums.tolist()) if state.conv == now else (0, 0)
        if row.last != now:
            now, sums = row.last, np.zeros(2, _U)
        if (tail := tails.get(row.part)) is not None and tail.conv == now:
            sums = sums + np.frombuffer(tail.sums, _U)
    return rows.mapInArrow(_members(states, forked), "conv_id long, depth long, k1 long, k2 long, q1 long, q2 long, chars long, ends boolean")


def _messages(done: DataFrame) -> DataFrame:
    sent = done.groupBy("up_c", "up_d").agg(F.count("*").alias("came"), F.sum(F.col("leaves") + F.col("more_leaves")).alias("in_leaves"), F.sum(F.col("saved") + F.col("more_saved")).alias("in_saved"))
    return sent.withColumnsRenamed({"up_c": "c", "up_d": "d"})


def _chains(chain: DataFrame, left: DataFrame) -> DataFrame:
    """For each node with one remaining child: the first node below that has not, and what the nodes
    from here to there have gathered."""
    child = left.select(F.col("up_c").alias("c"), F.col("up_d").alias("d"), F.col("c").alias("to_c"), F.col("d").alias("to_d"), (F.col("remaining") == 1).alias("on"), F.col("more_leaves").alias("between_leaves"), F.col("more_saved").alias("between_saved"))
    # What an earlier chain between the two has gathered counts for this node.
    at = compacted(chain.join(child, ["c", "d"]).select("c", "d", "to_c", "to_d", (F.col("leaves") + F.col("between_leaves")).alias("leaves"), (F.col("saved") + F.col("between_saved")).alias("saved"), "on"))
    while at.filter("on").head(1):
        far = at.select(F.col("c").alias("to_c"), F.col("d").alias("to_d"), F.col("to_c").alias("far_c"), F.col("to_d").alias("far_d"), F.col("leaves").alias("far_leaves"), F.col("saved").alias("far_saved"), F.col("on").alias("far_on"))
        one = at.join(far, ["to_c", "to_d"], "left")
        at = compacted(
            one.select(
                "c", "d", F.coalesce("far_c", "to_c").alias("to_c"), F.coalesce("far_d", "to_d").alias("to_d"),
                (F.col("leaves") + F.coalesce("far_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("far_saved", F.lit(0))).alias("saved"), F.coalesce("far_on", F.lit(False)).alias("on"),
            )
        )
    return at


def peel(nodes: DataFrame) -> DataFrame:
    """(c, d, leaves, saved) of each node's whole subtree.

    ``nodes``: c, d (a node), up_c, up_d (its parent), remaining (children among ``nodes``), and
    what it holds by itself: leaves, saved.
    """
    left = compacted(nodes.select("c", "d", "up_c", "up_d", F.col("remaining").cast("long"), "leaves", "saved", F.lit(0).cast("long").alias("more_leaves"), F.lit(0).cast("long").alias("more_saved")))
    complete, waiting, count = [], [], left.count()
    while count:
        done = left.filter("remaining = 0")
        complete.append(done.select("c", "d", "leaves", "saved"))
        after = left.filter("remaining > 0").join(_messages(done), ["c", "d"], "left")
        zero = lambda x: F.coalesce(x, F.lit(0).cast("long"))
        left = compacted(after.select("c", "d", "up_c", "up_d", (F.col("remaining") - zero("came")).alias("remaining"), (F.col("leaves") + zero("in_leaves")).alias("leaves"), (F.col("saved") + zero("in_saved")).alias("saved"), "more_leaves", "more_saved"))
        before, count = count, left.count()
        if 2 * count > before:
            chain = left.filter("remaining = 1")
            spans = _chains(chain, left)
            waiting.append(spans.select("c", "d", "to_c", "to_d", "leaves", "saved"))
            # The lowest node takes the place of the chain's top, whose parent is no chain's node.
            tops = chain.select("c", "d", "up_c", "up_d", "more_leaves", "more_saved").join(chain.select(F.col("c").alias("up_c"), F.col("d").alias("up_d")), ["up_c", "up_d"], "left_anti")
            lifted = tops.join(spans, ["c", "d"]).select(F.col("to_c").alias("c"), F.col("to_d").alias("d"), F.col("up_c").alias("new_c"), F.col("up_d").alias("new_d"), (F.col("more_leaves") + F.col("leaves")).alias("by_leaves"), (F.col("more_saved") + F.col("saved")).alias("by_saved"), F.lit(True).alias("lifted"))
            rest = left.filter("remaining <> 1").join(lifted, ["c", "d"], "left")
            pick = lambda new, old: F.when(F.col("lifted"), F.col(new)).otherwise(F.col(old)).alias(old)
            left = compacted(rest.select("c", "d", pick("new_c", "up_c"), pick("new_d", "up_d"), "remaining", "leaves", "saved", pick("by_leaves", "more_leaves"), pick("by_saved", "more_saved")))
            count = left.count()
    if not complete:
        return left.select("c", "d", "leaves", "saved")
    totals = reduce(DataFrame.unionByName, complete)
    for spans in reversed(waiting):
        below = totals.select(F.col("c").alias("to_c"), F.col("d").alias("to_d"), F.col("leaves").alias("low_leaves"), F.col("saved").alias("low_saved"))
        found = spans.join(below, ["to_c", "to_d"]).select("c", "d", (F.col("leaves") + F.col("low_leaves")).alias("leaves"), (F.col("saved") + F.col("low_saved")).alias("saved"))
        totals = totals.unionByName(compacted(found))
    return totals


@tidy
def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in the order of node and ids to one hash for each node."""
    names = ["conv_id", "depth", "ends_sha256"]
    now, sha = None, None
    for batch in batches:
        out = []
        for c, d, chunk in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)):
            if (c, d) != now:
                if now is not None:
                    out.append((*now, sha.hexdigest()))
                now, sha = (c, d), hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(chunk.as_buffer())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, sha.hexdigest())], names)


def _ends(rows: DataFrame, several: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of the nodes at which several conversations end."""
    ended = rows.filter("ends").select(*_KEY, F.col("conv_id").alias("member"))
    chunk = F.floor(F.col("member") / CHUNK).cast("long")
    held = ended.join(several, _KEY).groupBy("conv_id", "depth", chunk.alias("chunk")).agg(F.sort_array(F.collect_list("member")).alias("ids"))
    joined = held.select("conv_id", "depth", "chunk", F.array_join(F.col("ids").cast("array<string>"), ",").alias("text"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return joined.repartition(parts, "conv_id", "depth").sortWithinPartitions("conv_id", "depth", "chunk").mapInArrow(_hashed, "conv_id long, depth long, ends_sha256 string")


def trie(turns: DataFrame, forked: bool = False) -> DataFrame:
    """A row for each node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256."""
    rows = checkpointed(members(turns, forked))
    ending = F.when(F.col("ends"), F.col("conv_id"))
    found = compacted(
        rows.groupBy(*_KEY).agg(
            F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("q1").alias("q1"), F.min("q2").alias("q2"), F.max("chars").alias("chars"), F.count(ending).alias("n_ends"), F.min(ending).alias("end")
        )
    )
    # (q1, q2) at the depth above is the parent; the root has none.
    child = found.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("k1"), F.col("q2").alias("k2"))
    counted = child.agg(F.count("*").alias("n_children"), F.count(F.when(F.col("n_convs") == 1, 1)).alias("alone"))
    parent = found.join(counted, _KEY, "left").select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    placed = found.join(parent, ["depth", "q1", "q2"], "left").join(counted, _KEY, "left")
    none = F.lit(0).cast("long")
    nodes = compacted(placed.select(*_KEY, "conv_id", "parent_conv_id", "n_convs", "chars", "n_ends", "end", F.coalesce("n_children", none).alias("n_children"), F.coalesce("alone", none).alias("alone")))
    shared = nodes.filter("n_convs > 1")
    own = (F.col("alone") + (F.col("n_children") == 0).cast("long")).alias("leaves")
    totals = peel(shared.select(F.col("conv_id").alias("c"), F.col("depth").alias("d"), F.col("parent_conv_id").alias("up_c"), (F.col("depth") - 1).alias("up_d"), (F.col("n_children") - F.col("alone")).alias("remaining"), own, ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")))
    totals = totals.select(F.col("c").alias("conv_id"), F.col("d").alias("depth"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    ended = _ends(rows, shared.filter("n_ends > 1").select(*_KEY, F.col("conv_id")))
    said = F.coalesce("ends_sha256", F.sha2(F.coalesce(F.col("end").cast("string"), F.lit("")).cast("binary"), 256)).alias("ends_sha256")
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    alone = nodes.filter("n_convs = 1").withColumns({"n_leaves": F.lit(1).cast("long"), "saved_tokens": none, "ends_sha256": F.lit(None).cast("string")})
    several = shared.join(totals, ["conv_id", "depth"]).join(ended, ["conv_id", "depth"], "left")
    return alone.select(*out, said).unionByName(several.select(*out, said))

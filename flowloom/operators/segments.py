"""Cutting packets into flows.

A flow opens with the first packet of its key and closes with a FIN or RST packet or with
the first packet later than ``close_us`` after the flow's *first* packet; a silence longer
than ``stale_us`` abandons it. Whether a packet closes a flow depends on where that flow
began, so neither a window function nor a session window can say it; it takes an ordered
walk.

The walk is split so that no task ever holds one whole key. Time is cut in blocks
(``block_us``, named by their first microsecond) and work is distributed by (key, block).
A block of one key that holds more than ``block_rows`` packets is cut again, into as many
equal spans as its count asks for, until every block is below that bound or a single
instant (``blocked``). Block counts are a table of the shared folder, so a busy minute is known
before any packet is moved; packets of the few keys and blocks that were cut find their
span by a join with that short list, all others are not touched.

1. ``_block_table``: one row per (key, block) from a map-side-combined aggregation: first
   and last packet, and from its neighbour block whether the first packet surely opens a
   flow ("hard" start: after FIN/RST, after a long silence, first of the key).
2. Only where a block's first packet is not a hard start does the open flow of the block
   before matter. For those blocks ``_block_maps`` computes, each block on its own, which
   flow is open at its end as a step function of the flow open at its start, and
   ``_entry_states`` chains the step functions in time order. The steps number at most the
   distinct instants in one ``close_us``, usually a handful: flows forget where they began.
3. ``segment`` walks every block on its own with the entry state known.

The walks are numpy over Arrow batches and jump from flow start to flow start by binary
search, for all keys of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.session import scratch_dir

KEY = ("ip_a", "ip_b", "port_a", "port_b", "proto")
_KEY_DDL = "ip_a string, ip_b string, port_a bigint, port_b bigint, proto int"
_KEY_SCHEMA = [
    ("ip_a", pa.string()),
    ("ip_b", pa.string()),
    ("port_a", pa.int64()),
    ("port_b", pa.int64()),
    ("proto", pa.int32()),
]
_NO_ENTRY = -(2**63)
_ANY_ENTRY = _NO_ENTRY + 1


@dataclass(frozen=True)
class FlowRules:
    """How packets become flows.

    key: ``directed`` (source first) or ``canonical`` (smaller endpoint first, both ways).
    ports: protocols whose port fields enter the key; others have ports 0.
    block_us, block_rows: how work is cut, without a bearing on the result.
    inclusive: close at ``>= close_us`` instead of ``>``.
    """

    key: str = "canonical"
    ports: tuple[int, ...] = (1, 6, 17)
    close_us: int = 5_000_000
    inclusive: bool = False
    on_flags: bool = True
    stale_us: int | None = 30_000_000
    min_packets: int = 3
    block_us: int = 60_000_000
    block_rows: int = 500_000

    @property
    def limit(self) -> int:
        return self.close_us - 1 if self.inclusive else self.close_us


LIVE = FlowRules(key="directed")
LIVE_TWO_WAY = FlowRules(key="canonical")
VERSION_1 = FlowRules(key="canonical", ports=(6,), close_us=2_000_000, on_flags=False, stale_us=None, min_packets=1)
VERSION_0 = FlowRules(
    key="directed", ports=(6, 17), close_us=2_000_000, inclusive=True, on_flags=False, stale_us=None, min_packets=2
)


def with_flow_key(packets: DataFrame, rules: FlowRules) -> DataFrame:
    """Add the key columns and ``from_a``: whether the packet comes from the first endpoint."""
    if rules.key not in ("directed", "canonical"):
        raise ValueError(f"unknown key form {rules.key!r}")
    has_ports = F.col("proto").isin(*rules.ports)
    ported = packets.withColumns(
        {
            "key_sport": F.when(has_ports, F.col("sport")).otherwise(F.lit(0)).cast("bigint"),
            "key_dport": F.when(has_ports, F.col("dport")).otherwise(F.lit(0)).cast("bigint"),
        }
    )
    if rules.key == "directed":
        return ported.withColumns(
            {"ip_a": F.col("src_ip"), "ip_b": F.col("dst_ip"), "port_a": F.col("key_sport"), "port_b": F.col("key_dport")}
        ).withColumn("from_a", F.lit(True)).drop("key_sport", "key_dport")
    in_order = (F.col("src_ip") < F.col("dst_ip")) | (
        (F.col("src_ip") == F.col("dst_ip")) & (F.col("key_sport") <= F.col("key_dport"))
    )

    def pick(first: str, second: str) -> Column:
        return F.when(F.col("in_order"), F.col(first)).otherwise(F.col(second))

    return (
        ported.withColumn("in_order", in_order)
        .withColumns(
            {
                "ip_a": pick("src_ip", "dst_ip"),
                "ip_b": pick("dst_ip", "src_ip"),
                "port_a": pick("key_sport", "key_dport"),
                "port_b": pick("key_dport", "key_sport"),
                "from_a": F.col("in_order") | (F.col("src_ip") == F.col("dst_ip")),
            }
        )
        .drop("in_order", "key_sport", "key_dport")
    )


def closing_flag(rules: FlowRules) -> Column:
    """FIN or RST set; packets without TCP flags never close by flag."""
    if not rules.on_flags:
        return F.lit(False)
    return F.coalesce(F.col("tcp_flags").bitwiseAND(F.lit(5)) != 0, F.lit(False))


def _silent(gap: Column, rules: FlowRules) -> Column:
    return F.lit(False) if rules.stale_us is None else gap > F.lit(rules.stale_us)


def _start(ts: Column, start: Column, width: Column) -> Column:
    """Where the span of ``ts`` begins, if spans of ``width`` are counted from ``start``."""
    return start + F.floor((ts - start) / width) * width


def _keyed(packets: DataFrame, rules: FlowRules) -> DataFrame:
    start = F.col("ts_us") - F.pmod(F.col("ts_us"), F.lit(rules.block_us))
    return with_flow_key(packets, rules).withColumns({"flag_close": closing_flag(rules), "block": start.cast("bigint")})


_ID_SHIFT, _TIME_SHIFT = "10BD", "100000000000000000000BD"


def _packed(flag: Column) -> Column:
    """Time, id and a flag as one decimal of at most 38 digits, in order of time and id.

    Times and ids are not negative (``blocked`` raises otherwise). A decimal buffer is changed in place, so that its
    maximum is taken by hash aggregation; with a struct Spark would sort all packets first.
    """
    ts, pkt = (F.col(c).cast("decimal(19,0)") for c in ("ts_us", "pkt_id"))
    total = ts * F.expr(_TIME_SHIFT) + pkt * F.expr(_ID_SHIFT) + flag.cast("int").cast("decimal(1,0)")
    return total.cast("decimal(38,0)")


def _unpacked(packed: Column) -> Column:
    digits = F.lpad(packed.cast("string"), 38, "0")
    parts = [digits.substr(1, 18).cast("bigint").alias("ts_us"), digits.substr(19, 19).cast("bigint").alias("pkt_id"), (digits.substr(38, 1) == "1").alias("flag_close")]
    return F.when(packed.isNotNull(), F.struct(*parts))


def _at(packed: Column) -> Column:
    whole = _unpacked(packed)
    return F.when(packed.isNotNull(), F.struct(whole["ts_us"].alias("ts_us"), whole["pkt_id"].alias("pkt_id")))


def _counted(keyed: DataFrame) -> DataFrame:
    """One row per (key, block), combined before the shuffle."""
    rows = keyed.select(*KEY, "block", "ts_us", "pkt_id", "from_a", _packed(F.col("flag_close")).alias("at"))
    return rows.groupBy(*KEY, "block").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("ts_us").alias("first_ts"),
        F.max("ts_us").alias("last_ts"),
        F.min("pkt_id").alias("least_id"),
        F.max("at").alias("last_pkt"),
        F.max(F.when(F.col("from_a"), F.col("at"))).alias("last_a"),
        F.max(F.when(~F.col("from_a"), F.col("at"))).alias("last_b"),
    )


def _stored(rows: DataFrame, name: str) -> DataFrame:
    path = scratch_dir(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


#: A list of blocks to be cut of at most so many rows is broadcast (about 100 bytes each).
SHORT_LIST = 100_000


def blocked(packets: DataFrame, rules: FlowRules) -> tuple[DataFrame, DataFrame]:
    """Packets with key and ``block``, and the stored table of (key, block) counts.

    No block holds more than ``block_rows`` packets, unless they are all of one instant. A level cuts each block by its own count, so one
    level does for packets that are spread evenly over a busy block, and a few for bursts within bursts.
    """
    keyed = _keyed(packets, rules)
    counts = _stored(_counted(keyed), "blocks")
    on = [*KEY, "block"]
    while True:
        busy = (F.col("n") > rules.block_rows) & (F.col("first_ts") < F.col("last_ts"))
        low, least_id, many = counts.agg(F.min("first_ts"), F.min("least_id"), F.count_if(busy)).first()
        if low is not None and (low < 0 or least_id < 0):
            raise ValueError("packets have times and ids that are not negative")
        if not many:
            return keyed, counts
        spans = F.ceil(F.col("n") * 2 / rules.block_rows)
        width = F.greatest(F.lit(1), F.ceil((F.col("last_ts") - F.col("first_ts") + 1) / spans)).cast("bigint")
        # spans are counted from the block's first packet, whose own block keeps its name
        cuts = _stored(counts.where(busy).select(*on, F.col("first_ts").alias("cut_from"), width.alias("cut_us")), "busy-blocks")
        cuts = F.broadcast(cuts) if many <= SHORT_LIST else cuts
        inside = _start(F.col("ts_us"), F.col("cut_from"), F.col("cut_us")).cast("bigint")
        recut = F.when(F.col("cut_us").isNull() | (inside == F.col("cut_from")), F.col("block")).otherwise(inside)
        again = keyed.join(cuts, on).withColumn("block", recut).drop("cut_from", "cut_us")
        counts = _stored(counts.where(~busy).unionByName(_counted(again)), "blocks")
        keyed = keyed.join(cuts, on, "left").withColumn("block", recut).drop("cut_from", "cut_us")


def _block_table(counts: DataFrame, rules: FlowRules) -> DataFrame:
    """One row per (key, block) with what the blocks around it tell."""
    unpacked = {"last_pkt": _unpacked(F.col("last_pkt")), "last_a": _at(F.col("last_a")), "last_b": _at(F.col("last_b"))}
    summary = counts.drop("n", "last_ts", "least_id").withColumns(unpacked)
    # Rows per key here are at most time span / block_us + 4 packets / block_rows.
    in_time = Window.partitionBy(*KEY).orderBy("block")
    before = in_time.rowsBetween(Window.unboundedPreceding, -1)
    around = summary.select(
        "*",
        F.lag("last_pkt").over(in_time).alias("prev_pkt"),
        F.max("last_a").over(before).alias("prev_a"),
        F.max("last_b").over(before).alias("prev_b"),
        F.lead("block").over(in_time).alias("next_block"),
        F.lead("first_ts").over(in_time).alias("next_first_ts"),
    )
    prev_ts = F.col("prev_pkt.ts_us")
    hard = prev_ts.isNull() | F.col("prev_pkt.flag_close") | _silent(F.col("first_ts") - prev_ts, rules)
    goes_on = (
        F.col("next_block").isNotNull()
        & ~F.col("last_pkt.flag_close")
        & ~_silent(F.col("next_first_ts") - F.col("last_pkt.ts_us"), rules)
    )
    return around.select(
        *KEY,
        "block",
        "next_block",
        "prev_a",
        "prev_b",
        prev_ts.alias("block_prev_ts"),
        hard.alias("hard_first"),
        goes_on.alias("goes_on"),
    )


def _steps_of_block(ts, ids, from_a, hard, prev_ts, limit):
    """The flow open at the block's end, as steps over the flow open at its start.

    Returns (from_ts, exit index) arrays. Exit index -1 passes the entering flow through,
    ``n`` means no flow is open, any other value is the opening packet.
    """
    n = len(ts)
    closer = np.searchsorted(ts, ts + limit, side="right")
    jump = np.append(np.where(closer == n, np.arange(n), np.minimum(closer + 1, n)), n)
    while True:
        further = jump[jump]
        if np.array_equal(further, jump):
            break
        jump = further
    if hard:
        return np.array([_NO_ENTRY, _ANY_ENTRY]), np.array([jump[0], jump[0]])
    # The entering flow closes at packet k if it opened in [ts[k-1]-limit, ts[k]-limit).
    reach = int(np.searchsorted(ts, prev_ts + limit, side="right"))
    k = np.arange(min(reach + 1, n))
    lower = np.where(k == 0, _ANY_ENTRY, ts[np.maximum(k - 1, 0)] - limit)
    target = jump[k + 1]
    if reach >= n:
        lower = np.append(lower, ts[n - 1] - limit)
        target = np.append(target, -1)
    # Packets of one instant share a step (the later ones are empty); equal neighbours merge.
    keep = np.append(lower[1:] > lower[:-1], True)
    lower, target = lower[keep], target[keep]
    lower[0] = _ANY_ENTRY
    change = np.append(True, target[1:] != target[:-1])
    return np.append(_NO_ENTRY, lower[change]), np.append(jump[0], target[change])


_MAP_DDL = f"{_KEY_DDL}, block bigint, next_block bigint, from_ts bigint, passes boolean, exit_ts bigint, exit_id bigint, exit_a boolean"
_MAP_SCHEMA = pa.schema(
    _KEY_SCHEMA
    + [
        ("block", pa.int64()),
        ("next_block", pa.int64()),
        ("from_ts", pa.int64()),
        ("passes", pa.bool_()),
        ("exit_ts", pa.int64()),
        ("exit_id", pa.int64()),
        ("exit_a", pa.bool_()),
    ]
)
_ENTRY_DDL = f"{_KEY_DDL}, block bigint, entry_ts bigint, entry_id bigint, entry_a boolean"
_ENTRY_SCHEMA = pa.schema(
    _KEY_SCHEMA + [("block", pa.int64()), ("entry_ts", pa.int64()), ("entry_id", pa.int64()), ("entry_a", pa.bool_())]
)


def _array(batch: pa.RecordBatch, name: str, null=None) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    if null is not None:
        column = column.fill_null(null)
    return column.to_numpy(zero_copy_only=False)


def _map_batches(limit: int):
    """Rows of going-on blocks, in order -> the step function of each block."""

    ids_of = (*KEY, "block", "next_block")

    def finish(head: tuple, parts: list, hard: bool, done: list) -> None:
        ts, ids, from_a = (np.concatenate([p[i] for p in parts]) for i in range(3))
        lower, target = _steps_of_block(ts, ids, from_a, hard, head[-1], limit)
        none = (target < 0) | (target >= len(ts))
        at = np.where(none, 0, target)
        done.append((head[:-1], lower, target < 0, none, ts[at], ids[at], from_a[at]))

    def packed(done: list) -> pa.RecordBatch:
        heads, *arrays = zip(*done)
        lower, passes, none, ts, ids, from_a = (np.concatenate(a) for a in arrays)
        owner = pa.array(np.repeat(np.arange(len(heads)), [len(x) for x in arrays[0]]))
        columns = [pa.array(values, type=f.type).take(owner) for values, f in zip(zip(*heads), _MAP_SCHEMA)]
        columns += [pa.array(lower), pa.array(passes), *(pa.array(x, mask=none) for x in (ts, ids, from_a))]
        return pa.RecordBatch.from_arrays(columns, schema=_MAP_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, parts, hard = None, [], False
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ts, ids, from_a = _array(batch, "ts_us"), _array(batch, "pkt_id"), _array(batch, "from_a")
            forced, first = _array(batch, "forced"), _array(batch, "block_first")
            cuts = np.union1d(np.flatnonzero(first), [0])
            begins = batch.take(pa.array(cuts))
            heads = list(zip(*(begins.column(begins.schema.get_field_index(c)).to_pylist() for c in (*ids_of, "block_prev_ts"))))
            done = []
            for i, (lo, hi) in enumerate(zip(cuts.tolist(), np.append(cuts[1:], len(ts)).tolist())):
                if first[lo]:
                    if head is not None:
                        finish(head, parts, hard, done)
                    head, parts, hard = heads[i], [], False
                starts = np.flatnonzero(forced[lo:hi])
                if starts.size:  # what lies before the last sure start cannot matter
                    lo, parts, hard = lo + int(starts[-1]), [], True
                parts.append((ts[lo:hi], ids[lo:hi], from_a[lo:hi]))
            if done:
                yield packed(done)
        if head is not None:
            done = []
            finish(head, parts, hard, done)
            yield packed(done)

    return run


def _chain_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step functions in (key, block, from_ts) order -> the flow open at each next block's start.

    A chain begins with a block whose exit does not depend on its entry, so no state is
    carried from key to key. Only the current state and one candidate step are held.
    """
    state, pick = None, None  # pick: (key and next block, passes, exit) of the step that applies so far

    def settle(current, step):
        return current if step[1] else step[2]

    for batch in batches:
        if batch.num_rows == 0:
            continue
        from_ts = _array(batch, "from_ts")
        columns = {name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)}

        def step(i):
            block = tuple(columns[c][i] for c in (*KEY, "next_block"))
            return block, columns["passes"][i], (columns["exit_ts"][i], columns["exit_id"][i], columns["exit_a"][i])

        cuts = np.union1d(np.flatnonzero(from_ts == _NO_ENTRY), [0])
        done = []
        for lo, hi in zip(cuts.tolist(), np.append(cuts[1:], len(from_ts)).tolist()):
            if from_ts[lo] == _NO_ENTRY:
                if pick is not None:
                    state = settle(state, pick)
                    done.append((*pick[0], *state))
                pick = step(lo)
                lo += 1
            if state is not None and state[0] is not None:
                j = lo + int(np.searchsorted(from_ts[lo:hi], state[0], side="right")) - 1
                if j >= lo:
                    pick = step(j)
        if done:
            yield _entry_batch(done)
    if pick is not None:
        yield _entry_batch([(*pick[0], *settle(state, pick))])


def _entry_batch(done: list) -> pa.RecordBatch:
    columns = [pa.array(values, type=f.type) for values, f in zip(zip(*done), _ENTRY_SCHEMA)]
    return pa.RecordBatch.from_arrays(columns, schema=_ENTRY_SCHEMA)


def _in_block() -> tuple:
    order = Window.partitionBy(*KEY, "block").orderBy("ts_us", "pkt_id")
    return order, order.rowsBetween(Window.unboundedPreceding, -1)


def _entry_states(keyed: DataFrame, blocks: DataFrame, rules: FlowRules) -> DataFrame:
    """(key, block) -> the flow open when the block begins, for blocks that need it."""
    order, _ = _in_block()
    on = [*KEY, "block"]
    thin = keyed.select(*on, "ts_us", "pkt_id", "from_a", "flag_close").join(
        blocks.where("goes_on"), on
    )
    prev = F.lag("ts_us").over(order)
    forced = F.when(prev.isNull(), F.col("hard_first")).otherwise(
        F.lag("flag_close").over(order) | _silent(F.col("ts_us") - prev, rules)
    )
    rows = thin.select(
        *on, "next_block", "block_prev_ts", "ts_us", "pkt_id", "from_a", forced.alias("forced"), prev.isNull().alias("block_first")
    ).sortWithinPartitions(*on, "ts_us", "pkt_id")
    steps = rows.mapInArrow(_map_batches(rules.limit), _MAP_DDL)
    ordered = steps.repartition(*KEY).sortWithinPartitions(*on, "from_ts")
    return ordered.mapInArrow(_chain_batches, _ENTRY_DDL)


def cut(ts, new_run, entry_open, entry_ts, limit):
    """Flow starts and time closes over sorted packets of many runs.

    ts: packet times; new_run: first packet of a run (True at 0); entry_open, entry_ts: at
    the first packet of a run, whether and since when a flow is open. Returns for each
    packet the index of its flow's first packet (-1: the entering flow) and whether it
    closes its flow by time.
    """
    n = len(ts)
    run_first = np.flatnonzero(new_run)
    run_of = np.cumsum(new_run) - 1
    run_last = np.append(run_first[1:], n) - 1
    first_ts = ts[run_first]
    since_all = entry_ts[run_first][entry_open[run_first]]
    # a limit beyond the batch's own span closes nothing; cut so that runs fit on one axis of 64 bits
    limit = min(limit, int(ts.max()) - int(min(ts.min(), since_all.min(initial=ts.min()))) + 1)
    width = ts[run_last] - first_ts + limit + 2
    base = np.cumsum(width) - width
    line = ts - first_ts[run_of] + base[run_of]  # one rising axis; runs never overlap on it
    is_start, closes = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)

    def close_and_go_on(closers, runs):
        hit = closers <= run_last[runs]
        closes[closers[hit]] = True
        nxt = closers[hit] + 1
        return nxt[nxt <= run_last[runs[hit]]]

    entered = entry_open[run_first]
    starts = run_first[~entered]
    runs = np.flatnonzero(entered)
    if runs.size:
        since = entry_ts[run_first[runs]] - first_ts[runs] + base[runs]
        closers = np.maximum(np.searchsorted(line, since + limit, side="right"), run_first[runs])
        starts = np.concatenate((starts, close_and_go_on(closers, runs)))
    while starts.size:  # one round per flow of the longest run, all runs together
        is_start[starts] = True
        starts = close_and_go_on(np.searchsorted(line, line[starts] + limit, side="right"), run_of[starts])
    opener = np.maximum.accumulate(np.where(is_start, np.arange(n), -1))
    return np.where(opener < run_first[run_of], -1, opener), closes


def _segment_batches(limit: int):
    """Walk the packets of a partition; the open flow is all that is kept between batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_flow = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ts, ids, from_a = _array(batch, "ts_us"), _array(batch, "pkt_id"), _array(batch, "from_a")
            forced, first = _array(batch, "forced"), _array(batch, "block_first")
            since, since_id = _array(batch, "entry_ts", 0).copy(), _array(batch, "entry_id", 0).copy()
            since_a = _array(batch, "entry_a", False).copy()
            new_run, entered = forced | first, first & ~forced
            if not new_run[0]:
                new_run[0] = True
                if open_flow is not None:
                    entered[0] = True
                    since[0], since_id[0], since_a[0] = open_flow
            opener, closes = cut(ts, new_run, entered, since, limit)
            closes |= _array(batch, "flag_close")
            head = np.maximum.accumulate(np.where(new_run, np.arange(len(ts)), 0))
            inside = opener >= 0
            seg_ts = np.where(inside, ts[opener], since[head])
            seg_id = np.where(inside, ids[opener], since_id[head])
            seg_a = np.where(inside, from_a[opener], since_a[head])
            open_flow = None if closes[-1] else (seg_ts[-1], seg_id[-1], seg_a[-1])
            added = [pa.array(seg_ts), pa.array(seg_id), pa.array(from_a == seg_a), pa.array(closes)]
            names = [*batch.schema.names, "seg_ts", "seg_id", "fwd", "closes"]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=names)

    return run


PACKET_COLUMNS = ("ts_us", "pkt_id", "src_ip", "dst_ip", "sport", "dport", "proto", "tcp_flags")


def segment(packets: DataFrame, rules: FlowRules, keep: Sequence[str] | None = None, gaps: bool = True) -> DataFrame:
    """Packets -> packets with their flow.

    Adds the key columns and: ``seg_ts, seg_id`` (time and id of the flow's first packet),
    ``fwd`` (same source as that packet), ``flag_close``, ``closes`` (this packet closes its
    flow), ``is_last`` (no later packet of the key), ``gap_us`` (since the flow's previous
    packet), ``dgap_us`` (since its previous packet of the same direction).

    keep: the packet columns to carry along, all by default. Whatever is carried is
    shuffled and passes through Arrow, so name only what is read afterwards.
    gaps: whether ``gap_us`` and ``dgap_us`` are wanted; they take window functions of their own.
    """
    needed = [c for c in packets.columns if keep is None or c in keep or c in PACKET_COLUMNS]
    keyed, counts = blocked(packets.select(*needed), rules)
    blocks = _block_table(counts, rules)
    entries = _entry_states(keyed, blocks, rules)
    on = [*KEY, "block"]
    known = blocks.drop("goes_on").join(entries, on, "left")

    order, before = _in_block()
    at = F.struct("ts_us", "pkt_id")
    sides = [
        F.last(F.when(F.col("from_a"), at), ignorenulls=True).over(before).alias("last_a"),
        F.last(F.when(~F.col("from_a"), at), ignorenulls=True).over(before).alias("last_b"),
    ]
    carried = [c for c in needed if keep is None or c in keep or c in ("ts_us", "pkt_id", "proto")]
    placed = keyed.select(
        *on,
        *[c for c in carried if c not in KEY],
        "from_a",
        "flag_close",
        F.lag("ts_us").over(order).alias("in_block_prev_ts"),
        F.lag("flag_close").over(order).alias("prev_close"),
        F.lead("ts_us").over(order).alias("next_ts"),
        *(sides if gaps else []),
    ).join(known, on)
    block_first = F.col("in_block_prev_ts").isNull()
    earlier = []
    if gaps:
        same_side = F.when(F.col("from_a"), F.coalesce("last_a", "prev_a")).otherwise(F.coalesce("last_b", "prev_b"))
        earlier = [
            F.coalesce("in_block_prev_ts", "block_prev_ts").alias("prev_ts"),
            same_side["ts_us"].alias("same_ts"),
            same_side["pkt_id"].alias("same_id"),
        ]
    forced = F.when(block_first, F.col("hard_first") | F.col("entry_ts").isNull()).otherwise(
        F.col("prev_close") | _silent(F.col("ts_us") - F.col("in_block_prev_ts"), rules)
    )
    rows = placed.select(
        *on,
        *[c for c in carried if c not in KEY],
        "from_a",
        "flag_close",
        block_first.alias("block_first"),
        forced.alias("forced"),
        *earlier,
        (F.col("next_ts").isNull() & F.col("next_block").isNull()).alias("is_last"),
        "entry_ts",
        "entry_id",
        "entry_a",
    ).sortWithinPartitions(*on, "ts_us", "pkt_id")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    walked = rows.mapInArrow(
        _segment_batches(rules.limit), f"{ddl}, seg_ts bigint, seg_id bigint, fwd boolean, closes boolean"
    )
    opens = (F.col("ts_us") == F.col("seg_ts")) & (F.col("pkt_id") == F.col("seg_id"))
    same_flow = (F.col("same_ts") > F.col("seg_ts")) | (
        (F.col("same_ts") == F.col("seg_ts")) & (F.col("same_id") >= F.col("seg_id"))
    )
    since = [
        F.when(~opens, F.col("ts_us") - F.col("prev_ts")).alias("gap_us"),
        F.when(same_flow, F.col("ts_us") - F.col("same_ts")).alias("dgap_us"),
    ]
    return walked.select(
        *KEY,
        *[c for c in carried if c not in KEY],
        "from_a",
        "flag_close",
        "is_last",
        "seg_ts",
        "seg_id",
        "fwd",
        "closes",
        *(since if gaps else []),
    )

"""The flow tracker as a stream: keyed state, event time, the close rules of the batch form.

Keys are dealt into ``groups`` and the operator is called once per group, not per key, so that all rows of a group that are due are
walked by numpy at once and a call to the state is paid by many flows. Rows may arrive in any order within the watermark
delay; they wait in the list state of ``Ordered``. Those that are due are walked in (key, time, id) order and leave only running totals of
the open flows in a value state: counts, and count / sum / min / max / mean / squared deviation per series. Mean and squared deviation take
one packet after the other, so they do not depend on how micro-batches were cut. Rows behind the watermark are
dropped by Spark and counted in the query progress. A flow silent for longer than ``stale_us`` is ended by the timer. Flows still open
when the input ends are never emitted.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.operators.flows import FLOW_ID, IDLE_US
from flowloom.operators.segments import KEY, FlowRules, closing_flag, cut, with_flow_key
from flowloom.streaming.ordered import GROUPS, LATER, Ordered, in_groups, with_event_time

SERIES = ("pkt_len", "fwd_pkt_len", "bwd_pkt_len", "flow_iat", "fwd_iat", "bwd_iat", "active", "idle")
FLAG_COUNTS = {
    "fin_flag_cnt": 1, "syn_flag_cnt": 2, "rst_flag_cnt": 4, "psh_flag_cnt": 8,
    "ack_flag_cnt": 16, "urg_flag_cnt": 32, "ece_flag_cnt": 64, "cwe_flag_count": 128,
}
COUNTS = (
    "tot_fwd_pkts", "tot_bwd_pkts", "fwd_header_len", "bwd_header_len",
    "fwd_psh_flags", "bwd_psh_flags", "fwd_urg_flags", "bwd_urg_flags", "fwd_act_data_pkts", *FLAG_COUNTS,
)
TOTALS = {"totlen_fwd_pkts": "fwd_pkt_len", "totlen_bwd_pkts": "bwd_pkt_len", "fwd_iat_tot": "fwd_iat", "bwd_iat_tot": "bwd_iat"}
BUFFERED = ("ts_us", "pkt_id", "from_a", "flag_close", "pkt_len", "flags", "window", "hdr", "payload")
WAITING = pa.schema([(c, pa.int64()) for c in BUFFERED] + [("iface", pa.string()), ("key", pa.string())])

_long, _bool, _double, _text = T.LongType(), T.BooleanType(), T.DoubleType(), T.StringType()
OPEN_FLOWS = T.StructType(
    [
        T.StructField("keys", T.ArrayType(_text)),
        T.StructField("ifaces", T.ArrayType(_text)),
        T.StructField("whole", T.BinaryType()),  # int64 per flow: HEAD, COUNTS, then n, sum, min, max of each series
        T.StructField("moments", T.BinaryType()),  # float64 per flow: mean and squared deviation of each series
    ]
)
HEAD = ("start", "id", "side", "last", "last_fwd", "last_bwd", "window_fwd", "window_bwd", "n_pkts")
START, ID, SIDE, LAST, LAST_FWD, LAST_BWD, WINDOW_FWD, WINDOW_BWD, N_PKTS = range(len(HEAD))
WIDTH = len(HEAD) + len(COUNTS) + 4 * len(SERIES)
KEY_TYPES = T.StructType([T.StructField(n, t) for n, t in zip(KEY, (_text, _text, _long, _long, T.IntegerType()), strict=True)])


def _output() -> T.StructType:
    fields = [("seg_ts", _long), ("seg_id", _long), ("n_pkts", _long), ("closed", _bool), ("closed_by_flag", _bool)]
    fields += [("opened_from_a", _bool), ("first_us", _long), ("last_us", _long), ("iface", _text), ("status", _text)]
    fields += [("init_fwd_win_byts", _long), ("init_bwd_win_byts", _long)]
    fields += [(c, _long) for c in (*COUNTS, *TOTALS)]
    for s in SERIES:
        fields += [(f"{s}_max", _long), (f"{s}_min", _long), (f"{s}_mean", _double), (f"{s}_std", _double)]
    fields += [("pkt_len_var", _double)]
    return T.StructType([T.StructField(n, t) for n, t in fields])


OUTPUT = _output()
_FOUND = T.StructType([T.StructField("key", _text), *OUTPUT.fields])
_NONE = -(2**62)
#: Below so many flows that still have values, they are taken one by one.
_FEW = 8


def _one_by_one(n: np.ndarray, mean: np.ndarray, m2: np.ndarray, x: np.ndarray, begins: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and squared deviation of series (Welford) after ``many`` further values of x each, in order; all series at once."""
    order = np.argsort(-many, kind="stable")
    begins, many, n, mean, m2 = begins[order], many[order], n[order].astype(float), mean[order], m2[order]
    k = 0
    while (left := int(np.searchsorted(-many, -k))) >= _FEW:
        value, old = x[begins[:left] + k], mean[:left].copy()
        n[:left] += 1
        mean[:left] += (value - old) / n[:left]
        m2[:left] += (value - mean[:left]) * (value - old)
        k += 1
    for i in range(left):
        count, old, deviation = float(n[i]), float(mean[i]), float(m2[i])
        for value in x[begins[i] + k : begins[i] + many[i]].tolist():
            count += 1
            new = old + (value - old) / count
            deviation += (value - new) * (value - old)
            old = new
        mean[i], m2[i] = old, deviation
    back = np.argsort(order)
    return mean[back], m2[back]


class _Flows:
    """Running totals of flows, one row each."""

    def __init__(self, key: np.ndarray, iface: np.ndarray, whole: np.ndarray, moments: np.ndarray) -> None:
        size = len(key)
        self.key, self.iface, self.whole = key, iface, whole.reshape(size, WIDTH)
        self.moments = moments.reshape(size, len(SERIES), 2)
        self.head, self.counts = self.whole[:, : len(HEAD)], self.whole[:, len(HEAD) : len(HEAD) + len(COUNTS)]
        self.series = self.whole[:, len(HEAD) + len(COUNTS) :].reshape(size, len(SERIES), 4)

    @classmethod
    def new(cls, key: np.ndarray, iface: np.ndarray) -> _Flows:
        size = len(key)
        whole = np.zeros((size, WIDTH), dtype=np.int64)
        whole[:, LAST_FWD : WINDOW_BWD + 1] = _NONE
        return cls(key, iface, whole, np.zeros((size, len(SERIES), 2)))

    @classmethod
    def restore(cls, state: tuple | None) -> _Flows:
        if state is None:
            return cls.new(np.array([], dtype=object), np.array([], dtype=object))
        keys, ifaces, whole, moments = state
        key, iface = (np.array(list(x), dtype=object) for x in (keys, ifaces))
        return cls(key, iface, np.frombuffer(whole, dtype=np.int64), np.frombuffer(moments))

    def state(self) -> tuple:
        return self.key.tolist(), self.iface.tolist(), self.whole.tobytes(), self.moments.tobytes()

    def take(self, which: np.ndarray) -> _Flows:
        return _Flows(self.key[which], self.iface[which], self.whole[which], self.moments[which])

    def put(self, which: np.ndarray, other: _Flows) -> None:
        self.key[which], self.iface[which], self.whole[which], self.moments[which] = other.key, other.iface, other.whole, other.moments

    def joined(self, other: _Flows) -> _Flows:
        pairs = ((self.key, other.key), (self.iface, other.iface), (self.whole, other.whole), (self.moments, other.moments))
        return _Flows(*(np.concatenate(p) for p in pairs))

    def add(self, rows: dict[str, np.ndarray], flow: np.ndarray, lo: np.ndarray, hi: np.ndarray, known: np.ndarray) -> None:
        """Take in packets, in order. flow: of each packet; lo, hi: the packets of each flow; known: whether it had packets before."""
        ts, length, flags = rows["ts_us"], rows["pkt_len"], rows["flags"]
        fwd = rows["from_a"] == self.head[flow, SIDE]
        bwd = ~fwd
        gap, has_gap = np.diff(ts, prepend=0), np.ones(len(ts), dtype=bool)
        gap[lo], has_gap[lo] = ts[lo] - self.head[:, LAST], known
        sides = []
        for side, last, window in ((fwd, LAST_FWD, WINDOW_FWD), (bwd, LAST_BWD, WINDOW_BWD)):
            at = np.flatnonzero(side)
            of, own = flow[at], ts[at]
            begins = np.diff(of, prepend=-1) != 0
            before = self.head[of[begins], last]
            gaps, has = np.diff(own, prepend=0), ~begins
            gaps[begins], has[begins] = own[begins] - before, before != _NONE
            fresh = np.flatnonzero(begins)[before == _NONE]
            self.head[of[fresh], window] = rows["window"][at[fresh]]
            ends = np.flatnonzero(np.diff(of, append=-1))
            self.head[of[ends], last] = own[ends]
            sides.append((gaps[has], of[has]))
        self.head[:, LAST] = ts[hi - 1]
        self.head[:, N_PKTS] += hi - lo
        told, idle = ~rows["no_len"], gap > IDLE_US
        series = [(length[m], flow[m]) for m in (told, told & fwd, told & bwd)]
        series += [(gap[has_gap], flow[has_gap]), *sides]
        series += [(gap[m], flow[m]) for m in (has_gap & ~idle, has_gap & idle)]
        for i, (x, of) in enumerate(series):
            if x.size:
                self._merge(i, x, of)
        psh, urg, zero = (flags & 8) != 0, (flags & 32) != 0, np.int64(0)
        sums = [
            fwd, bwd, np.where(fwd, rows["hdr"], zero), np.where(bwd, rows["hdr"], zero),
            psh & fwd, psh & bwd, urg & fwd, urg & bwd, fwd & (rows["payload"] > 0),
            *((flags & mask) != 0 for mask in FLAG_COUNTS.values()),
        ]
        for i, x in enumerate(sums):
            self.counts[:, i] += np.add.reduceat(x.astype(np.int64), lo)

    def _merge(self, i: int, x: np.ndarray, of: np.ndarray) -> None:
        begins = np.flatnonzero(np.diff(of, prepend=-1))
        at, many = of[begins], np.diff(begins, append=x.size)
        n, total, low, high = self.series[at, i].T
        mean, m2 = self.moments[at, i].T
        self.moments[at, i] = np.stack(_one_by_one(n, mean, m2, x, begins, many), axis=1)
        least, most = np.minimum.reduceat(x, begins), np.maximum.reduceat(x, begins)
        first = n == 0
        low, high = np.where(first, least, np.minimum(low, least)), np.where(first, most, np.maximum(high, most))
        self.series[at, i] = np.stack([n + many, total + np.add.reduceat(x, begins), low, high], axis=1)

    def rows(self, status: str, by_flag: np.ndarray | bool = False) -> pd.DataFrame:
        h = self.head
        out = {"key": self.key, "seg_ts": h[:, START], "seg_id": h[:, ID], "n_pkts": h[:, N_PKTS], "closed": status == "closed"}
        out.update(closed_by_flag=by_flag, opened_from_a=h[:, SIDE] != 0, first_us=h[:, START], last_us=h[:, LAST], iface=self.iface)
        out.update(status=status, init_fwd_win_byts=np.maximum(h[:, WINDOW_FWD], 0), init_bwd_win_byts=np.maximum(h[:, WINDOW_BWD], 0))
        out.update(zip(COUNTS, self.counts.T, strict=True))
        out.update({c: self.series[:, SERIES.index(s), 1] for c, s in TOTALS.items()})
        for i, s in enumerate(SERIES):
            n, total, low, high = self.series[:, i].T
            some = np.maximum(n, 1)
            variance = self.moments[:, i, 1] / some
            out.update({f"{s}_max": high, f"{s}_min": low, f"{s}_mean": total / some, f"{s}_std": np.sqrt(variance)})
            if s == "pkt_len":
                out["pkt_len_var"] = variance
        return pd.DataFrame(out, columns=_FOUND.names)


def _walk(rows: dict[str, np.ndarray], held: _Flows, rules: FlowRules) -> tuple[list[pd.DataFrame], _Flows]:
    """Walk packets of many keys; returns the closed or abandoned flows and the open ones."""
    known = len(held.key)
    codes = pd.factorize(np.concatenate([held.key, rows["key"]]))[0]  # the key of an open flow has its number
    order = np.lexsort((rows["pkt_id"], rows["ts_us"], codes[known:]))
    rows, code = {c: v[order] for c, v in rows.items()}, codes[known:][order]
    ts, by_flag = rows["ts_us"], rows["flag_close"] != 0
    n = len(ts)
    first = np.diff(code, prepend=-1) != 0
    goes_on = np.flatnonzero(first & (code < known))  # first packets of keys with an open flow
    before, since = np.append(ts[:1], ts[:-1]), np.zeros(n, dtype=np.int64)
    before[first] = ts[first]
    before[goes_on], since[goes_on] = held.head[code[goes_on], LAST], held.head[code[goes_on], START]
    forced = first & (code >= known)
    forced |= ~first & np.append(False, by_flag[:-1])
    if rules.stale_us is not None:
        forced |= ts - before > rules.stale_us
    opener, closes = cut(ts, first | forced, first & ~forced, since, rules.limit)
    starts = first | (opener == np.arange(n))
    lo = np.flatnonzero(starts)
    hi = np.append(lo[1:], n)
    entered = opener[lo] < 0
    flows = _Flows.new(rows["key"][lo], rows["iface"][lo])
    flows.put(np.flatnonzero(entered), held.take(code[lo[entered]]))
    for slot, name in ((START, "ts_us"), (ID, "pkt_id"), (SIDE, "from_a")):
        flows.head[~entered, slot] = rows[name][lo[~entered]]
    flows.add(rows, np.cumsum(starts) - 1, lo, hi, entered)
    flagged = by_flag[hi - 1]
    closed = closes[hi - 1] | flagged
    last = np.append(first[1:], True)[hi - 1]
    left = code[lo[first[lo] & ~entered & (code[lo] < known)]]
    quiet = np.ones(known, dtype=bool)
    quiet[code[goes_on]] = False
    done = [flows.take(closed).rows("closed", flagged[closed]), flows.take(~closed & ~last).rows("stale"), held.take(left).rows("stale")]
    return done, held.take(quiet).joined(flows.take(~closed & last))


class Tracker(Ordered):
    """The open flows of a group are the value state; flows that fall silent are ended by the timer."""

    def __init__(self, rules: FlowRules) -> None:
        super().__init__(WAITING)
        self.rules = rules

    def opened(self, handle):
        self.flows = handle.getValueState("flows", OPEN_FLOWS)

    def due(self, key, rows, watermark_us):
        state = self.flows.get()
        held, done = _Flows.restore(state), []
        if rows.num_rows:
            length = rows["pkt_len"].combine_chunks()
            columns = {c: rows[c].to_numpy() for c in rows.column_names if c != "pkt_len"}
            columns |= {"pkt_len": length.fill_null(0).to_numpy(), "no_len": length.is_null().to_numpy(zero_copy_only=False)}
            done, held = _walk(columns, held, self.rules)
        if self.rules.stale_us is not None:
            silent = held.head[:, LAST] + self.rules.stale_us < watermark_us
            done.append(held.take(silent).rows("stale"))
            held = held.take(~silent)
        some = len(held.key) > 0
        if some:
            self.flows.update(held.state())
        elif state is not None:
            self.flows.clear()
        done = [d for d in done if len(d)]
        again = int(held.head[:, LAST].min()) + self.rules.stale_us if some and self.rules.stale_us is not None else None
        return pd.concat(done, ignore_index=True) if done else None, again


def track(packets: DataFrame, rules: FlowRules, delay: str = "10 seconds", groups: int = GROUPS) -> DataFrame:
    """A stream of tracked packets -> a stream of ended flows (``closed`` and ``stale``).

    All rows of a group of keys meet in one task, as keyed state requires; its load is bounded by the
    source's rate limit, and its memory by the rows inside the watermark delay. ``groups`` has to stay the same for a checkpoint.
    """
    flags = F.coalesce(F.col("tcp_flags"), F.lit(0))
    header = F.when(F.col("proto") == 6, F.coalesce(F.nullif("tcp_dataofs", F.lit(0)), F.lit(5)) * 4).otherwise(0)
    rows = with_event_time(with_flow_key(packets, rules).withColumn("ts_us", F.col("ts_us") + LATER), delay).select(
        F.to_json(F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in KEY_TYPES])).alias("key"),
        "ts",
        "ts_us",
        "pkt_id",
        F.col("from_a").cast("bigint").alias("from_a"),
        closing_flag(rules).cast("bigint").alias("flag_close"),
        "pkt_len",
        flags.cast("bigint").alias("flags"),
        F.coalesce("tcp_window", F.lit(0)).cast("bigint").alias("window"),
        header.cast("bigint").alias("hdr"),
        F.coalesce("tcp_payload_len", F.lit(0)).cast("bigint").alias("payload"),
        "iface",
    )
    found = in_groups(rows, "key", groups).transformWithStateInPandas(Tracker(rules), _FOUND, "append", "EventTime")
    found = found.withColumns({c: F.col(c) - LATER for c in ("seg_ts", "first_us", "last_us")} | {"_key": F.from_json("key", KEY_TYPES)})
    return found.select("_key.*", *OUTPUT.names)


def scorable(ended: DataFrame, rules: FlowRules) -> DataFrame:
    """The closed flows long enough to be scored."""
    return ended.where(F.col("closed") & (F.col("n_pkts") >= rules.min_packets))


__all__ = ["FLOW_ID", "OUTPUT", "scorable", "track", "with_event_time"]

"""Stateful processors: state per key in the state store, rows applied in event order.

A micro-batch brings a key's rows in Arrow batches of any order.  One batch is
sorted in memory; a key with more of them is spooled into the state store by time
slot and read back slot by slot, so no task holds more than one Arrow batch or
one slot of a key.  The spool is empty again when the rows are done.
"""

from __future__ import annotations

import io
from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ORDER = ["ts_us", "seq"]
SLOT_US = 60_000_000


def _packed(pdf: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(pdf, preserve_index=False)
    out = io.BytesIO()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue()


def _unpacked(raw: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(raw).read_pandas()


class Ordered(StatefulProcessor):
    """Base of processors whose rows carry ts_us and seq.

    ``keep_us``: a key without rows for so long in event time loses its state, at
    once for its own next row and by a timer when the watermark has passed; None
    keeps it.  Subclasses give ``opened`` (make the state), ``start`` (read
    it), ``step`` (one row to one tuple of output), ``finish`` (write it back) and
    ``forget``.
    """

    columns: tuple[str, ...] = ()

    def __init__(self, keep_us: int | None = None, slot_us: int = SLOT_US):
        self.keep_us, self.slot_us = keep_us, slot_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spool = handle.getMapState("spool", "slot long, part long", "rows binary")
        self.until = handle.getValueState("until", "us long")
        self.opened(handle)

    def in_order(self, rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, parts = next(rows, None), {}
        if first is None:
            return
        for part, pdf in enumerate(rows, 1):
            if first is not None:
                self._spool(first, 0, parts)
                first = None
            self._spool(pdf, part, parts)
        if first is not None:
            yield first.sort_values(ORDER, kind="stable")
            return
        for slot in sorted(parts):
            frames = []
            for part in parts[slot]:
                frames.append(_unpacked(bytes(self.spool.getValue((slot, part))[0])))
                self.spool.removeKey((slot, part))
            yield pd.concat(frames).sort_values(ORDER, kind="stable")

    def _spool(self, pdf: pd.DataFrame, part: int, parts: dict[int, list[int]]) -> None:
        for slot, rows in pdf.groupby(pdf["ts_us"] // self.slot_us):
            self.spool.updateValue((int(slot), part), (_packed(rows),))
            parts.setdefault(int(slot), []).append(part)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.start()
        end = int(self.until.get()[0]) if self.keep_us is not None and self.until.exists() else None
        armed = end
        for pdf in self.in_order(rows):
            made = []
            for row in pdf.itertuples(index=False):
                if end is not None and row.ts_us > end:  # past its end, though its timer has not fired
                    self.forget()
                    self.start()
                made.append(self.step(row))
                needed = self.needed_from(int(row.ts_us))
                if self.keep_us is not None and needed is not None:
                    end = max(end or 0, needed + self.keep_us)
            out = pd.DataFrame(made, columns=list(self.columns))
            for name, value in zip(self.keys, key, strict=True):
                out[name] = value
            yield out[[*self.keys, *self.columns]]
        self.finish()
        if end != armed:
            # One timer per key, at the end of what its state is needed for.
            if armed is not None:
                self.handle.deleteTimer(armed // 1000 + 1)
            self.until.update((end,))
            self.handle.registerTimer(end // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.forget()
        self.until.clear()
        return iter(())

    def needed_from(self, at: int) -> int | None:
        """The time from which ``keep_us`` counts, after a row at ``at``."""
        return at

    def close(self) -> None:
        pass


class RateLimit(Ordered):
    """At most ``limit`` accepted requests in any trailing window; state: their times, never more than ``limit``."""

    keys, columns = ("key",), ("seq", "accepted")

    def __init__(self, limit: int, span_us: int):
        super().__init__(keep_us=span_us)
        self.limit, self.span = limit, span_us

    def opened(self, handle):
        self.times = handle.getListState("recent", "at long")

    def start(self):
        self.recent = deque(int(r[0]) for r in self.times.get()) if self.times.exists() else deque()

    def step(self, row):
        while self.recent and row.ts_us - self.recent[0] >= self.span:
            self.recent.popleft()
        accepted = len(self.recent) < self.limit
        if accepted:
            self.recent.append(int(row.ts_us))
        return row.seq, accepted

    def finish(self):
        if self.recent:
            self.times.put([(t,) for t in self.recent])

    def needed_from(self, at):
        return self.recent[-1] if self.recent else None

    def forget(self):
        self.times.clear()


class Budget(Ordered):
    """Two events per call: a reservation is admitted or refused, a settlement gives its usage.

    A call counts from its reservation on, and while its usage is not known, be it
    open or settled without usage, later calls are refused.  Nothing is given
    back.  A settlement changes later decisions only.
    """

    keys, columns = ("key",), ("seq", "kind", "call_id", "reason")

    def __init__(self, limits: dict, keep_us: int | None = None):
        super().__init__(keep_us=keep_us)
        self.limits = limits
        self.stop_nano = round(limits["stop_after_estimated_usd"] * 1_000_000_000)

    def opened(self, handle):
        self.calls = handle.getMapState("calls", "call_id string", "open boolean")
        self.totals = handle.getValueState("totals", "n long, unknown long, tokens_in long, tokens_out long, nano long")

    def start(self):
        known = self.totals.exists()
        self.now = [int(x) for x in self.totals.get()] if known else [0] * 5
        # Only admitted calls are held, at most ``max_invocations`` of them.
        self.held = {k[0]: bool(v[0]) for k, v in self.calls.iterator()} if known else {}
        self.changed = set()

    def step(self, row):
        reason = self.reserve(row) if row.kind == "reserve" else self.settle(row)
        return row.seq, row.kind, row.call_id, reason

    def reserve(self, row) -> str | None:
        n, unknown, tokens_in, tokens_out, nano = self.now
        limits = self.limits
        if row.call_id in self.held:
            return "duplicate_invocation"
        if row.input_bytes > limits["max_request_bytes"]:
            return "request_bytes"
        if n >= limits["max_invocations"]:
            return "invocation_limit"
        if unknown:
            return "unaccounted_invocation"
        if tokens_in >= limits["stop_after_input_tokens"]:
            return "reported_input_token_threshold"
        if tokens_out >= limits["stop_after_output_tokens"]:
            return "reported_output_token_threshold"
        if nano >= self.stop_nano:
            return "estimated_cost_threshold"
        self.mark(row.call_id, True)
        self.now[0] += 1
        self.now[1] += 1
        return None

    def settle(self, row) -> str | None:
        if not self.held.get(row.call_id):
            return "settled_or_missing"
        self.mark(row.call_id, False)
        if row.known:
            self.now[1] -= 1
            for i, x in ((2, row.tokens_in), (3, row.tokens_out), (4, row.nano_usd)):
                self.now[i] += int(x)
        return None

    def mark(self, call_id, is_open: bool) -> None:
        self.held[call_id] = is_open
        self.changed.add(call_id)

    def finish(self):
        for call_id in self.changed:
            self.calls.updateValue((call_id,), (self.held[call_id],))
        self.totals.update(tuple(self.now))

    def forget(self):
        self.calls.clear()
        self.totals.clear()


class Jobs(Ordered):
    """Decision on every compile request and the job state after every event."""

    keys, columns = ("key",), ("seq", "decision", "state")

    def opened(self, handle):
        self.job = handle.getValueState("job", "state string, owner string")

    def start(self):
        self.current, self.owner = self.job.get() if self.job.exists() else (None, None)

    def step(self, row):
        decision = None
        if row.kind == "request":
            running = self.current in ("queued", "processing")
            if running and self.owner != row.analysis_key:
                decision = "conflict"
            elif self.current not in (None, "failed") and self.owner == row.analysis_key:
                decision = "joined"
            else:
                decision, self.current, self.owner = "queued", "queued", row.analysis_key
        elif self.current is not None:
            self.current = row.kind
        return row.seq, decision, self.current

    def finish(self):
        self.job.update((self.current, self.owner))

    def forget(self):
        self.job.clear()


class Progress(Ordered):
    """Progress and revision of a session after each of its patches.

    State: the totals, and per chapter the characters read, which is read and written at once.
    """

    keys, columns = ("session_id", "book_id"), ("seq", "visible", "progress_basis_points", "revision")

    def opened(self, handle):
        self.totals = handle.getValueState("totals", "visible long, revision long")
        self.reach = handle.getListState("reach", "chapter string, chars long")

    def start(self):
        known = self.totals.exists()
        self.visible, self.revision = (int(x) for x in self.totals.get()) if known else (0, 1)
        self.read = {c: int(n) for c, n in self.reach.get()} if known and self.reach.exists() else {}
        self.further = False

    def step(self, row):
        if pd.notna(row.reach) and row.reach > self.read.get(row.chapter, 0):
            self.visible += int(row.reach) - self.read.get(row.chapter, 0)
            self.read[row.chapter] = int(row.reach)
            self.further = True
        self.revision += 1
        points = min(10_000, self.visible * 10_000 // int(row.total)) if pd.notna(row.total) and row.total else 0
        return row.seq, self.visible, points, self.revision

    def finish(self):
        self.totals.update((self.visible, self.revision))
        if self.further:
            self.reach.put(list(self.read.items()))

    def forget(self):
        self.totals.clear()
        self.reach.clear()


def stateful(stream, processor: Ordered, schema: str):
    """Rows of ``stream`` through a processor; state that can expire follows the watermark of ``at``.

    Such state lives in RocksDB, on the executor's disk with checkpoints in the
    shared folder, whatever the number of keys.
    """
    spark = stream.sparkSession
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    mode = "None" if processor.keep_us is None else "EventTime"
    return stream.groupBy(*processor.keys).transformWithStateInPandas(processor, schema, "append", mode)



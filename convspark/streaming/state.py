"""Stateful processors of the frame-log streams (``transformWithState``).

They run inside Python workers, so they use nothing of this package at run
time: what they need travels with them as plain attributes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor


def _whole(pdfs) -> dict[str, np.ndarray]:
    """The columns of a key's rows in one micro-batch."""
    parts = list(pdfs)
    return {c: np.concatenate([p[c].to_numpy() for p in parts]) if len(parts) > 1 else parts[0][c].to_numpy() for c in parts[0].columns}


def _slice(pdfs) -> dict[str, np.ndarray]:
    """The columns of a key's rows in one micro-batch, by ``seq``."""
    whole = _whole(pdfs)
    order = np.argsort(whole["seq"], kind="stable")
    return {c: v[order] for c, v in whole.items()}


def _slices(pdfs, by: str):
    """The rows of each value of ``by`` in one micro-batch of a key, by ``seq``."""
    whole = _whole(pdfs)
    codes, values = pd.factorize(whole[by])
    order = np.lexsort((whole["seq"], codes))
    whole = {c: v[order] for c, v in whole.items()}
    at = np.searchsorted(codes[order], np.arange(len(values) + 1))
    for value, low, high in zip(values, at, at[1:]):
        yield value, {c: v[low:high] for c, v in whole.items()}


class SessionTable(StatefulProcessor):
    """A key is a bucket of sessions, its state a map with an entry per
    session: counters, settings and whether it is closed.  With a time to live
    for closed sessions, that mark is in a map of its own.  State is asked for
    as rarely as can be, for each question goes to another process, and rows go
    out once per bucket.  ``name`` is a session's id as text behind a ``=``, or
    empty for the null id."""

    def __init__(self, defaults: dict[str, str], buffered, flushing, closed_ttl_ms: int | None):
        self.defaults, self.buffered, self.flushing, self.ttl = defaults, list(buffered), list(flushing), closed_ttl_ms

    def init(self, handle):
        self.heads = handle.getMapState("heads", "name string", "created long, last long, n_frames long, n_config long, pending long, "
                                                                "closed boolean, settings map<string,string>")
        self.closed = handle.getMapState("closed", "name string", "closed boolean", self.ttl) if self.ttl else None

    def handleInputRows(self, key, rows, timerValues):
        out = []
        for name, got in _slices(rows, "name"):
            out += self._session(name, got)
        yield pd.DataFrame({c: [r.get(c) for r in out] for c in self.COLUMNS}, dtype=object)

    def _session(self, name, got) -> list[dict]:
        seq, kind = got["seq"], got["type"]
        session = name[1:] if name else None
        head = self.heads.getValue((name,))
        over = 0                                # frames from here on find no session
        out = []
        if not (self.closed.containsKey((name,)) if self.closed else head is not None and head[5]):
            acks = np.flatnonzero(kind == "ack")
            live = int(acks[0]) if len(acks) else len(kind)
            over = min(live + 1, len(kind))
            if len(acks):
                row = {"n_frames": 0, "n_config": 0, "pending": 0, "closed": True}
                if not self.closed:
                    self.heads.updateValue((name,), (None, None, 0, 0, 0, True, {}))
                else:
                    if head is not None:
                        self.heads.removeKey((name,))
                    self.closed.updateValue((name,), (True,))
            else:
                row = self._count(name, head, seq, kind, got["cfg_key"], got["cfg_value"])
            out.append({"row": "session", "session_id": session, **row})
        message = f"'{session}'"
        return out + [{"row": "error", "session_id": session, "seq": s, "message": message} for s in seq[over:].tolist()]

    def _count(self, name, head, seq, kind, keys, values) -> dict:
        created, _, n_frames, n_config, pending, _, settings = head or (int(seq[0]), None, 0, 0, 0, False, {})
        last, n_frames = int(seq[-1]), n_frames + len(seq)
        config = kind == "config"
        n_config += int(config.sum())
        buffered, flushes = np.isin(kind, self.buffered), np.flatnonzero(np.isin(kind, self.flushing))
        # what was buffered since the last flush, which may be one of these frames
        pending = int(buffered[flushes[-1] + 1:].sum()) if len(flushes) else pending + int(buffered.sum())
        new = {k: v for k, v in zip(keys[config].tolist(), values[config].tolist()) if k is not None and v is not None}
        settings = {**settings, **new}
        self.heads.updateValue((name,), (created, last, n_frames, n_config, pending, False, settings))
        merged = {**self.defaults, **settings}
        return {"created": created, "last_activity": last, "n_frames": n_frames, "n_config": n_config, "pending": pending,
                "config": ";".join(f"{k}={merged[k]}" for k in sorted(merged)), "closed": False}

    COLUMNS = ("row", "session_id", "created", "last_activity", "n_frames", "n_config", "pending", "config", "closed", "seq", "message")

    def close(self):
        pass


class TranscriptBuilder(StatefulProcessor):
    """The open generation's number (a value) and its pieces of text (a
    list that is only appended to, and read once, when the generation closes).
    With event time, a generation without frames for ``idle_ms`` closes as
    ``open`` by a timer, and frames behind the watermark are handed out."""

    def __init__(self, end_types, idle_ms: int | None):
        self.end_types, self.idle_ms = list(end_types), idle_ms

    def init(self, handle):
        self.handle = handle
        self.head = handle.getValueState("head", "gen long, open boolean, timer long")
        self.pieces = handle.getListState("pieces", "data string")

    COLUMNS = ("row", "session_id", "gen", "text", "outcome", "seq", "type", "data", "ms")

    def handleInputRows(self, key, rows, timerValues):
        got = _slice(rows)
        out = []
        if self.idle_ms is not None:
            late = got["ms"] < timerValues.getCurrentWatermarkInMs()
            out = [{"row": "late", **{c: got[c][i] for c in ("seq", "type", "data", "ms")}} for i in np.flatnonzero(late)]
            got = {c: v[~late] for c, v in got.items()}
        kind, data = got["type"], got["data"]
        if len(kind):
            gen, is_open, timer = self.head.get() or (0, False, 0)
            at, held = 0, []        # held: pieces that are not in the state
            for mark in [*np.flatnonzero(np.isin(kind, ["start", *self.end_types])).tolist(), len(kind)]:
                if is_open:
                    held += [d for d, k in zip(data[at:mark], kind[at:mark]) if k == "token" and isinstance(d, str)]
                at = mark + 1
                if mark == len(kind):
                    break
                if is_open:         # a start closes an unfinished generation as it is
                    out.append(self._closed(gen, held, "open" if kind[mark] == "start" else kind[mark]))
                    is_open, held = False, []
                if kind[mark] == "start":
                    gen, is_open = gen + 1, True
            if held:
                self.pieces.appendList([(d,) for d in held])
            if self.idle_ms is not None:
                if timer:
                    self.handle.deleteTimer(timer)
                timer = int(got["ms"].max()) + self.idle_ms if is_open else 0
                if timer:
                    self.handle.registerTimer(timer)
            self.head.update((gen, is_open, timer))
        if out:
            yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        gen, is_open, timer = self.head.get()
        if is_open and timer == expiredTimerInfo.getExpiryTimeInMs():
            yield self._rows(key, [self._closed(gen, [], "open")])
            self.head.update((gen, False, 0))

    def _closed(self, gen, held, outcome) -> dict:
        kept = [x[0] for x in self.pieces.get()]
        if kept:
            self.pieces.clear()
        return {"row": "transcript", "gen": gen, "text": "".join(kept + held), "outcome": outcome}

    def _rows(self, key, rows):
        return pd.DataFrame({c: [key[0] if c == "session_id" else r.get(c) for r in rows] for c in self.COLUMNS}, dtype=object)

    def close(self):
        pass


class LineDedupe(StatefulProcessor):
    """A key is a bucket of line ids, its state the list of those that were
    seen, each forgotten ``delay_ms`` of event time after it was first seen.
    The list is read once and appended to once per micro-batch, for each
    question goes to another process; it is written anew when half of it is
    forgotten, and goes by a timer when all of it is.  Lines behind the
    watermark are handed out.  ``_id`` is a line's id as text."""

    def __init__(self, columns, delay_ms: int):
        self.columns, self.delay_ms = list(columns), delay_ms

    def init(self, handle):
        self.handle = handle
        self.seen = handle.getListState("seen", "id string, until long")
        self.due = handle.getValueState("due", "at long")

    def handleInputRows(self, key, rows, timerValues):
        watermark = timerValues.getCurrentWatermarkInMs()
        n, seen = 0, {}
        for x in self.seen.get():
            n += 1
            if x[1] > watermark:
                seen[x[0]] = x[1]
        first = {}              # the earliest line in time of each id that is not known
        for row in rows:
            if row["_ms"] < watermark:
                yield self._line(row, True)
            elif row["_id"] not in seen and (row["_id"] not in first or row["_ms"] < first[row["_id"]]["_ms"]):
                first[row["_id"]] = row
        new = [(i, row["_ms"] + self.delay_ms) for i, row in first.items()]
        if 2 * len(seen) < n:
            self.seen.clear()
            new = [*seen.items(), *new]
        if new:
            self.seen.appendList(new)
        if first:
            due, at = self.due.get(), max(until for _, until in new)
            if due is None or due[0] < at:
                if due is not None:
                    self.handle.deleteTimer(due[0])
                self.handle.registerTimer(at)
                self.due.update((at,))
        for row in first.values():
            yield self._line(row, False)

    def _line(self, row, late):
        return Row(**{c: row[c] for c in self.columns}, late=late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        due = self.due.get()
        if due is not None and due[0] == expiredTimerInfo.getExpiryTimeInMs():
            self.seen.clear()
            self.due.clear()
        return iter(())

    def close(self):
        pass

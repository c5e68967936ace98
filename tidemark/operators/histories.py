"""Instruments' histories as arrays: what is known when, scores of it, and what each bar trades against.

Rows are dealt by instrument and ordered by time, so a task walks one instrument after the other and holds
little more than one; an instrument has one row a time at most. ``backtest.knowledge_events`` and
``backtest.trades`` state the same on tables, with keys split.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.ordered import array_steps

YEAR = math.sqrt(252)
HISTORY = 127
SPAN, BAR, TWICE = 0, 1, 2
SCORES = ("score", "raw", "momentum")


def walked(df: DataFrame, key: str, order: str, solve, schema) -> DataFrame:
    """``solve`` gets tables of whole keys, ordered, with the first row of each key, and returns a table."""
    def run(batches):
        def firsts(table):
            keys = table[key].combine_chunks()
            other = pc.fill_null(pc.not_equal(keys[1:], keys[:-1]), True).to_numpy(zero_copy_only=False)
            return np.concatenate([[0], np.flatnonzero(other) + 1])

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            first = firsts(table)
            # The last key may go on in the next batch.
            if len(first) > 1:
                yield from solve(table.slice(0, first[-1]), first[:-1]).to_batches()
            held = table.slice(first[-1])
        if held is not None:
            yield from solve(held, firsts(held)).to_batches()

    return df.repartition(key).sortWithinPartitions(key, order).mapInArrow(run, schema)


def instrument_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Spans of scores and, with ``columns``, each bar beside what was known before it and before the bar traded last.

    ``rows``: instrument_id, idx (position of its time), enter (position at which it becomes usable, NULL if
    never), p, known (in time to trade on) and ``columns``. The result has kinds of rows: ``SPAN`` (scores from
    ``enter`` to ``until``), ``BAR``, and ``TWICE`` where an instrument has two rows at one time. Without
    ``columns`` an instrument's only bar row is the one that becomes usable first.
    """
    steps, history, year, wide = array_steps(), HISTORY, YEAR, bool(columns)
    kept = [x for x in columns if x not in ("open", "fx_rate")]
    key_type = rows.schema["instrument_id"].dataType
    longs = ["enter", "until", *(["idx", "first_idx", "prior_before"] if wide else [])]
    doubles = [*SCORES, *([*(f"prior_{s}" for s in SCORES), "ret", *kept] if wide else [])]
    schema = T.StructType(
        [T.StructField("kind", T.IntegerType()), T.StructField("instrument_id", key_type)]
        + [T.StructField(n, T.LongType()) for n in longs]
        + [T.StructField(n, T.BooleanType()) for n in (["known", "tradable"] if wide else [])]
        + [T.StructField(n, T.DoubleType()) for n in doubles]
    )
    order = [(f.name, f.dataType) for f in schema]

    def divided(a, b):
        """Relative change of known numbers; from zero it is an error, as it is in SQL."""
        known = a[1] & b[1]
        if (known & (b[0] == 0)).any():
            raise ZeroDivisionError("a change from zero")
        return np.where(known, a[0] / np.where(known, b[0], 1.0) - 1, 0.0), known

    def framed(price, seg, at):
        """What scores rest on at rows ``at`` of prices in order, whose last 127 rows are of one key."""
        before, same = steps.lag(price, 1), np.concatenate([[False], seg[1:] == seg[:-1]])
        change = divided(price, (before[0], before[1] & same))
        pick = lambda x, n=0: (x[0][at - n], x[1][at - n])
        return pick(price), [pick(price, n) for n in (21, 63, 126)], pick(steps.mean(price, 50)), pick(steps.sd(change, 63))

    def scored(parts):
        newest, (b21, b63, b126), mean, sd = parts
        m21, m63, m126, trend = (divided(newest, b) for b in (b21, b63, b126, mean))
        vol = sd[0] * year
        score = 0.20 * m21[0] + 0.30 * m63[0] + 0.35 * m126[0] + 0.15 * trend[0] - 0.03 * vol
        known = m21[1] & m63[1] & m126[1] & trend[1] & sd[1]
        raw = 1 / np.maximum(np.where(sd[1], vol, 0.0), 0.02)
        return {"score": (score, known), "raw": (raw, np.ones(len(raw), bool)), "momentum": m63}

    def events(seg, enter, price, keys):
        """(key, enter, scores) after each change of what is known of a key, once 127 facts are."""
        count = len(seg)
        begin = np.searchsorted(seg, np.arange(keys))
        ordinal = np.arange(count) - begin[seg] + 1
        by_enter = np.lexsort((ordinal, enter, seg))
        when, big = enter[by_enter], count + 1
        # Facts sorted by key stay so; the ordinal of a place is the number usable then.
        newest = np.maximum.accumulate(seg * big + ordinal[by_enter]) - seg * big
        last = np.concatenate([(seg[1:] != seg[:-1]) | (when[1:] != when[:-1]), [True]]) if count else np.zeros(0, bool)
        at = np.flatnonzero(last & (ordinal >= history))
        newest_at = begin[seg[at]] + newest[at] - 1
        gap = newest[at] - ordinal[at]
        plain, holes = np.flatnonzero(gap == 0), np.flatnonzero(gap > 0)
        out = {n: (np.zeros(len(at)), np.zeros(len(at), bool)) for n in ("score", "raw", "momentum")}

        def place(where, found):
            for n, (values, known) in found.items():
                out[n][0][where], out[n][1][where] = values, known

        if len(plain):
            place(plain, scored(framed(price, seg, newest_at[plain])))
        for some in np.array_split(holes, len(holes) // 512 + 1) if len(holes) else ():
            # Not a prefix of the history: the last 127 of those usable, one after the other.
            rows = np.empty((len(some), history), np.int64)
            for k, e in enumerate(some):
                low = max(begin[seg[at[e]]], newest_at[e] - (history - 1) - gap[e])
                usable = np.flatnonzero(enter[low:newest_at[e] + 1] <= when[at[e]])
                rows[k] = low + usable[-history:]
            flat = rows.ravel()
            place(some, scored(framed(
                (price[0][flat], price[1][flat]), np.repeat(np.arange(len(some)), history),
                np.arange(1, len(some) + 1) * history - 1)))
        return seg[at], when[at], out

    def taken(cells, at):
        """Values at places, unknown where there is none (-1)."""
        if not len(cells[0]):
            return np.zeros(len(at)), np.zeros(len(at), bool)
        return cells[0][at], cells[1][at] & (at >= 0)

    def returns(cells, open_before, fx_before):
        """Return from the last open to this one; without either it is nothing."""
        either = lambda a, b: (np.where(a[1], a[0], b[0]), a[1] | b[1])
        opened, fx = either(cells["open"], open_before), either(cells["fx_rate"], fx_before)
        split, dividend = (np.where(cells[x][1], cells[x][0], y) for x, y in (("split_factor", 1.0), ("dividend", 0.0)))
        worth = (opened[0] * split + dividend) * fx[0]
        return divided((worth, opened[1] & fx[1]), (open_before[0] * fx_before[0], open_before[1] & fx_before[1]))[0]

    def solve(table, first):
        count, keys = table.num_rows, len(first)
        seg = np.repeat(np.arange(keys), np.diff(np.append(first, count)))
        ints = lambda n: table[n].fill_null(0).to_numpy()
        reals = lambda n: (table[n].fill_null(0.0).to_numpy(), table[n].is_valid().to_numpy())
        idx, enter, usable = ints("idx"), ints("enter"), table["enter"].is_valid().to_numpy()
        facts = np.flatnonzero(usable)
        price = reals("p")
        with np.errstate(all="ignore"):
            key, since, found = events(seg[facts], enter[facts], (price[0][facts], price[1][facts]), keys)
        names = table["instrument_id"].combine_chunks()
        parts = []

        def add(kind, at, ints=None, flags=None, values=None):
            data = {"kind": (np.full(len(at), kind, np.int32), None), "instrument_id": names.take(pa.array(at))}
            data |= (ints or {}) | (flags or {}) | (values or {})
            arrays = []
            for name, of in order:
                cell, to = data.get(name), key_arrow if name == "instrument_id" else arrow[type(of)]
                if cell is None:
                    arrays.append(pa.nulls(len(at), to))
                elif isinstance(cell, tuple):
                    arrays.append(pa.array(cell[0], to, mask=None if cell[1] is None else ~cell[1]))
                else:
                    arrays.append(cell)
            parts.append(pa.Table.from_arrays(arrays, names=[n for n, _ in order]))

        key_arrow = names.type
        arrow = {T.IntegerType: pa.int32(), T.LongType: pa.int64(), T.BooleanType: pa.bool_(), T.DoubleType: pa.float64()}
        more = np.concatenate([key[1:] == key[:-1], [False]]) if len(key) else np.zeros(0, bool)
        until = np.concatenate([since[1:] - 1, [0]]) if len(key) else since
        add(SPAN, first[key], {"enter": (since, None), "until": (until, more)}, None, found)
        twice = np.flatnonzero((seg[1:] == seg[:-1]) & (idx[1:] == idx[:-1]))
        if len(twice):
            add(TWICE, twice)
        earliest, some = np.full(keys, np.iinfo(np.int64).max), np.zeros(keys, bool)
        np.minimum.at(earliest, seg[facts], enter[facts])
        some[seg[facts]] = True
        if not wide:
            add(BAR, first[some], {"enter": (earliest[some], None)})
            return pa.concat_tables(parts)
        known = table["known"].fill_null(False).to_numpy()
        cells = {c: (v, k & known) for c in columns for v, k in [reals(c)]}
        trades = cells["open"][1] & cells["fx_rate"][1]
        places = np.arange(count)

        def earlier(which):
            """Place of the last such row before, of the same key, else -1."""
            at = np.concatenate([[-1], np.maximum.accumulate(np.where(which, places, -1))[:-1]])
            return np.where(at >= first[seg], at, -1)

        big = max(int(idx.max()), int(enter.max())) + 2
        hit = np.searchsorted(key * big + since, seg * big + idx - 1, "right") - 1
        if len(key):
            hit = np.where((hit >= 0) & (key[hit] == seg), hit, -1)
        now = {s: taken(found[s], hit) for s in found}
        prior = earlier(trades)
        add(
            BAR, places,
            {"idx": (idx, None), "enter": (enter, usable), "first_idx": (earliest[seg], some[seg]),
             "prior_before": (idx[prior] - 1, prior >= 0)},
            {"known": (known, None), "tradable": (trades, None)},
            now | {f"prior_{s}": taken(x, prior) for s, x in now.items()}
            | {"ret": (returns(cells, *(taken(cells[x], earlier(cells[x][1])) for x in ("open", "fx_rate"))), None)}
            | {x: cells[x] for x in kept},
        )
        return pa.concat_tables(parts)

    return walked(rows, "instrument_id", "idx", solve, schema)


def growth_changes(moves: DataFrame) -> DataFrame:
    """(idx, d): by how much the wealth of all instruments together changes at a step, each starting from 1.

    ``moves``: instrument_id, idx, ret (return of the step before), charge (at the step itself), and the steps
    ``since`` and ``final`` between which they count. Sums of a part of the instruments; more than one row a step.
    """
    def solve(table, first):
        number = lambda n: table[n].to_numpy()
        count, idx = table.num_rows, number("idx")
        seg = np.repeat(np.arange(len(first)), np.diff(np.append(first, count)))
        at, seg2 = np.concatenate([idx - 1, idx]), np.concatenate([seg, seg])
        r = np.concatenate([number("ret"), -number("charge")])
        inside = (at >= number("since")[0]) & (at <= number("final")[0])
        at, seg2, r = at[inside], seg2[inside], r[inside]
        order = np.lexsort((at, seg2))
        at, seg2, r = at[order], seg2[order], r[order]
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (seg2[1:] != seg2[:-1])])) if len(at) else at
        at, seg2, r = at[new], seg2[new], np.add.reduceat(r, new) if len(new) else r
        d = np.empty(len(r))
        bounds = np.append(np.flatnonzero(np.concatenate([[True], seg2[1:] != seg2[:-1]])), len(r)) if len(r) else []
        for a, b in zip(bounds[:-1], bounds[1:]):
            after = np.cumprod(1 + r[a:b])
            d[a:b] = after - np.concatenate([[1.0], after[:-1]])
        steps, which = np.unique(at, return_inverse=True)
        return pa.table({"idx": pa.array(steps, pa.int64()), "d": pa.array(np.bincount(which, d, len(steps)), pa.float64())})

    return walked(moves, "instrument_id", "idx", solve, "idx bigint, d double")

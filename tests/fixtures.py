"""Hand-made ride rows for edge cases, and a brute-force cleaning reference."""

from __future__ import annotations

import datetime as dt

from cadence.schema import RIDES

T0 = dt.datetime(2024, 3, 4, 8, 0, 0)  # a Monday


def ride(rid, start, length_s, s_id, s_name, e_id, e_name, member="member", kind="classic_bike", end_missing=False, lat=41.9, lng=-87.6):
    started = T0 + dt.timedelta(seconds=start)
    ended = started + dt.timedelta(seconds=length_s)
    return (
        rid,
        kind,
        started,
        ended,
        s_name,
        s_id,
        e_name,
        e_id,
        lat,
        lng,
        None if end_missing else lat + 0.01,
        None if end_missing else lng + 0.02,
        member,
    )


def edge_rides():
    return [
        # A: earliest ride ending at A has a null end name, later ones named
        ride("r01", 0, 300, "A", "Alpha", "A", None),
        ride("r02", 10, 300, "B", "Beta", "A", "Alpha"),
        ride("r03", 20, 300, "A", "Alpha", "A", "Alpha"),
        # B: two names, earliest wins
        ride("r04", 5, 300, "A", "Alpha", "B", "Beta"),
        ride("r05", 50, 300, "C", "Gamma", "B", "Beta Two"),
        ride("r06", 60, 300, "C", None, "B", None),
        # C: two routes start at the same instant with different names;
        # the smaller ride id decides
        ride("r08", 1, 300, "C", "Gamma Temp", "A", "Alpha"),
        ride("r07", 1, 300, "C", "Gamma", "B", "Beta"),
        # null start id and null end id: null matches null
        ride("r09", 30, 300, None, "Nowhere", None, None),
        ride("r10", 31, 300, "A", "Alpha", None, "Nobody"),
        # end id never a start id: its missing name stays null -> dropped
        ride("r11", 40, 300, "A", "Alpha", "Z", None),
        ride("r12", 41, 300, "A", "Alpha", "Z", "Zed"),
        # start id D only on rides whose end id is never a start id
        ride("r13", 42, 300, "D", None, "Z", "Zed"),
        # start name null, all else present -> survives cleaning
        ride("r14", 43, 300, "E", None, "A", "Alpha"),
        # lengths -5, 0, 10, 10.5, 59.9, 60
        ride("r15", 100, -5, "A", "Alpha", "B", "Beta"),
        ride("r16", 101, 0, "A", "Alpha", "B", "Beta"),
        ride("r17", 102, 10, "A", "Alpha", "B", "Beta"),
        ride("r18", 103, 10.5, "A", "Alpha", "B", "Beta", member="casual"),
        ride("r19", 104, 59.9, "A", "Alpha", "B", "Beta"),
        ride("r20", 105, 60, "A", "Alpha", "B", "Beta", member="casual"),
        # missing end coordinates -> dropped
        ride("r21", 106, 300, "A", "Alpha", "B", "Beta", end_missing=True),
    ]


def edge_frame(spark, rows=None):
    return spark.createDataFrame(rows if rows is not None else edge_rides(), RIDES)


# ---------------------------------------------------------------- brute force

I_RID, I_START, I_SNAME, I_SID, I_ENAME, I_EID = 0, 2, 4, 5, 6, 7


def brute_lookups(rows):
    starts = {r[I_SID] for r in rows}
    matched = [r for r in rows if r[I_EID] in starts]  # None in set matches None
    order = sorted(matched, key=lambda r: (r[I_START] is None, r[I_START] or T0, r[I_RID]))
    end_lk, start_lk = {}, {}
    for r in order:
        end_lk.setdefault(r[I_EID], r[I_ENAME])
        start_lk.setdefault(r[I_SID], r[I_SNAME])
    return end_lk, start_lk


def brute_clean(rows, fill_start=True, min_seconds=10):
    end_lk, start_lk = brute_lookups(rows)
    out = []
    for r in rows:
        r = list(r)
        if r[I_ENAME] is None:
            r[I_ENAME] = end_lk.get(r[I_EID])
        if fill_start and r[I_SNAME] is None:
            r[I_SNAME] = start_lk.get(r[I_SID])
        if any(r[i] is None for i in (6, 7, 10, 11, 5, 8, 9)):
            continue
        if r[2] is None or r[3] is None:
            continue
        length = (r[3] - r[2]).total_seconds()
        if length > 0 and length > min_seconds:
            out.append(tuple(r))
    return out

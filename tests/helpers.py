"""Row-at-a-time reference folds used to check the set-based operators."""

import datetime as dt

BASE = dt.datetime(2026, 7, 6, 15, 0, 0)


def at(seconds: float) -> dt.datetime:
    return BASE + dt.timedelta(seconds=seconds)


def book_fold(events):
    """Yield (time, bids, asks) after each instant; subs are forgiving."""
    bids, asks, snap, out = {}, {}, False, []
    for i, (t, kind, buy, px, sx) in enumerate(events):
        if kind == "SNAPSHOT":
            if not snap:
                bids.clear(), asks.clear()
            snap = True
        else:
            snap = False
        side = bids if buy else asks
        if kind in ("SNAPSHOT", "SET"):
            q = sx
        elif kind == "ADD":
            q = side.get(px, 0.0) + sx
        elif kind == "SUB":
            q = max(0.0, side.get(px, 0.0) - sx)
        else:
            q = 0.0
        if q > 0:
            side[px] = q
        else:
            side.pop(px, None)
        if i + 1 == len(events) or events[i + 1][0] != t:
            out.append((t, dict(bids), dict(asks)))
    return out


def order_fold(events):
    """Order-level fold: (time, kind, id, buy, px, sx, live) to aggregate depth."""
    orders, snap, out = {}, False, []
    for i, (t, kind, oid, buy, px, sx, live) in enumerate(events):
        if kind == "SNAPSHOT":
            if not snap:
                orders.clear()
            snap = True
            if live and sx > 0:
                orders[oid] = (buy, px, sx)
        else:
            snap = False
            if kind == "SET":
                orders.pop(oid, None)
                if live and sx > 0:
                    orders[oid] = (buy, px, sx)
            elif kind == "ADD":
                if not live:
                    orders.pop(oid, None)
                elif oid in orders:
                    b, p, q = orders[oid]
                    orders[oid] = (b, p, q + sx)
                else:
                    orders[oid] = (buy, px, sx)
            elif kind == "SUB" and oid in orders:
                b, p, q = orders[oid]
                orders.pop(oid)
                if q - sx > 0:
                    orders[oid] = (b, p, q - sx)
            elif kind == "DELETE":
                orders.pop(oid, None)
        if i + 1 == len(events) or events[i + 1][0] != t:
            depth = {True: {}, False: {}}
            for b, p, q in orders.values():
                depth[b][p] = depth[b].get(p, 0.0) + q
            out.append((t, depth[True], depth[False]))
    return out


def canon_rows(columns, rows):
    """Rows as sorted dictionaries; doubles to six decimals, a NaN stays one."""
    own = [{c: round(v, 6) + 0.0 if isinstance(v, float) else v for c, v in zip(columns, r, strict=True)} for r in rows]
    return sorted(own, key=lambda r: repr(sorted(r.items())))

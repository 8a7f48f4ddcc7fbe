"""Plain forms that the operators' results are held against."""

import calendar
import datetime as dt


def time_parts(rows, limit):
    """Files {(leaf, part): rows in order} of rows (moment, ...), each level and run by hand."""

    def span(level, at):
        y, m, d, h = (*at, 0, 0, 0)[:4]
        if level == 0:
            return dt.datetime(y, 1, 1), dt.datetime(y + 1, 1, 1)
        if level == 1:
            return dt.datetime(y, m, 1), dt.datetime(y + m // 12, m % 12 + 1, 1)
        start = dt.datetime(y, m, d, h if level == 3 else 0)
        return start, start + (dt.timedelta(days=1) if level == 2 else dt.timedelta(hours=1))

    leaves = {}

    def divide(level, parents, members, held):
        run, got = [], []

        def close():
            nonlocal run, got
            if got:
                text = [("%04d" if level == 0 else "%02d") % run[i] for i in (0, -1)]
                leaves["/".join([*("%04d" % p if i == 0 else "%02d" % p for i, p in enumerate(parents)), "-".join(text)])] = got
            run, got = [], []

        for m in members:
            a, b = span(level, (*parents, m))
            own = [r for r in held if a <= r[0] < b]
            if len(own) > limit and level < 3:
                close()
                y = (*parents, m)
                below = range(1, 13) if level == 0 else range(1, calendar.monthrange(*y)[1] + 1) if level == 1 else range(24)
                divide(level + 1, y, below, own)
            elif run and len(got) + len(own) <= limit:
                run, got = [*run, m], got + own
            else:
                close()
                run, got = [m], own
        close()

    dated = [r for r in rows if r[0] is not None]
    if dated:
        years = [r[0].year for r in dated]
        divide(0, (), range(min(years), max(years) + 1), dated)
    if len(dated) < len(rows):
        leaves["null"] = [r for r in rows if r[0] is None]
    key = lambda r: tuple((v is not None, v) if v is not None else (False,) for v in r)
    out = {}
    for leaf, own in leaves.items():
        own = sorted(own, key=key)
        for p in range(0, len(own), limit):
            out[leaf, p // limit + 1] = own[p : p + limit]
    return out

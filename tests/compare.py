"""Order-free comparison of a Spark result with a SQL result."""

import datetime
import decimal


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return float(f"{float(v):.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, int) and not isinstance(v, bool):
        return float(v) if abs(v) < 2**53 else v
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def ordered(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


def same(df, con, sql):
    names = sorted(df.columns)
    result = con.execute(sql)
    have = [c[0] for c in result.description]
    assert sorted(have) == names
    at = [have.index(c) for c in names]
    assert ordered(df.select(*names).collect()) == ordered([r[i] for i in at] for r in result.fetchall())

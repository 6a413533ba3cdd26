"""Comparison of a query's rows with those of its SQL."""


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 9))
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str)


def rows_of_sql(duck, sql):
    rel = duck.sql(sql)
    names = sorted(rel.columns)
    at = [rel.columns.index(c) for c in names]
    return names, sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=str)

"""Row-by-row comparison of a Spark query and its SQL twin."""


def _value(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_value(r[i]) for i in order) for r in rows)


def same(df, con, sql):
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    ours, theirs = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(names, cursor.fetchall())
    assert len(ours) == len(theirs)
    assert ours == theirs

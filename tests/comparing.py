"""Rows of a query and of its SQL twin as comparable text."""


def plain(value) -> str:
    if isinstance(value, float):
        return repr(round(value, 9) + 0.0)
    if isinstance(value, list | tuple):
        return "[" + ",".join(map(plain, value)) + "]"
    return "NULL" if value is None else str(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = [columns.index(c) for c in sorted(columns)]
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def assert_same(spark, small, duck, function, sql: str) -> None:
    df = function(spark, small)
    got = rows_of(df.columns, df.collect())
    cursor = duck.execute(sql)
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows_of(names, cursor.fetchall())

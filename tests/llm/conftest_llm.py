"""Helpers that test modules import by name."""


def same_rows(df, want):
    names, rows = want
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(repr, map(tuple, df.select(names).collect()))) == sorted(map(repr, rows))

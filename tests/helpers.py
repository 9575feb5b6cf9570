"""Helpers of the tests (a name of its own: every folder of tests has a conftest)."""


def rows(df, *cols):
    """Rows as sorted tuples, nulls first."""
    df = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in df.collect()), key=lambda t: [(x is not None, x) for x in t])

import datetime


def at(text):
    """A timestamp of 2023-01-01, from ``HH:MM[:SS]``."""
    return datetime.datetime.fromisoformat(f"2023-01-01T{text}")


def rows(df, *columns):
    """The rows as sorted tuples of the given columns."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda r: [str(v) for v in r])

def rows(df, *columns):
    """Sorted plain tuples of a small result."""
    if columns:
        df = df.select(*columns)
    return sorted((tuple(r) for r in df.collect()), key=repr)

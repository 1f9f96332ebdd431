"""What several tests use."""


def rows(df):
    """Rows as tuples, in order."""
    return sorted((tuple(r) for r in df.collect()), key=repr)

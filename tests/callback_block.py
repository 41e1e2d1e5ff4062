def callback_rows(table, block):
    """Two blocks of one column and one row each."""
    one = {"cols": (block, block, 1.0 + block, 0.0, None), "rows": ("EQ", block, block, 2.0, 2.0), "nnz": ("EQ", block, block, 4.0, block, block)}
    yield one[table]

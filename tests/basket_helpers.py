"""Small baskets for the tests, and rows as dictionaries."""


def make_baskets(spark, baskets, item_type="long"):
    """Baskets from Python lists; ids 0..n-1; items distinct + sorted."""
    rows = [(i, sorted(set(b))) for i, b in enumerate(baskets)]
    return spark.createDataFrame(rows, f"basket_id long, items array<{item_type}>")


def as_dict(df, key="items", val="support"):
    return {tuple(r[key]): r[val] for r in df.collect()}


def digits(s):
    """'124' -> (1, 2, 4)."""
    return tuple(int(c) for c in s)

"""Hand-made source rows for cases the generated fixtures cannot reach.

The same rows are given to Spark (as DataFrames) and to DuckDB (as Arrow
tables named like the sources), so the oracle texts run on them unchanged.
"""

from __future__ import annotations

from datetime import date

import pyarrow as pa

from adlift.sources.registry import Sources

AFTER = date(1999, 8, 1)
BEFORE = date(1999, 3, 1)
HIST = date(1998, 8, 1)
LAUNCH = date(1999, 7, 1)
END = date(1999, 12, 31)

FACT_COLS = [
    ("event_local_dt", "date", pa.date32()),
    ("site", "string", pa.string()),
    ("advertiser_id", "bigint", pa.int64()),
    ("advertiser_name", "string", pa.string()),
    ("vertical", "string", pa.string()),
    ("campaign_id", "bigint", pa.int64()),
    ("line_item_id", "bigint", pa.int64()),
    ("campaign_type", "string", pa.string()),
    ("product_type", "string", pa.string()),
    ("line_item_type", "string", pa.string()),
    ("campaign_target", "string", pa.string()),
    ("page_name", "string", pa.string()),
    ("cost_usd", "double", pa.float64()),
    ("prints_qty", "bigint", pa.int64()),
    ("clicks_qty", "bigint", pa.int64()),
]


def r(d, site, adv, li, cost, target="REACH", page="adx-display", name=None, vertical="HOME", camp=None,
      ctype="PROGRAMMATIC", ptype="DSP_SELFSERVICE", ltype="Display", prints=100, clicks=1):
    name = name if name is not None else (f"A{adv}" if adv is not None else None)
    camp = camp if camp is not None else (li or 0) * 10
    return (d, site, adv, name, vertical, camp, li, ctype, ptype, ltype, target, page, cost, prints, clicks)


FACT = [
    # adopter 1 at MLA (endemic): off-site-only item 100, other item 101
    r(AFTER, "MLA", 1, 100, 150.0),
    r(AFTER, "MLA", 1, 100, 50.0, page="home"),
    r(AFTER, "MLA", 1, 101, -10.0, page="home"),  # negative cost counts in the sums
    r(AFTER, "MLA", 1, 101, 0.0, page="home"),
    r(AFTER, "MLA", 1, 100, 5.0, target="reach"),  # lower case: adopters upper-case it
    r(AFTER, "MLA", 1, 100, 1000.0, ltype=None),  # NULL type: out of the display scope
    r(BEFORE, "MLA", 1, 101, 80.0, page="home"),
    r(BEFORE, "MLA", 1, 100, 20.0),
    r(HIST, "MLA", 1, 101, 30.0),
    r(AFTER, "MLA", 1, 100, 9.0, prints=0, name="A1 renamed"),
    # same advertiser at another site, not adopting there
    r(AFTER, "MLB", 1, 101, 40.0, page="home"),
    # advertiser 2: item 102 is 'off ' (not OFF without trimming); item 110 off-only but not programmatic
    r(AFTER, "MLA", 2, 102, 200.0, vertical=None),
    r(AFTER, "MLA", 2, 110, 120.0, vertical=None, ctype="GUARANTEED"),
    # advertiser 3: item 103 is both OFF and MELI in the dimension
    r(AFTER, "MLA", 3, 103, 300.0, target="CPC", page="home", vertical="\tVIS_MOTORS\n"),
    r(BEFORE, "MLA", 3, 103, 100.0, target="CPC", vertical="\tVIS_MOTORS\n"),
    r(AFTER, "MLA", 3, 103, 500.0, target="CPC", ltype="video", vertical="\tVIS_MOTORS\n"),
    r(AFTER, "MLA", 3, 105, 25.0, page=None, vertical="\tVIS_MOTORS\n"),
    # thresholds of the first-timer cohort
    r(AFTER, "MLB", 4, 108, 99.99, target="CPA", vertical="unknown"),
    r(AFTER, "MLB", 5, 109, 100.0, target="ROAS", vertical="VISION"),
    r(AFTER, "MLC", 6, 100, 100.01, target="CPL", vertical="VIS_X"),
    r(HIST, "MLC", 6, 101, 10.0, page="home", vertical="VIS_X"),
    # NULL keys
    r(AFTER, "MLA", None, 100, 200.0),
    r(AFTER, None, 7, 100, 150.0),
    r(BEFORE, "MLA", None, 100, 60.0),
    # unknown inventories, missing line item, NULL line item
    r(AFTER, "MLB", 5, 104, 10.0, vertical="VISION"),
    r(AFTER, "MLB", 5, 106, 10.0, vertical="VISION"),
    r(AFTER, "MLB", 5, 107, 10.0, vertical="VISION"),
    r(AFTER, "MLB", 5, 111, 10.0, vertical="VISION"),
    r(AFTER, "MLB", 5, None, 7.0, vertical="VISION"),
    # outside every window
    r(date(2001, 1, 1), "MLA", 1, 100, 999.0),
]

LINE_ITEM = [(100, "OFF"), (101, "MELI"), (102, "off "), (103, "OFF"), (103, "MELI"), (104, None), (105, "MELI_OFF"),
             (106, " in "), (107, "X"), (108, "OFF"), (109, "off"), (110, "OFF"), (None, "OFF")]
MASTER = [(i,) for i in range(100, 112) if i != 108]
REL = [(100, 1), (100, 2), (108, 1), (103, 3), (109, 4), (109, 4)]
HISTORY = [(1, 10), (1, 11), (2, 20), (3, 10), (4, 30)]
DESTINATION = [(10, "click_off"), (11, "CLICK_IN"), (20, "CLICK_IN"), (30, "CLICK_OFF_SAFE"), (30, "CLICK_IN")]
ADVERTISER = [(1, "A1"), (1, "A1 again"), (2, "A2"), (3, "A3"), (4, "A4"), (5, "A5"), (6, "A6")]
HIT = '"[{\\"type\\":\\"iab_picture\\"}]"'
CREATIVE = [
    (1, 1, HIT),
    (2, 710, HIT),  # excluded advertiser
    (3, None, HIT),  # NULL advertiser: excluded by NOT IN
    (4, 4, '[{"type":"iab_picture"}]'),  # plain array
    (5, 5, '"[]"'),
    (6, 6, '"[5,{\\"type\\":1},{\\"type\\":\\"iab_picture\\"}]"'),
    (7, 7, '"[{\\"type\\":[\\"iab_picture\\"]}]"'),
    (8, 8, None),
    (9, 9, '"[{\\"kind\\":\\"iab_picture\\"}]"'),
]
LI_CREATIVE = [("100", 1), ("101", 2), ("102", 3), ("103", 4), ("104", 6), ("105", 7), ("106", 8), ("107", 9),
               ("105", 5), ("109", 6)]

TABLES = {
    "daily_metrics": (FACT, FACT_COLS),
    "line_item": (LINE_ITEM, [("line_item_id", "bigint", pa.int64()), ("inventory", "string", pa.string())]),
    "line_item_master": (MASTER, [("line_item_id", "bigint", pa.int64())]),
    "line_item_creative_rel": (REL, [("line_item_id", "bigint", pa.int64()), ("creative_id", "bigint", pa.int64())]),
    "creative_history": (
        HISTORY, [("creative_id", "bigint", pa.int64()), ("creative_destination_id", "bigint", pa.int64())]
    ),
    "destination": (DESTINATION, [("destination_id", "bigint", pa.int64()), ("destination_subtype", "string", pa.string())]),
    "advertiser": (ADVERTISER, [("advertiser_id", "bigint", pa.int64()), ("advertiser_name", "string", pa.string())]),
    "creative": (
        CREATIVE,
        [("creative_id", "bigint", pa.int64()), ("advertiser_id", "bigint", pa.int64()), ("images", "string", pa.string())],
    ),
    "line_item_creative": (LI_CREATIVE, [("line_item_id", "string", pa.string()), ("creative_id", "bigint", pa.int64())]),
}


def spark_sources(spark, partitions: int | None = None) -> Sources:
    frames = {}
    for name, (rows, cols) in TABLES.items():
        df = spark.createDataFrame(rows, ", ".join(f"{c} {t}" for c, t, _ in cols))
        if partitions:
            df = df.repartition(partitions)
        frames[name] = df
    return Sources.from_frames(frames)


def duck_connection():
    import duckdb

    con = duckdb.connect()
    for name, (rows, cols) in TABLES.items():
        schema = pa.schema([(c, a) for c, _, a in cols])
        table = pa.Table.from_pylist([dict(zip([c for c, _, _ in cols], row)) for row in rows], schema=schema)
        con.register(f"{name}_arrow", table)
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM {name}_arrow")
    return con

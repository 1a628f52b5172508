"""Small rasters for the tests."""

import numpy as np


def pixels(spark, *bands, null=None):
    """A raster of lists of rows; cells equal to ``null`` are NULL."""
    rows = []
    for r in range(len(bands[0])):
        for c in range(len(bands[0][0])):
            rows.append((r, c, *(None if b[r][c] == null else int(b[r][c]) for b in bands)))
    schema = "row int, col int, " + ", ".join(f"b{i} bigint" for i in range(1, len(bands) + 1))
    return spark.createDataFrame(rows, schema)


def segments(spark, grid):
    rows = [(r, c, int(v)) for r, line in enumerate(grid) for c, v in enumerate(line)]
    return spark.createDataFrame(rows, "row int, col int, seg_id bigint")


def array(df, value="seg_id"):
    rows = df.collect()
    out = np.zeros((max(r["row"] for r in rows) + 1, max(r["col"] for r in rows) + 1), np.int64)
    for r in rows:
        out[r["row"], r["col"]] = r[value]
    return out

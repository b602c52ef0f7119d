from pyspark.sql import functions as F

from listsieve import schema as sc


def values(df, *columns):
    """Rows as tuples, or plain values for a single column."""
    rows = df.select(*columns).collect()
    return [r[0] if len(columns) == 1 else tuple(r) for r in rows]


def one(spark, column, **inputs):
    """A column evaluated on a single row of named string inputs."""
    shape = ", ".join(f"{k} string" for k in inputs) or "x int"
    return spark.createDataFrame([tuple(inputs.values()) or (1,)], shape).select(column).first()[0]


def ads(spark, *rows, **defaults):
    """Ads from dicts, in arrival order."""
    names = [f.name for f in sc.CONTENT_FIELDS]
    full = []
    for i, row in enumerate(rows):
        row = {**defaults, **row}
        base = [row.get(n, [] if n == "tags" else None if n == "posted_at" else "") for n in names]
        full.append((*base, row.get("hidden", False), row.get("score", 0), i))
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sc.CONTENT_FIELDS)
    return spark.createDataFrame(full, f"{shape}, hidden boolean, score int, seq long")


def raw(spark, *bodies, url="https://board.test/jobs/go/"):
    return spark.createDataFrame(
        [(f"{url}", body, i) for i, body in enumerate(bodies)], sc.RAW
    )


def empty_state(spark):
    return spark.createDataFrame([], sc.STATE)


def at(text):
    return F.lit(text).cast("timestamp")

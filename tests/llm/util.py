"""Fixtures of the training-data tests."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

WORDS = ("the of and river stone amber lantern quiet copper meadow winter signal harbour velvet orchard thunder maple "
         "cinder ribbon granite whisper saffron anchor pebble glacier candle thicket marble falcon ember").split()


def prose(seed: int, n: int) -> str:
    """n words of a fixed pseudorandom text, a line every 12 words."""
    out, x = [], seed * 7919 + 13
    for k in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[(x >> 8) % len(WORDS)] + str((x >> 5) % 97 if x % 5 == 0 else "") + ("\n" if k % 12 == 11 else " "))
    return "".join(out)


def documents(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, source), with extra columns of clashing names."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", len(r[1]) if r[1] is not None else None) for r in rows]
    df = spark.createDataFrame(full, SCHEMA).repartition(3)
    for name in ("id", "n", "rank", "key", "size", "rep", "block", "_row", "kept", "words", "start", "component"):
        df = df.withColumn(name, F.lit("own"))
    return df


EDGE = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (4, "one"), (None, "no id here at all"), (5, "x" * 30_000), (6, "a b c d " * 4000)]


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def cells(df, *columns):
    return sorted((tuple(r[c] for c in (columns or df.columns)) for r in df.collect()), key=repr)

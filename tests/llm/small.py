"""Documents with every odd case: nulls in any column, empty and very long texts, ties, repeated rows, clashing columns."""

LONG = "long words run on " * 20_000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today", "en", "src0"),
    (2, "the QUICK brown fox jumps over the lazy dog near the old river bank today", "en", "src1"),
    (3, "the quick brown fox jumps over the lazy dog near the old river bank", "en", "src10"),
    (4, "", "de", "src2"),
    (5, None, None, None),
    (6, " \t\n ", "fr", "x"),
    (7, LONG, "en", "src0"),
    (8, "ä ß 漢字 🙂 ▁ two", "es", "src99999999999"),
    (8, "ä ß 漢字 🙂 ▁ two", "es", "src99999999999"),
    (9, "two words", "en", "src1"),
    (None, "two words", "en", "src1"),
    (10, "x\x00y\x0bz\x1cw", "en", "src2"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string"
CLASH = ("fingerprint", "component_id", "ids", "decoded", "media", "payload", "units", "_text", "_row", "_id", "_key", "_h", "_cut", "_lang", "full_epochs", "tokens", "domain", "toxicity", "score", "held_out", "shard", "batch", "key", "label", "n")


def documents(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA)


def clashing(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("kept") for c in CLASH})


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)

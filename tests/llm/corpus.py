"""Small tables with every awkward case, for the corpus operators."""

from pyspark.sql import functions as F

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns that carry names which operators use inside.
CLASHES = (
    "size block key tie start taken shards target passes rest drawn words n_words kept base spans numbers addresses fp node root a b t k "
    "component_id mark places names label score predicted held_out lang_pred _id _rank _words _kept _turn rank of at"
).split()


def prose(words: int, seed: int = 0) -> str:
    vocabulary = "the of and to in stone river cloud green walk table night house paper light with that was for morning".split()
    return " ".join(vocabulary[(i * 7 + seed * 13 + (i * i) % 11) % len(vocabulary)] for i in range(words))


def rows():
    long = " ".join(f"word{i}" for i in range(30_000))
    texts = [
        (1, prose(60), "en", "a"),
        (2, prose(60), "en", "a"),  # an exact copy
        (3, None, "en", "a"),
        (4, "", None, None),
        (5, " \t\n\x0b\f\r ", "de", "b"),
        (6, long, "en", None),
        (7, "Größe ñandú İstanbul 日本語 😀 \x00   x", "xx", "ü"),
        (8, "one", "fr", ""),
        (8, "one", "fr", ""),  # a repeated row
        (9, "two words", None, "b"),
        (None, "no id here, none at all", "en", "a"),
        (None, None, None, None),
        (-5, "a line\na line\nanother\na line\n\n\n", "en", "c"),
        (10, prose(14, 3), "en", "a"),
        (10, prose(14, 4), "en", "a"),  # an id with two texts
        (2**62, "mail me at x.y@example.org or +44 20 7946 0958 now", "en", "b"),
    ]
    return [(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in texts]


def edge_docs(spark, clashes: bool = True, partitions: int = 3):
    docs = spark.createDataFrame(rows(), DOCS).repartition(partitions, F.col("doc_id"))
    return docs.select("*", *(F.lit("clash").alias(c) for c in CLASHES)) if clashes else docs


def labels(spark):
    values = [(1, 1, 0), (2, 1, 0), (3, 0, 1), (7, 0, 1), (10, 1, 1), (10, 0, 0), (9, None, None), (None, 1, 1), (6, 1, 0)]
    return spark.createDataFrame(values, "doc_id bigint, quality int, toxic int")


def benchmark(spark):
    items = [(1, prose(20)), (2, None), (3, ""), (4, "one"), (5, prose(14, 3)), (5, "two words"), (None, "another"), (6, "Größe ÑANDÚ")]
    return spark.createDataFrame(items, "item_id bigint, text string")

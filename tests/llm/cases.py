"""Documents with every awkward row, and columns named like those of the operators."""

SCHEMA = "doc_id long, text string, score string, kept int, cls int, block int, length int, n_words string, shard int, features int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3, 4, "y", 5, 6) for i, t in rows], SCHEMA)


LONG = " ".join(f"w{i}x{i * 7 % 113}" for i in range(20_000))
AWKWARD = [
    (1, "one two three four five six seven eight nine ten eleven twelve"), (1, "one two three four five six seven eight nine ten eleven twelve"), (2, None), (3, ""), (4, " \t\n "), (5, "a"), (6, LONG),
    (7, "One TWO three four five six seven eight nine ten eleven twelve"), (None, "no id here"), (8, "ÄÖ ß 漢字 😀 é"), (9, "x" * 3000), (10, LONG + " tail"),
]

import pytest

ODD = [
    (900000, None), (900001, ""), (900002, "   \n\t "), (900003, "word"), (900003, "word"), (900004, "a b c d e f"), (900005, "a b c d e f"), (900006, "Ünï çode 漢字 😀 text" * 3),
    (900007, 'password = "abc" token: abcdef123; AKIA' + "A" * 16 + " " + "ab" * 15 + " Token=x"), (900008, "mail a.b@c.de,x@y.z 1.2.3.4.5.6.7.8 300.1.1.1 4111 1111-1111 1111 +1 (017) 555-7713"),
    (900009, "x" * 200_000), (900010, "one two\n" * 20_000), (900011, "Licensed under CC BY-NC 4.0. cc by cc by All rights RESERVED; GNU General Public License, version 3."),
    (900012, "it's we'll  <|endoftext|> done\n\n\nnext"),
]


@pytest.fixture(scope="session")
def docs(spark, sf):
    """Documents of the smallest size, odd rows, and columns whose names clash with those that operators make."""
    plain = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(i, t, "en", "odd", len(t or "")) for i, t in ODD], plain.schema)
    both = plain.unionByName(odd).repartition(4)
    return both.selectExpr("*", "1 AS fp", "'x' AS blob", "2 AS score", "3 AS s", "4 AS of", "5 AS spans", "6 AS range", "7 AS found", "8 AS copied").cache()


@pytest.fixture(scope="session")
def rows(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)

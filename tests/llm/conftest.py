import random

import pytest
from llm_rows import SCHEMA, prose, row


@pytest.fixture(scope="session")
def hostile_rows():
    """Nulls everywhere, blank and very long texts, copies, near copies, repeated rows and ids; extra columns with awkward names."""
    rng = random.Random(4)
    base = prose(rng, 120)
    long = prose(rng, 9000)
    near = base.split()
    near[60] = "changed"
    rows = [
        row(1, base), row(2, base.upper().replace("Ñ", "ñ").replace("É", "é").replace("Ö", "ö")), row(3, " ".join(near)), row(4, base), row(4, base), row(5, ""), row(6, None), row(7, " \t\n"),
        row(None, base), row(None, None), row(8, "one"), row(9, "one"), row(10, "a b c d"), row(11, "a b c d e"), row(12, long), row(13, long + " tail"), row(14, prose(rng, 30), None, None, None),
        row(15, prose(rng, 40), "", "", 0), row(15, prose(rng, 41)), row(16, "x" * 300), row(17, "ab" * 400), row(18, prose(rng, 80) + " " + base), row(19, "mail me at jo.doe@mail.example.com or +1 (389) 555-5010"),
        row(20, "ip 10.20.30.40 card 4111 1111 1111 1111 and é 1.2.3.4.5"),
    ]
    return rows + [row(100 + i, prose(rng, rng.randint(1, 200)), rng.choice(["en", "de", None]), rng.choice(["s", "t", "u", None])) for i in range(40)]


@pytest.fixture(scope="session")
def hostile(spark, hostile_rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("hostile") / "documents")
    spark.createDataFrame(hostile_rows, SCHEMA).repartition(4).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "documents")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)

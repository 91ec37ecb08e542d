import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="session")
def path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def groups(pairs, ids):
    """id -> smallest id that pairs reach."""
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


@pytest.fixture(scope="session")
def brute_groups():
    return groups


#: Documents with every odd case: null and empty texts, null and repeated ids, repeated rows, copies, a long text.
def odd_documents():
    import random

    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7)))
    base = [" ".join(word() for _ in range(60)) for _ in range(12)]
    rows = []
    for i, t in enumerate(base):
        rows.append((i, t))
        rows.append((100 + i, t))  # exact copy
        ws = t.split()
        ws[7] = "changed"
        rows.append((200 + i, " ".join(ws)))  # near copy
    rows += [(300, None), (301, ""), (302, " \n\t "), (303, "one two"), (304, "one two"), (None, base[0]), (None, None), (5, base[5]), (5, base[5])]
    rows.append((306, " ".join(word() for _ in range(20_000))))
    rows.append((307, "é x　y ☃ 😀 " * 30))
    shared = " ".join(word() for _ in range(40))
    rows += [(400 + i, f"{word()} {word()}\n{shared}\n{' '.join(word() for _ in range(30))}") for i in range(6)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    df = spark.createDataFrame(odd_documents(), "doc_id long, text string")
    from pyspark.sql import functions as F

    return df.withColumn("id", F.lit("clash")).withColumn("row", F.lit(1)).withColumn("key", F.lit(2)).withColumn("source", F.when(F.col("doc_id") < 250, "hot").otherwise(F.concat(F.lit("s"), (F.col("doc_id") % 3).cast("string")))).cache()


@pytest.fixture(scope="session")
def nothing(spark, odd):
    return spark.createDataFrame([], odd.schema)



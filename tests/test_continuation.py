import random

from pyspark.sql import functions as F

from quillspark.operators import continuation


def fold(rows):
    """The rule, row by row. rows: (page, eligible, mark); two rows join if the second's mark is one more."""

    def partner(i):
        for j in range(i + 1, len(rows)):
            if rows[j][0] - rows[i][0] > 1:
                return None
            if rows[j][1]:
                return j
        return None

    def joins(i, j):
        return rows[i][1] and int(rows[j][2]) == int(rows[i][2]) + 1

    group, n, i = [None] * len(rows), 0, 0
    while i < len(rows) - 1:
        j = partner(i)
        if j is None:
            break
        if not joins(i, j):
            i += 1
            continue
        n += 1
        chain = [i, j]
        while (k := partner(chain[-1])) is not None and joins(chain[-1], k):
            chain.append(k)
        for x in chain:
            group[x] = f"cg-{rows[i][0] + 1:03d}-{n:03d}"
        i = chain[-1] + 1
    return group


def test_as_row_by_row(spark):
    x, documents = random.Random(4), {}
    for d in range(150):
        page, rows = 0, []
        for _ in range(x.randint(1, 25)):
            page += x.choice([0, 0, 0, 1, 1, 1, 2]) if x.random() < 0.5 else 0
            rows.append((page, x.random() < 0.75, str(x.randint(0, 2)) if not rows or x.random() < 0.5 else str(int(rows[-1][2]) + 1)))
        documents[d] = rows
    df = spark.createDataFrame([(d, p, i, e, m) for d, rows in documents.items() for i, (p, e, m) in enumerate(rows)], "doc int, page int, place int, ok boolean, mark string").repartition(5)
    decide = lambda a, b: F.when(b.cast("int") == a.cast("int") + 1, "join").otherwise("break")
    got = {(r.doc, r.place): r.group for r in continuation.chains(df, "doc", "page", "place", F.col("ok"), "mark", decide).collect()}
    want = {(d, i): g for d, rows in documents.items() for i, g in enumerate(fold(rows))}
    assert {k: (got[k], v) for k, v in want.items() if got[k] != v} == {}
    assert sum(v is not None for v in want.values()) > 100

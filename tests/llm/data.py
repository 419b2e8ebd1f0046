"""Small fixtures: nulls, empty and long texts, copies, repeated rows, shared passages, clashing column names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket int, part string, key int, row_id string, size int, u int, salt int, shard string, slot int, node int, h int, _letters int, _id string"
NONE = (None,) * 13


def words(rng, n, size=60):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def rows(seed=1):
    rng = random.Random(seed)
    out = []
    passage = words(rng, 45, 5000)
    for i in range(40):
        out.append((i, words(rng, rng.randrange(20, 120), 400), "en" if i % 2 else "de", f"s{i % 4}"))
    base = out[3][1]
    for i in range(40, 60):  # copies, and near copies of one word changed
        w = base.split()
        if i % 2:
            w[rng.randrange(len(w))] = f"x{i}"
        out.append((i, " ".join(w), "de", "s0"))
    for i in range(60, 66):  # a shared passage
        out.append((i, f"{words(rng, 30, 400)} {passage} {words(rng, 10, 400)}", "en", "s1"))
    out += [(66, None, None, None), (67, "", "en", "s1"), (68, " \n\t ", None, ""), (69, "word", "de", "s2"), (70, "Ä ö\n\nü.", None, None)]
    out += [(71, "to " * 3000, "en", "s3"), (72, words(rng, 6000, 3000), "de", "s3"), (73, "12 34 !!", None, "s2")]
    out += [(None, "no id at all here", "en", "s1"), (2, out[2][1], "en", "s1"), (2, out[2][1], "en", "s1"), (5, "another text of five", "en", "s2")]
    return [(*r, len(r[1] or ""), *NONE) for r in out]


def docs(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def unique(data):
    """Rows with an id of their own."""
    seen, out = set(), []
    for r in data:
        if r[0] is not None and r[0] not in seen:
            seen.add(r[0])
            out.append(r)
    return out

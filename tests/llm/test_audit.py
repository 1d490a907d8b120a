"""The replay of filter orders against plain code."""

import re
from collections import Counter
from itertools import permutations

from chronolex.llm import audit


def plain(docs, labels):
    out = Counter()
    places = set()
    text = [t or "" for _, t, _ in docs]
    for (doc_id, _, source), x in zip(docs, text, strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", x)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", x)) > 2 * len(x), "D": bool(re.search("[#$%&*|]", x)),
            "E": doc_id is not None and any(i is not None and i < doc_id and y == x for (i, _, _), y in zip(docs, text, strict=True)),
        }
        good = doc_id is not None and any(i == doc_id and q == 1 for i, q, _ in labels)
        toxic = doc_id is not None and any(i == doc_id and t == 1 for i, _, t in labels)
        for order in permutations("ABCDE"):
            gone = next((k for k, f in enumerate(order) if fails[f]), 5)
            for k, f in enumerate(order):
                at = source or "", "".join(order), k + 1
                places.add(at)
                out[at, "kept"] += gone > k
                out[at, "removed"] += gone == k
                out[at, "redundant"] += fails[f] and gone < k
                out[at, "unique_fails"] += fails[f] and sum(fails.values()) == 1
                out[at, "good_lost"] += gone == k and good
                out[at, "toxic_lost"] += gone == k and toxic
                out[(source or "", f), "shapley"] += gone == k
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return {at: (*(out[at, n] for n in names), out[(at[0], at[1][at[2] - 1]), "shapley"]) for at in places}


def result(spark, docs, labels):
    d = spark.createDataFrame([(*r, 1, "p") for r in docs], "doc_id long, text string, source string, m int, part string")
    found = audit.report(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in found.collect()}


def test_equals_plain_code(spark):
    long = " ".join(f"w{k}" for k in range(250))
    docs = [
        (1, long, "a"), (2, long, "a"), (2, long, "a"), (0, long, "b"), (None, long, "b"), (3, None, None), (4, "", ""), (5, "One Two $", "a"), (6, "same " * 300, "b"),
        (7, long.upper(), "a"), (8, long + " 100%", "b"), (9, "Ünï cöde\x0bwörd", "a"), (10, "😀 " * 500, "a"), (3, "x " * 200_000, "b"),
    ]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (5, 0, 1), (6, None, 1), (8, 1, 1), (None, 1, 1)]
    assert result(spark, docs, labels) == plain(docs, labels)
    assert result(spark, docs, []) == plain(docs, [])


def test_empty_table_gives_no_rows(spark):
    assert result(spark, [], [(1, 1, 1)]) == {}


def test_other_filters_replay_too(spark):
    flags = spark.createDataFrame([("p", False, False, True, False), ("p", True, False, True, True)], "part string, good boolean, toxic boolean, X boolean, Y boolean")
    got = {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["good_lost"], r["shapley"]) for r in audit.replay(flags, "XY").collect()}
    assert got == {("XY", 1): (0, 2, 0, 1, 3), ("XY", 2): (0, 0, 1, 0, 1), ("YX", 1): (1, 1, 0, 1, 1), ("YX", 2): (0, 1, 1, 0, 3)}

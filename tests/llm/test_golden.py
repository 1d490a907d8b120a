"""Golden records against plain code."""

import math
import random
from datetime import datetime, timedelta

import pytest

from chronolex.llm import golden

SCHEMA = "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double, value string, trust int, salt int, latest string"
TRUST = {"store": 4, "crm": 3, "partner": 2, "web": 1}


def filled(s):
    return s if s is not None and s.strip(" \t\n\x0b\x0c\r") else None


def plain(rows):
    """The contract, one cluster at a time."""
    clusters = {}
    for r in rows:
        clusters.setdefault(r[1] if r[1] is not None else r[0], []).append(r)
    out = {}
    for key, own in clusters.items():
        times = [r[3] for r in own if r[3] is not None]
        fresh = lambda r: r[3] is not None and max(times) - r[3] <= timedelta(days=10)
        greatest = lambda v: tuple(-ord(c) for c in v) + (1,) if isinstance(v, str) else (-v,)
        recent = lambda r: (r[3] is None, -(r[3] - datetime(2000, 1, 1)).total_seconds() if r[3] else 0, -TRUST.get(r[2], 0), r[0] is None, r[0] or 0)
        trusted = lambda r: (not fresh(r), -TRUST.get(r[2], 0), recent(r))

        def first(column, order, own=own):
            having = [r for r in own if (filled(r[column]) if isinstance(r[column], str) else r[column]) is not None and not (isinstance(r[column], float) and not math.isfinite(r[column]))]
            return min(having, key=lambda r: (order(r), greatest(r[column])), default=None)

        name, email, segment = first(4, lambda r: (-len(r[4]), trusted(r))), first(5, trusted), first(8, recent)
        chosen = segment[8] if segment else None
        balance = first(9, lambda r: (chosen is None or r[8] != chosen, recent(r)))
        count = lambda r: (filled(r[6]) is not None) + (r[7] is not None)
        place = min(own, key=lambda r: (-count(r), recent(r)))
        got = lambda r, c: r[c] if r else None
        out[key] = (len(own), sum(not fresh(r) for r in own), got(name, 4), got(email, 5), chosen, filled(place[6]), place[7], math.floor(100 * balance[9] + 0.5) if balance else None,
                    got(name, 0), got(email, 0), got(segment, 0), got(balance, 0), place[0] if count(place) else None)
    return out


COLUMNS = "n_records n_stale name email segment city nation_id balance_cents name_from email_from segment_from balance_from address_from".split()


def result(spark, rows):
    got = golden.golden(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len({r["cluster_id"] for r in got}) == len(got)
    return {r["cluster_id"]: tuple(r[c] for c in COLUMNS) for r in got}


@pytest.mark.parametrize("seed", range(3))
def test_equals_plain_code(spark, seed):
    rng = random.Random(seed)
    pick = lambda *x: rng.choice(x)
    start = datetime(2024, 3, 1)
    rows = []
    for k in range(400):
        at = pick(None, start, start + timedelta(days=10), start + timedelta(days=10, microseconds=1), start + timedelta(days=rng.randrange(40)), start - timedelta(microseconds=1))
        rows.append((k if rng.random() < 0.97 else None, pick(None, *range(30), 7, 7, 7, 7, 7, 7), pick("store", "crm", "partner", "web", None, "else", " store"), at, pick("Ann", "Anna B", "Öla😀", "", " \t", None), pick(f"a{k}@x", None, "", " b "), pick("Rome", None, " "), pick(1, None, 2), pick("x", "y", None, ""), pick(1.005, -0.5, None, float("nan"), float("inf"), 1e3 + k), "v", 1, 2, "l"))
    rows += rows[:40]
    assert result(spark, rows) == plain(rows)


def test_defined_edges(spark):
    assert result(spark, []) == {}
    none = (None,) * 10 + ("v", 1, 2, "l")
    assert result(spark, [none, none]) == {None: (2, 2) + (None,) * 11}
    same = [(1, None, "web", datetime(2024, 1, 1), n, None, None, None, None, None, "v", 1, 2, "l") for n in ("ab", "ac", "b")]
    assert result(spark, same)[1][2] == "ac"  # one id at one time: the greatest of the longest
    long = "x" * 300_000
    assert result(spark, [same[0], (2, 1, "web", None, long, *same[0][5:])])[1][2] == long

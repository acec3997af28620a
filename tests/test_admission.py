"""Ordered admission against a plain fold, whatever part of it is settled by bounds and whatever one after another."""

import random

import pytest

from loomstone.operators import admission

SCOPES = {"user": ["day", "who"], "day": ["day"]}
LIMITS = (("user", "jobs", 3, "user_jobs"), ("user", "size", 60, "user_size"), ("day", "jobs", 25, "day_jobs"), ("day", "size", 330, "day_size"))


def brute(rows, scopes, limits, key=None):
    totals, files, out = {}, set(), {}
    for row in sorted(rows, key=lambda r: r["at"]):
        charge = {c: row[c] or 0 for _, c, *_ in limits}
        if key and row[key] is not None and row[key] in files:
            out[row["at"]] = "attached"
            continue
        place = {s: (s, *[row[c] for c in by]) for s, by in scopes.items()}
        code = next((code for s, c, most, code in limits if totals.get((place[s], c), 0) + charge[c] > most), "admitted")
        out[row["at"]] = code
        if code == "admitted":
            files.add(row.get(key))
            for s in scopes:
                for c in charge:
                    totals[place[s], c] = totals.get((place[s], c), 0) + charge[c]
    return out


@pytest.mark.parametrize("fold", [12, 10_000])
def test_two_scopes(spark, fold):
    rng = random.Random(fold)
    rows = [{"at": i, "day": rng.choice(["a", "b", None]), "who": rng.choice([1, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, None]), "jobs": 1, "size": rng.choice([1, 2, 5, 20, 40, 70, None])} for i in range(260)]
    rng.shuffle(rows)
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "at long, day string, who int, jobs int, size int").repartition(3)
    got = {r["at"]: r.verdict for r in admission.admit(df, ["at"], SCOPES, ["jobs", "size"], LIMITS, fold=fold).collect()}
    want = brute(rows, SCOPES, LIMITS)
    assert got == want and len(set(want.values())) >= 4


@pytest.mark.parametrize("fold", [25, 10_000])
def test_attached_files_cost_nothing(spark, fold):
    """A refused file is asked again by its next row; an admitted one is attached."""
    rng = random.Random(7)
    scopes = {"subject": ["day"], "all": []}
    limits = (("subject", "size", 120, "subject_full"), ("all", "size", 260, "all_full"))
    sizes = {k: rng.choice([3, 10, 30, 90, 200]) for k in range(40)}
    rows = []
    for i in range(150):
        k = rng.choice([*range(40), None])
        rows.append({"at": i, "day": rng.choice("xyz"), "file": k, "size": sizes.get(k, 4)})
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "at long, day string, file int, size int").repartition(4)
    got = {r["at"]: r.verdict for r in admission.admit(df, ["at"], scopes, ["size"], limits, key="file", fold=fold).collect()}
    want = brute(rows, scopes, limits, "file")
    assert got == want and {"attached", "subject_full", "all_full", "admitted"} <= set(want.values())


def test_no_requests(spark):
    df = spark.createDataFrame([], "at long, day string, who int, jobs int, size int")
    assert admission.admit(df, ["at"], SCOPES, ["jobs", "size"], LIMITS).columns == [*df.columns, "verdict"]
    assert admission.admit(df, ["at"], SCOPES, ["jobs", "size"], LIMITS).count() == 0


def test_what_the_first_requests_fill_needs_no_rounds(spark, monkeypatch):
    """Once the first requests fill a quota, the rest is refused by its totals; only the codes take ordered sums, one a scope."""
    rng = random.Random(4)
    rows = [{"at": i, "day": rng.choice(["a", "b", None]), "who": rng.randrange(9), "jobs": 1, "size": rng.choice([1, 2, 5])} for i in range(300)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "at long, day string, who int, jobs int, size int").repartition(3)
    taken, earlier = [], admission.earlier
    monkeypatch.setattr(admission, "earlier", lambda rows, by, sums: taken.append(by) or earlier(rows, by, sums))
    got = {r["at"]: r.verdict for r in admission.admit(df, ["at"], SCOPES, ["jobs", "size"], LIMITS, fold=60).collect()}
    assert got == brute(rows, SCOPES, LIMITS) and len(taken) == len(SCOPES)

"""Periodic runs, conversation repair and near-duplicate vectors against brute force, with every odd kind of row."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from loomstone.llm import conversations, itq_near, periodic_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


# --- periodic runs ---


def brute_runs(w, least=24, times=3):
    out = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j + q - i
            if j > i and n >= max(least, times * q) and not any(all(w[k] == w[k + d] for k in range(i, i + n - d)) for d in range(1, q)):
                out.append((i, n, q))
            i = max(j, i) + 1
    return sorted(out)


def brute_digest(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def phrases(rng, k):
    w = []
    while len(w) < k:
        part = [f"w{rng.randrange(rng.choice([1, 2, 5, 40]))}" for _ in range(rng.randint(1, 12))]
        w += part * rng.choice([1, 1, 2, 3, 9, 30])
    return w


def test_automaton_against_brute_force():
    rng, many = random.Random(3), 0
    for _ in range(400):
        w = [int(x[1:]) for x in phrases(rng, rng.randint(0, 90))]
        for least, times in ((24, 3), (2, 2), (5, 4)):
            found = periodic_runs.runs_of(w, least, times)
            assert found == brute_runs(w, least, times)
            many += len(found)
        inside = [(a + s, n, p) for a, b in periodic_runs.stretches(np.array(w, np.int64)) for s, n, p in periodic_runs.runs_of(w[a:b])]
        assert inside == brute_runs(w)
    assert many > 5000


def test_runs_of_odd_texts(spark):
    rng = random.Random(5)
    looping = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 10 == 0][:12]
    texts = [None, "", " \t ", "one", "a " * 3000, " b " * 24, "x y " * 23, "A\x0bB\x0cC\x1fD " * 10, "tick tock\n" * 12, "tick tock\n" * 12]
    rows = [(i, t, "mine", i) for i, t in enumerate(texts)] + [(i, " ".join(phrases(rng, rng.randint(1, 260))), None, i) for i in looping for _ in range(3)]
    rows += [(None, "na " * 30, "", 1), (7, None, "", 1), (looping[0], "one two three", "", 1), (10**12, " ".join(str(k % 700) for k in range(2500)), "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, collapsed string, runs long")
    found = periodic_runs.collapsed(docs, loops=True)
    assert found.columns == ["doc_id", "text", "runs", "collapsed"]
    got = sorted((tuple(r) for r in periodic_runs.digest(found).collect()), key=repr)
    assert got == sorted((brute_digest(d, t) for d, t, *_ in rows), key=repr)
    assert any(r[1] > 1 for r in got) and any(r[1] == 0 for r in got)
    plain = periodic_runs.collapsed(docs.where("doc_id = 8")).collect()[0]
    assert plain.collapsed == "tick tock" and [tuple(r) for r in plain.runs] == [(0, 24, 2)]
    assert periodic_runs.digest(periodic_runs.collapsed(docs.where("false"))).collect() == []


def test_runs_of_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    from loomstone.llm import queries

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if len(r.text or "") < 12_000]
    got = {r.doc_id: tuple(r) for r in queries.queries()["op11_periodic_runs"](spark, sf).collect()}
    assert {d: got[d] for d, _ in rows} == {d: brute_digest(d, t) for d, t in rows}


# --- conversation repair ---


def cheapest(rows):
    """(cost, audit, repaired rows) by relaxing all (row, initials so far) states, with whole strings."""
    grammar = {"": "su", "s": "u", "u": "a", "a": "u"}
    full = {"u": "user", "a": "assistant"}
    best = {(0, ""): (0, "", ())}
    done = None
    for i in range(len(rows) + 1):
        for _ in range(5):
            for state in ("", "s", "u", "a"):
                if (i, state) in best:
                    c, audit, out = best[i, state]
                    for x in grammar[state]:
                        if x in full:
                            new = (c + 3, audit + "I", (*out, f"{full[x]}:"))
                            best[i, x] = min(best.get((i, x), new), new)
        if i == len(rows):
            done = min(best[i, s] for s in ("", "a") if (i, s) in best)
            break
        role, text, fault = rows[i]
        for state in ("", "s", "u", "a"):
            if (i, state) not in best:
                continue
            c, audit, out = best[i, state]
            moves = [(state, c + 4, "D", out)]
            if fault not in ("blank", "duplicate"):
                late = 3 * (fault == "truncated")
                if role[:1] and role[:1] in grammar[state]:
                    moves.append((role[0], c + late, "K", (*out, f"{role}:{text}")))
                moves += [(x, c + late + 3, "R", (*out, f"{full[x]}:{text}")) for x in grammar[state] if x in full]
            for to, cost, e, o in moves:
                new = (cost, audit + e, o)
                best[i + 1, to] = min(best.get((i + 1, to), new), new)
    return done


def brute_repair(table):
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest())
    out = []
    for conv in {r[0] for r in table}:
        rows = []
        for c, turn, role, text in table:
            if c != conv:
                continue
            fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            text = "" if fate == 1 else re.sub(r"[.!?]", "", text) if fate == 2 else text
            role = "user" if fate == 4 else role
            rows += [(turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
        rows.sort(key=order)
        seen, marked = set(), []
        for _, role, text in rows:
            body = WORD.findall(text)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1][-1] in ".!?" else "truncated"
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = {r[0] for r in rows if r[0] is not None}
        count = [sum(m[2] == f for m in marked) for f in ("blank", "duplicate", "truncated")]
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        cost, audit, said = cheapest(marked)
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *count, illegal, cost, audit, sha("\n".join(said))))
    return sorted(out, key=repr)


def odd_conversations(seed, n=90):
    rng, table = random.Random(seed), []
    for conv in [None, *range(n)]:
        turn = rng.randint(-3, 3)
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 13])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "a", "sage", "User"])
            text = rng.choice(["Yes.", "No!", "Why?", "cut", "cut ", None, "", " \t", "Yes. ", "End.\n \x0b", "été?", "e" * 50 + "."])
            table.append((conv, rng.choice([turn, turn, turn, None]), role, text))
            turn += rng.choice([1, 1, 1, 2, 0])
    return table


def test_repair_against_brute_force(spark):
    table = odd_conversations(1)
    rows = spark.createDataFrame([(*r, "x") for r in table], "conv_id long, turn long, role string, text string, digest string")
    got = conversations.digest(conversations.damage(rows))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_repair(table)
    assert conversations.digest(conversations.damage(rows.where("false"))).collect() == []


def test_repaired_rows_follow_the_grammar(spark):
    table = odd_conversations(2)
    rows = spark.createDataFrame(table, "conv_id long, turn long, role string, text string").where("conv_id IS NOT NULL")
    said = {}
    for r in sorted(conversations.repaired(rows).collect(), key=lambda r: (r.conv_id, r.place)):
        assert len(said.setdefault(r.conv_id, [])) == r.place
        said[r.conv_id].append(r)
    assert all(re.fullmatch("s?(ua)+", "".join(r.role[0] for r in rs)) for rs in said.values())
    assert any(r.edit == "I" and r.text == "" for rs in said.values() for r in rs)


def test_repair_sql_on_odd_rows(spark):
    table = [r for r in odd_conversations(4, 40) if r[2] != "" and len({t[1] for t in odd_conversations(4, 40) if t[0] == r[0]}) == len([t for t in odd_conversations(4, 40) if t[0] == r[0]])]
    con = duckdb.connect()
    con.sql("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", table)
    assert sorted(con.sql(conversations.oracle()).fetchall(), key=repr) == brute_repair(table)


def test_long_conversation(spark):
    """One conversation of many rows is streamed past its edits."""
    rows = spark.range(30_000).selectExpr("1 AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('Row ', id, '.') AS text")
    r = conversations.digest(rows.where("turn <> 777")).collect()[0]
    # row 776 stands before row 778, both by the user; the last row is the assistant's
    assert (r.gaps, r.illegal, r.cost) == (1, 1, 3) and r.audit == "K" * 777 + "I" + "K" * 29_222


# --- near-duplicate vectors ---


def brute_links(rows, threshold):
    fine = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    units = [np.array(v, float) / np.abs(v).max() if f else None for f, (_, v) in zip(fine, rows, strict=True)]
    units = [u / np.linalg.norm(u) if u is not None else None for u in units]
    root, links = list(range(len(rows))), [0] * len(rows)
    for i, u in enumerate(units):
        for j in range(i):
            if u is not None and units[j] is not None and len(u) == len(units[j]) and float(u @ units[j]) >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = root[i], root[j]
                root = [a if r == b else r for r in root]
    out = []
    for i, (k, _) in enumerate(rows):
        low = min((rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None), default=None)
        out.append((k, links[i], low, links[i] == 0 if k is None else k == low))
    return sorted(out, key=repr)


def near(rng, base, cosine):
    """A unit vector at the given cosine from a unit vector."""
    other = rng.standard_normal(len(base))
    other -= other @ base * base
    return cosine * base + math.sqrt(1 - cosine**2) * other / np.linalg.norm(other)


def test_vectors_of_every_odd_kind(spark):
    rng = np.random.default_rng(4)
    rows = [(i, v) for i, v in enumerate([None, [], [0.0] * 8, [float("nan")] * 8, [1.0, None] * 4, [float("inf")] + [1.0] * 7, [1e300] * 8, [1e-300] * 8, [3.0], [5.0], [-5.0], [1.0, 1.0]])]
    for k in range(40):
        base = rng.standard_normal(8)
        base /= np.linalg.norm(base)
        rows += [(100 + 4 * k, base.tolist()), (101 + 4 * k, (2 * base).tolist()), (102 + 4 * k, near(rng, base, 0.97).tolist()), (103 + 4 * k, base.tolist())]
    rows += [(None, rows[20][1]), (100, rows[30][1]), (None, [0.0, 0.0])]
    table = spark.createDataFrame([(k, v, "x", 1) for k, v in rows], "vec_id long, embedding array<double>, node string, key int")
    assert sorted((tuple(r) for r in itq_near.near_duplicates(table).collect()), key=repr) == brute_links(rows, 0.95)
    assert itq_near.near_duplicates(table.where("false")).collect() == []


@pytest.mark.parametrize("seed", [0, 1])
def test_vectors_near_the_threshold(spark, seed):
    """Pairs hardly above the threshold, and a hot group of many blocks: nothing below is linked, almost nothing above is lost."""
    rng = np.random.default_rng(seed)
    vectors = []
    for _ in range(300):
        base = rng.standard_normal(64)
        base /= np.linalg.norm(base)
        vectors += [base, near(rng, base, rng.uniform(0.951, 0.96)), near(rng, base, 0.949)]
    hot = rng.standard_normal(64)
    hot /= np.linalg.norm(hot)
    vectors += [near(rng, hot, 0.985) for _ in range(1300)]
    x = np.array(vectors, np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = sorted(itq_near.near_duplicates(table).collect())
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    linked = u @ u.T >= 0.95
    np.fill_diagonal(linked, False)
    degree = linked.sum(axis=1)
    n = np.array([r.n_links for r in got])
    assert (n <= degree).all() and n.sum() >= 0.99 * degree.sum() and n[:900].sum() >= 0.9 * degree[:900].sum()
    assert {r.component_id for r in got[900:]} == {900} and sum(r.kept for r in got[900:]) == 1


def test_rotation_balances_bits():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 16)) @ np.diag(np.linspace(0.1, 3, 16)) + 1
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codes = itq_near.fit(x, 100_000, 0.95)
    share = codes.bits(x).mean(axis=0)
    assert codes.tables * codes.width <= codes.axes.shape[1] and np.abs(share - 0.5).max() < 0.15
    turned = (x - x.mean(axis=0)) @ np.linalg.eigh(np.cov(x - x.mean(axis=0), rowvar=False))[1]
    loss = lambda r: np.square(turned @ r - np.abs(turned @ r).mean() * np.sign(turned @ r)).sum()
    assert loss(itq_near.rotation(turned, 0)) < loss(np.linalg.qr(np.random.default_rng(0).standard_normal((16, 16)))[0])

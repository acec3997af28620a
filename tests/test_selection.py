"""Selection and planning against plain statements of their rules."""

import random
import re

import pandas as pd
from pyspark.sql import functions as F

from loomstone.functions import text as tx
from loomstone.operators import chunking, evidence, planning, questions, selection


def near(anchors, chunks, b):
    """Neighbours of one query's anchors, by going through all chunks."""
    pages = {(a["document"], a["page"]) for a in anchors}
    room = b.tokens - sum(a["tokens"] for a in anchors)
    if len(anchors) > b.chunks or len(pages) > b.pages or room <= 0:
        return []
    found = []
    for c in chunks:
        by = [(abs(c["page"] - a["page"]), i + 1, a["chunk"]) for i, a in enumerate(anchors) if a["document"] == c["document"] and abs(c["page"] - a["page"]) <= b.radius]
        if by and c["tokens"] <= room and c["chunk"] not in {a["chunk"] for a in anchors}:
            found.append((*min(by)[:2], c["page"], c["chunk"], c))
    out = []
    for *_, c in sorted(found, key=lambda f: f[:4])[: b.chunks - len(anchors)]:
        page = (c["document"], c["page"])
        if (page in pages or len(pages) < b.pages) and c["tokens"] <= room:
            pages.add(page)
            room -= c["tokens"]
            out.append(c)
    return out


def words_of(text):
    return {w for w in re.findall(tx.NAVIGATION_WORD, text.lower()) if w not in tx.NAVIGATION_STOP}


def pooled(ranked, chunks, pages, b):
    leads = list({(r["document"], r["page"]): r for r in reversed(ranked)}.values())
    leads = sorted(leads, key=lambda r: r["rank"])[:4]
    seen = {}
    for c in [*leads, *near(leads, chunks, b), *ranked]:
        if c["tokens"] > 0:
            seen.setdefault((c["document"], c["page"]), c)
    chosen = list(seen.items())[: b.pages]
    texts = [pages.get(k) for k, _ in chosen]
    if any(not t or not t.strip() for t in texts) or sum(chunking.Size.of(t).tokens for t in texts) > b.tokens:
        return []
    terms = words_of(ranked[0]["question"])
    scored = []
    for i, ((_, c), text) in enumerate(zip(chosen, texts, strict=True)):
        at = evidence.Passage(text).best(frozenset(terms))
        if at:
            scored.append((-len(words_of(text[at[0] : at[1]]) & terms), -c.get("fusion_score", 0.0), i, c["chunk"], at[0]))
    return [(n + 1, s[3], s[4], -s[0]) for n, s in enumerate(sorted(scored)[:4])]


def test_neighbours_and_pool(spark):
    rng = random.Random(5)
    word = lambda: rng.choice("alpha beta gamma delta epsilon zeta light-year the of".split())
    for b in (selection.Bounds(2), selection.Bounds(1, 7, 5, 200), selection.Bounds(2, 30, 6, 120)):
        chunks = [{"document": d, "page": p, "chunk": 100 * d + 10 * p + k, "tokens": rng.choice([0, 5, 20, 60])} for d in range(3) for p in range(8) for k in range(2)]
        pages = {(d, p): " ".join(word() for _ in range(rng.randint(1, 40))) for d in range(3) for p in range(8)}
        pages[2, 7] = " \n"
        del pages[1, 0]
        ranked = []
        for q in range(12):
            question = " ".join(word() for _ in range(4))
            ranked += [{"query_id": q, "rank": i + 1, "fusion_score": 1 / (60 + i), "question": question, **c} for i, c in enumerate(rng.sample(chunks, rng.randint(1, 9)))]
        table = spark.createDataFrame(pd.DataFrame(ranked))
        texts = spark.createDataFrame([(*k, t) for k, t in pages.items()], "document long, page long, text string")
        got = selection.candidate_pool(table, spark.createDataFrame(pd.DataFrame(chunks)), texts, bounds=b).collect()
        want = {(q, *r) for q in range(12) for r in pooled([r for r in ranked if r["query_id"] == q], chunks, pages, b)}
        assert {(r.query_id, r.position, r.chunk, r.start_offset, r.cue_hits) for r in got} == want and want
    none = table.where("false")
    assert selection.candidate_pool(none, none.select("document", "page", "chunk", "tokens"), texts).count() == 0


def fill(chunks, shares, whole, lim):
    """Requests of a job as lists of (chunk_index, cards)."""
    done, open_ = [], []
    for c in chunks:
        left = shares.get(c["chunk_index"], 0)
        while left:
            held = sum(n for _, n in open_)
            size = sum((chunking.Size.of("\n\n" + d["text"]) for d in [*(x for x in chunks if x["chunk_index"] in dict(open_)), c]), lim.frame)
            if held == lim.cards or open_ and not whole and size.tokens + lim.reserve > lim.input_target:
                done, open_ = [*done, open_], []
                held = 0
            open_ = [*open_, (c["chunk_index"], min(left, lim.cards - held))]
            left -= open_[-1][1]
    return done + [open_] if open_ else done


def waves_of(requests):
    out = []
    for r in requests:
        if not out or any({i for i, _ in r} & {i for i, _ in x} for x in out[-1]):
            out.append([])
        out[-1].append(r)
    return [n + 1 for n, w in enumerate(out) for _ in w]


def shares_of(chunks, asked, target):
    pages = {}
    for c in sorted(chunks, key=lambda c: (asked.get(c["chunk_index"], 0), c["chunk_index"])):
        pages.setdefault(c["page_number"], []).append(c["chunk_index"])
    turns = [p[i] for i in range(max(map(len, pages.values()))) for _, p in sorted(pages.items()) if i < len(p)]
    first = [c for c in turns if not asked.get(c)] + sorted((c for c in turns if asked.get(c)), key=lambda c: (asked[c], turns.index(c)))
    out = dict.fromkeys(first, 0)
    for i in range(max(target, 0)):
        out[first[i % len(first)]] += 1
    return out


def test_batches_and_preflight(spark):
    rng = random.Random(8)
    jobs = {}
    for j in range(9):
        jobs[j] = [{"chunk_index": i + 1, "page_number": rng.randint(1, 3), "text": "wört, " * rng.randint(1, 90)} for i in range(rng.randint(1, 7))]
    for c in (c for j in jobs.values() for c in j):
        c["token_count"] = chunking.Size.of(c["text"]).tokens
    rows = pd.DataFrame([{"job": j, **c} for j, cs in jobs.items() for c in cs])
    lim = planning.Limits(cards=4, input_target=700, pack_tokens=400, pack_chunks=3, reserve=50, summary_tokens=40, output_tokens=2000, job_input=6000, job_output=16000)
    df = spark.createDataFrame(rows)

    asked = planning.allocate(planning.sized(df).withColumns({"asked": F.lit(0), "got": F.lit(0), "whole": F.col("job") % 2 == 0}), "job", 11)
    got = planning.batches(asked, ["job"], lim).orderBy("job", "batch", "chunk_index").collect()
    want = []
    for j, cs in jobs.items():
        requests = fill(cs, shares_of(cs, {}, 11), j % 2 == 0, lim)
        want += [(j, b + 1, w, i, n) for (b, r), w in zip(enumerate(requests), waves_of(requests), strict=True) for i, n in r]
    assert [tuple(r) for r in got] == want

    told = {r.job: (r.packs, r.requests, r.input_tokens, r.output_tokens, r.refused) for r in planning.preflight(df, "job", 11, lim).collect()}
    for j, cs in jobs.items():
        packs, tokens = [], 0
        for c in cs:
            if not packs or len(packs[-1]) == lim.pack_chunks or tokens + c["token_count"] > lim.pack_tokens:
                packs, tokens = [*packs, []], 0
            packs[-1].append(c)
            tokens += c["token_count"]
        several = len(packs) > 1
        whole = lambda many, start=lim.frame: sum((chunking.Size.of("\n\n" + c["text"]) for c in many), start)
        summary = chunking.Size.of("summary " * lim.summary_tokens)
        merges, level = 0, len(packs) if several else 0
        while level > 1:
            merges += level // 8 + (level % 8 > 1)
            level = -(-level // 8)
        calls, reads, writes, spent = 0, 0, 0, {}
        for _ in range(lim.refills + 1):
            shares = shares_of(cs, spent, 11)
            for r in fill(cs, shares, not several, lim):
                calls += 1
                prompt = whole([c for c in cs if c["chunk_index"] in dict(r)], lim.frame + summary) if several else whole(cs)
                reads += prompt.tokens + lim.reserve
                writes += min(lim.output_tokens, 512 * sum(n for _, n in r) + 256)
            spent = {i: spent.get(i, 0) + n for i, n in shares.items()}
        summaries = (len(packs) if several else 0) + merges
        reads += sum(whole(p).tokens for p in packs) * several + merges * sum([summary] * 8, lim.frame).tokens
        writes += summaries * lim.summary_tokens
        refused = "ai_input_token_limit" if reads > lim.job_input else "ai_output_token_limit" if writes > lim.job_output else ""
        assert told[j] == (len(packs), calls + summaries, reads, writes, refused)
    assert len({t[4] for t in told.values()}) > 1
    assert planning.preflight(df.where("false"), "job", 11, lim).count() == 0


def test_literal_subjects(spark):
    want = {
        "Tell me about the Fourier transform.": "Fourier transform",
        "Please explain gradient descent please?": "gradient descent",
        "What is the purpose of attention?": "attention",
        "How is dropout used in networks?": "dropout",
        "What does the lecture say about T5-large?": "T5-large",
        "What is the model?": None,
        "What is BLEU and ROUGE?": None,
        "Explain it.": None,
        "Describe a - b": None,
        "Explain the secret": None,
        "What is BLEU? Why": None,
        "": None,
        "Define entropy entropy": "entropy entropy",
        "What does recall\nmeasure": None,
    }
    df = spark.createDataFrame([(q,) for q in want], "q string")
    assert {r.q: r.s for r in df.select("q", questions.literal_subject(F.col("q")).alias("s")).collect()} == want

"""Rules against plain statements of them."""

import json
import math
import random
import re
import unicodedata

from pyspark.sql import Row
from pyspark.sql import functions as F

from loomstone.functions import text as tx
from loomstone.functions import vectors as vec
from loomstone.operators import chunking, evaluation, evidence, questions, retrieval, study
from loomstone.plans import retrieval as plans
from loomstone.sources import blocks
from loomstone.streaming import learner

SF = "/root/testdata/sf0.001"


def test_bounded_terms(spark):
    df = spark.createDataFrame([("What is the role of orbital eccentricity in perihelion?",), ("what is the",)], "q string")
    got = [r[0] for r in df.select(F.array_join(tx.bounded_terms(F.col("q"), 3), " ")).collect()]
    assert got == ["role orbital eccentricity", "what is the"]


def test_token_estimate_is_the_chunkers(spark):
    texts = ["ﬁ" * 30, "ＷＩＤＥ" * 5, "x² ½ Ⅷ", "", "a", "Straße — naïve!", "x" * 100, "one two, three."]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(tx.token_estimate(F.col("t"))).collect()] == [chunking.Size.of(t).tokens for t in texts]


def test_a_given_estimator_measures_chunks():
    """The estimator of the sizes, given as a function, cuts as the sizes do; another one keeps its own ceiling."""
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choice(["a", "word", "naïve", "longer-word", "ﬁn", "x,y;z"]) for _ in range(n))
    for _ in range(60):
        blocks = [(rng.choice([None, None, "Head"]), text(rng.choice([0, 1, 5, 20, 90]))) for _ in range(rng.randint(1, 9))]
        told = chunking.Meter(lambda t: chunking.Size.of(t).tokens)
        assert list(chunking.fill(blocks, 60, 12, told)) == list(chunking.fill(blocks, 60, 12))
        many = list(chunking.fill(blocks, 25, 5, chunking.Meter(lambda t: len(t.split()))))
        assert all(len(t.split()) <= 25 for _, t in many) and {w for _, t in many for w in t.split()} == {w for _, b in blocks for w in b.split()}


def test_headings(spark):
    lines = ["Chapter 1 about", "2.1 Results", "ALL CAPS", "A Title Like This", "just a sentence.", "lower case words", "", "Ends With Stop."]
    df = spark.createDataFrame([(t,) for t in lines], "t string")
    assert [r[0] for r in df.select(tx.heading(F.col("t"))).collect()] == [True, True, True, True, False, False, False, False]


def test_chunks_keep_sections_and_the_ceiling(spark):
    page = "Chapter One\n\nalpha beta gamma.\n\nChapter Two\n\n" + " ".join(f"word{i}" for i in range(400))
    got = chunking.chunk(spark.createDataFrame([(1, page), (2, ""), (3, None)], "doc_id long, text string"), 100, 20).orderBy("chunk_index").collect()
    assert {r.doc_id for r in got} == {1}
    assert got[0].section == "Chapter One" and all(r.section == "Chapter Two" for r in got[1:])
    assert all(r.token_count <= 100 for r in got)
    seen = set(re.findall(r"word\d+", " ".join(r.text for r in got)))
    assert len(seen) == 400


def naive_tokens(text):
    return max(1, math.ceil(len(text) / 3), math.ceil(len(text.encode()) / 4), len(re.findall(r"\w+|[^\w\s]", text))) if text else 0


def naive_chunks(page, ceiling, overlap):
    """Chunks of a page by trying every end and every overlap; lines that begin with # are its headings, written as CHAPTER."""
    out, section, held, owner = [], None, "", None
    for block in page:
        if block.startswith("Chapter "):
            section, _, block = block.partition("\n")
        if not block:
            continue
        if naive_tokens(block) > ceiling:
            if held:
                out.append((owner, held))
            held, words, start = "", block.split(), 0
            while True:
                end = max([start + 1, *(e for e in range(start + 1, len(words) + 1) if naive_tokens(" ".join(words[start:e])) <= ceiling)])
                out.append((section, " ".join(words[start:end])))
                if end == len(words):
                    break
                start = max(start + 1, min([end, *(b for b in range(start, end) if overlap and naive_tokens(" ".join(words[b:end])) <= overlap)]))
        elif held and (owner != section or naive_tokens(held + "\n\n" + block) > ceiling):
            out.append((owner, held))
            words = held.split()
            tail = next((" ".join(words[b:]) for b in range(len(words)) if overlap and naive_tokens(" ".join(words[b:])) <= overlap), "")
            held = tail + "\n\n" + block if tail and naive_tokens(tail + "\n\n" + block) <= ceiling else block
        else:
            held = held + "\n\n" + block if held else block
        owner = section
    return out + ([(owner, held)] if held else [])


def test_chunks_of_several_pages_against_brute_force(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcé,.") for _ in range(rng.randint(1, 12)))

    def block():
        body = " ".join(word() for _ in range(rng.choice([1, 4, 9, 30, 90]))) + "."
        return rng.choice(["", "", f"Chapter {rng.randint(1, 3)}\n"]) + body if rng.random() < 0.9 else "Chapter 9"

    docs = {d: [[block() for _ in range(rng.randint(0, 6))] for _ in range(rng.randint(1, 4))] for d in range(25)}
    rows = [(d, n, "\n \n".join(page)) for d, pages in docs.items() for n, page in enumerate(pages, 1)]
    df = spark.createDataFrame(rows, "doc_id long, page_number int, text string").repartition(3)
    for ceiling, overlap in ((40, 10), (25, 0), (12, 11)):
        want = []
        for d, pages in docs.items():
            found = [(n, s, t) for n, page in enumerate(pages, 1) for s, t in naive_chunks(page, ceiling, overlap)]
            want += [(d, f"chunk-{i:04d}-p{n}", i, n, s, t, naive_tokens(t)) for i, (n, s, t) in enumerate(found, 1)]
        got = sorted(map(tuple, chunking.chunk(df, ceiling, overlap).collect()), key=lambda r: (r[0], r[2]))
        assert got == want


def test_packing_closes_at_the_bounds(spark):
    rng = random.Random(3)
    rows = [(d, i, rng.randint(1, 90)) for d in range(20) for i in range(1, rng.randint(2, 30))]
    got = {r.doc_id: r for r in chunking.pack(spark.createDataFrame(rows, "doc_id long, chunk_index int, token_count long"), 100, 4).collect()}
    for d in range(20):
        packs, used, n = 0, 0, 0
        for _, _, t in [r for r in rows if r[0] == d]:
            if n == 0 or n + 1 > 4 or used + t > 100:
                packs, used, n = packs + 1, t, 1
            else:
                used, n = used + t, n + 1
        assert got[d].packs == packs


def test_fusion(spark):
    policy = retrieval.Policy()
    v = spark.createDataFrame([(1, 0.9, 1), (2, 0.8, 2)], "doc_id long, similarity double, vector_rank int")
    x = spark.createDataFrame([(1, 0.5, 1), (3, 0.4, 2)], "doc_id long, lexical_score double, lexical_rank int")
    got = {r.doc_id: r for r in retrieval.fuse(v, x, policy).collect()}
    assert math.isclose(got[1].fusion_score, 2 / 61, abs_tol=1e-8) and got[1].position == 1
    assert got[2].fusion_score == got[3].fusion_score and got[2].position == 2


def test_selection_skips_overlap_and_oversize(spark):
    rows = [(1, 1, 11, "s", 1, "alpha beta gamma", 3), (1, 2, 12, "s", 1, "alpha beta gamma delta", 3), (1, 3, 13, "s", 1, "big one", 9000), (1, 4, 14, "s", 1, "other words", 3)]
    df = spark.createDataFrame(rows, "query_id long, rank int, chunk long, document string, page int, text string, tokens long")
    assert [r.chunk for r in retrieval.select_bounded(df, retrieval.Policy()).orderBy("position").collect()] == [11, 14]


def test_top_k_is_exact(spark):
    rng = random.Random(5)
    base = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(200)]
    df = spark.createDataFrame(base, "vec_id long, embedding array<float>")
    queries = df.where("vec_id < 5").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    got = vec.top_k(queries, df.repartition(7), 4).orderBy("query_id", "rank").collect()
    for q in range(5):
        cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
        want = sorted(base, key=lambda r: (-round(cos(base[q][1], r[1]), 6), r[0]))[:4]
        assert [r.vec_id for r in got if r.query_id == q] == [w[0] for w in want]


def test_near_duplicates(spark):
    rows = [(1, 1, 1, "What is Alpha?", "the first letter"), (1, 2, 2, "Define: alpha!", "the first letter"), (1, 3, 3, "What is Beta?", "the second")]
    got = {r.card: r for r in evidence.distinct_cards(spark.createDataFrame(rows, "job long, ordinal int, card long, question string, answer string")).collect()}
    assert (got[1].kept, got[2].kept, got[3].kept) == (True, False, True) and got[2].like == 1


def test_grounding_codes(spark):
    rows = [
        ("what is it", "cat", "a cat sat", ["dog"], "there a  Cat sat down"), ("what is it", "dog", "a cat sat", ["dog"], "a cat sat"), ("what is it", "cat", "no such", ["dog"], "a cat sat"),
        ("hm", "cat", "a cat", ["dog"], "a cat"), ("what is it", "cat", "a cat", ["dog", " What  is IT"], "a cat"), ("what is it", "cat", "a cat", ["dog"], None),
    ]
    df = spark.createDataFrame(rows, "question string, answer string, quote string, options array<string>, source string")
    want = [None, "answer_not_in_quote", "quote_not_contiguous", "unclear_question", "option_matches_question", "unknown_source"]
    assert [r.rejection for r in evidence.grounding(df).collect()] == want


def asked(spark, rows):
    return spark.createDataFrame(rows, "query_id long, rank int, document string, page long, question string, text string")


def test_excerpt_is_exact(spark):
    text = "Lead in. " + "filler words go here and on. " * 40 + "The orbital period is stated here. " + "more filler text. " * 30
    (r,) = evidence.excerpts(asked(spark, [(1, 1, "d", 2, "orbital period", text), (1, 2, "d", 3, "orbital", "")])).collect()
    assert text[r.start_offset : r.end_offset] == r.quote and r.term_hits == 2 and "orbital period" in r.quote and len(r.quote) <= 480


def naive_window(text, terms):
    """The best window by looking at every place a window may begin and end."""
    word = re.compile("[a-z0-9]{3,}", re.I)
    places = [0] + [m.start() for m in word.finditer(text) if m[0].lower() in terms][:64]
    best = None
    for place in places:
        begin = max(0, place - 80)
        opens = [(i, i + 1) for i in range(max(0, begin - 80), begin) if text[i] == "\n"] + [(i, i + 2) for i in range(max(0, begin - 80), begin - 1) if text[i : i + 2] == ". "]
        begin = max(opens)[1] if begin and opens else begin
        end = min(len(text), begin + 420)
        if end < len(text):
            lines = [i for i in range(max(begin + 80, end - 80), min(len(text), begin + 480)) if text[i] == "\n"]
            blanks = [i for i in range(max(begin + 80, end - 60), end) if text[i] == " "]
            end = lines[0] if lines else blanks[-1] if blanks else end
        while begin < end and text[begin].isspace():
            begin += 1
        while end > begin and text[end - 1].isspace():
            end -= 1
        if begin < end <= begin + 480:
            hits = len({m[0].lower() for m in word.finditer(text[begin:end])} & terms)
            if best is None or (-hits, begin, end) < best:
                best = (-hits, begin, end)
    return best and (best[1], best[2], -best[0])


def test_windows_against_brute_force():
    rng = random.Random(12)
    for _ in range(300):
        words = ["orbit", "orbital", "period", "mean", "a", "of", "Orbit.", "end.", "long" * 30, "x\n", "\n", "period. "]
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 260)))
        terms = frozenset(rng.sample(["orbit", "orbital", "period", "mean"], rng.randint(0, 3)))
        assert evidence.Passage(text).best(terms) == naive_window(text, terms)


def test_every_place_of_a_term_asks_for_a_window(spark):
    """Ninety places of one term ahead of the only place with both; and texts with hundreds of places, none left out."""
    text = "period " * 90 + "filler " * 90 + "orbital period"
    (r,) = evidence.excerpts(asked(spark, [(1, 1, "d", 2, "orbital period", text)])).collect()
    assert r.term_hits == 2 and r.quote == text[r.start_offset : r.end_offset] and r.quote.endswith("orbital period")
    rng, late = random.Random(21), 0
    for _ in range(100):
        words = [rng.choice(["alpha", "alpha", "filler", "alphabet", "x\n", "end. ", "of"]) for _ in range(600)]
        for rare in ("beta", "gamma", "delta"):
            words[rng.randrange(600)] = rare
        text, terms = " ".join(words), frozenset(["alpha", "beta", "gamma", "delta", "bet"])
        places = [0] + [m.start() for m in re.finditer("[a-z0-9]{3,}", text) if m[0] in terms]
        windows = [evidence.Passage(text).window(at) for at in places]
        scores = [(-len(terms & set(re.findall("[a-z0-9]{3,}", text[a:b]))), a, b) for a, b in windows]
        hits, a, b = min(scores)
        assert len(places) > 100 and evidence.Passage(text).best(terms) == (a, b, -hits)
        late += min(scores[:65])[0] > hits
    assert late > 20


def test_excerpts_come_from_distinct_pages(spark):
    rows = [(1, 1, "d", 1, "orbital period", "the orbital period"), (1, 2, "d", 1, "orbital period", "orbital period again"), (1, 3, "d", 2, "orbital period", "nothing here"), (1, 4, "e", 1, "orbital period", "period of orbital motion and period"), (1, 6, "f", 1, "orbital period", "orbital period")]
    related = evidence.related_excerpts(asked(spark, rows)).orderBy("position").collect()
    assert [(r.document, r.page, r["rank"]) for r in related] == [("d", 1, 1), ("d", 2, 3)]
    first = evidence.source_first_excerpts(asked(spark, rows)).orderBy("position").collect()
    assert [(r.document, r["rank"], r.term_hits) for r in first] == [("d", 1, 2), ("e", 4, 2)]


def test_excerpts_of_twenty_candidates_with_texts(spark, tmp_path):
    """Thirty nearest vectors without a text take no place of the twenty; a question is its own document's though 25 copies of its vector stand ahead."""
    sf = str(tmp_path)
    towards = lambda i: [1.0, i / 100]
    near = [(0, towards(0)), *[(i, towards(1)) for i in range(1, 31)], *[(i, towards(2)) for i in range(31, 61)]]
    copies = [*[(i, [-1.0, 0.0]) for i in range(70, 95)], (100, [-1.0, 0.0])]
    spark.createDataFrame([(i, v, 0) for i, v in [*near, *copies]], "vec_id long, embedding array<float>, label int").write.parquet(f"{sf}/embeddings.parquet")
    texts = [(i, "solar wind\nthe solar wind" if i == 0 else "lunar tide\nat last" if i == 100 else f"text {i}\nlunar tide and solar wind") for i in [0, *range(31, 61), *range(70, 95), 100]]
    spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    rows = plans.best_excerpt_window(spark, sf).collect()
    assert sorted((r.query_id, r["rank"], r.page) for r in rows) == [(0, 1, 0), *[(0, i + 2, 31 + i) for i in range(19)], *[(100, i + 1, 70 + i) for i in range(20)]]
    assert all(r.term_hits == 2 for r in rows)


def test_similar_sets_against_all_pairs(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("ab"), " ".join(rng.choice("abcdefghij") * 2 for _ in range(rng.randint(0, 9)))) for i in range(80)] + [(90, "a", None)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    sets = {i: (g, frozenset((t or "").split())) for i, g, t in rows}
    own = {i: min(j for j in sets if sets[j] == sets[i]) for i in sets}
    for contained in (False, True):
        got = {r.doc_id: (r.class_id, r.links) for r in retrieval.similar_sets(df, "doc_id", ["lang"], "text", 0.6, contained).collect()}
        for i in sets:
            g, x = sets[own[i]]
            like = [j for j in set(own.values()) if j != own[i] and sets[j][0] == g and x and sets[j][1] and 10 * len(x & sets[j][1]) >= 6 * (min(len(x), len(sets[j][1])) if contained else len(x | sets[j][1]))]
            assert got[i] == (own[i], len(like)), i


def test_followups(spark):
    rows = [(1, 0, "user", "Tell me about NASA missions please"), (1, 1, "assistant", "ok"), (1, 2, "user", "what is it"), (1, 3, "user", "how does rocket propulsion work")]
    got = {r.turn: r.query for r in evidence.followups(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[2] == "NASA" and got[3] == "how does rocket propulsion work"


def test_progress_percentages(spark):
    state = [Row(user_id=1, card=f"c{i}", status="learning", n_correct=int(i == 0), n_incorrect=2 if i == 0 else 1) for i in range(10)]
    (r,) = study.set_progress(spark.createDataFrame(state), 10).collect()
    assert (r.progress_percentage, r.accuracy_percentage, r.completion_percentage) == (10.0, 8.3, 100.0)


def test_blocks_round_trip_and_range(spark):
    text = "".join(chr(97 + i % 26) for i in range(1000))
    stored = blocks.store(spark.createDataFrame([(1, text), (2, "é" * 5)], "doc_id long, text string"), blocks.DEMO_KEY, 64)
    assert {r.doc_id: r.n_bytes for r in blocks.verify(stored, blocks.DEMO_KEY).collect()} == {1: 1000, 2: 10}
    part = {r.doc_id: bytes(r.body) for r in blocks.read_range(stored, blocks.DEMO_KEY, 64, 100, 299).collect()}
    assert part[1].decode() == text[100:300]
    wrong = blocks.verify(stored, "another key 1234").where("n_bytes > 0")
    assert wrong.count() == 0


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    batch = {(r.user_id, r.card): (r.interval_days, r.ease, r.n_correct, r.n_incorrect) for r in study.progress(study.attempts(events)).collect()}
    rows = learner.drain(learner.learner_state(learner.event_stream(spark, SF)), "update", str(tmp_path)).collect()
    assert {(r.user_id, r.card): (r.interval_days, r.ease, r.n_correct, r.n_incorrect) for r in rows} == batch


def test_nearest_rank():
    assert evaluation.nearest_rank_p95([]) == 0.0
    assert evaluation.nearest_rank_p95(list(range(1, 101))) == 95


def test_evidence_form_is_pythons(spark):
    """Every character of the basic plane, and a few texts, as NFKC, case folding and split() have them."""
    # characters that this Python doesn't know yet have no form to compare
    plane = [chr(c) for c in range(1, 0x10000) if not 0xD800 <= c <= 0xDFFF and unicodedata.category(chr(c)) != "Cn"]
    texts = ["a" + c + "B" for c in plane] + ["", "  ", "ﬁne ＷＩＤＥ Straße ", "é ½ \x1f x\u0085y"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.n for r in df.select("i", tx.normalize_evidence(F.col("t")).alias("n")).collect()}
    want = {i: " ".join(unicodedata.normalize("NFKC", t).split()).casefold() for i, t in enumerate(texts)}
    assert {texts[i] for i in want if got[i] != want[i]} == set()


def test_options_are_compared_in_the_same_form(spark):
    card = Row(question="What  is ＮＦＫＣ", answer="form", options=["x", "what is nfkc "], quote="a form", source="it is a form")
    assert evidence.grounding(spark.createDataFrame([card])).first().rejection == "option_matches_question"


def test_question_forms(spark):
    asked = {
        "What does BLEU stand for?": ("acronym", "BLEU", "", "", []),
        "How does the valve open when it is cold and if it is wet?": ("mechanism", "valve", "when it is cold and if it is wet", "", ["when it is cold", "if it is wet"]),
        "In dry air, why does a pump stop?": None,
        "In dry air, why does a pump release heat?": ("reason", "pump", "heat", "dry air", []),
        "What is the definition of heat?": None,
        "What is heat and why is it hot?": None,
        "": None,
    }
    got = questions.with_roles(spark.createDataFrame([(q,) for q in [*asked, None]], "q string"), "q", "r").collect()
    assert {r.q: r.r and (r.r.relation, r.r.entity, r.r.tail, r.r.domain, r.r.conditions) for r in got} == asked | {None: None}


def test_queries_behind_pronouns(spark):
    turns = ["Define BLEU.", "How does it compare to ROUGE?", "What is photosynthesis in leaves", "Why does it need light?", "Compare two forests", "How do they grow?", "What do these slides say about forest growth?", None]
    df = spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(turns)], "c int, turn int, role string, text string")
    got = {r.turn: (r.strict_query, r.wide_query) for r in questions.navigation_queries(df, ["c"], "turn").collect()}
    assert got[1][0] == "BLEU How does it compare to ROUGE?"
    assert got[3][0] == "photosynthesis in leaves Why does it need light?"
    assert got[5] == (None, None)
    assert got[6] == (None, turns[6]) and 7 not in got


def test_quotes_are_located(spark):
    page = "one  two\n(three) \\E four " + "x" * 2000 + " end of it"
    quotes = {"two (three) \\E four": (5, 24), "one  two": (0, 8), "absent": (None, None), "": (None, None), " ": (3, 4), "end of it": (len(page) - 9, len(page)), "y" * 481: (None, None)}
    found = evidence.contexts(evidence.locate(spark.createDataFrame([(page, q) for q in quotes], "page string, quote string"))).collect()
    assert {r.quote: (r.start_offset, r.end_offset) for r in found if r.quote != " "} == {q: v for q, v in quotes.items() if q != " "}
    last = next(r for r in found if r.quote == "end of it")
    assert (last.context_start, last.context_end) == (len(page) - 169, len(page))
    assert next(r for r in found if r.quote == "one  two").context_end == 1200


def test_verdicts(spark):
    page = lambda i, label="direct", cue=True: {"id": i, "usefulness": label, "cue_locates": cue}
    said = lambda *pages, status="clear": json.dumps({"question_status": status, "pages": pages})
    cases = [
        (said(page("a", "concrete_learning_step"), page("b")), ("clear", ["b", "a"], 0)),
        (said(page("b", "unrelated"), page("a", cue=False)), ("clear", [], 1)),
        (said(page("a"), page("a")), ("page_id_invalid", [], 0)),
        (said(page("a"), page("b"), status="needs_clarification"), ("clarification_qualified_page", [], 0)),
        (said(page("a"), page("b", cue=1)), ("cue_verdict_invalid", [], 0)),
        (said(page("a"), {"id": "b"}), ("page_verdict_fields_invalid", [], 0)),
        ("[]", ("verdict_fields_invalid", [], 0)),
        ("{", ("verdict_json_invalid", [], 0)),
        (None, ("verdict_oversize", [], 0)),
        (said(page("a"), page("b"), status="unclear"), ("question_status_invalid", [], 0)),
        (said(page("a"), page("b"), status=1), ("question_status_invalid", [], 0)),
        (said(page("a"), page("b")).replace('"clear"', "null"), ("question_status_invalid", [], 0)),
        (said(page("a")), ("verdict_count_invalid", [], 0)),
        ('{"question_status": "clear", "pages": "ab"}', ("verdict_count_invalid", [], 0)),
        ('{"question_status": "clear", "pages": [], "more": 1}', ("verdict_fields_invalid", [], 0)),
        (said(page("a"), page("b")) + " {}", ("verdict_json_invalid", [], 0)),
        (said(page("a"), page("b")) + ", 1", ("verdict_json_invalid", [], 0)),
        (" ", ("verdict_json_invalid", [], 0)),
        ("{'question_status': 'clear'}", ("verdict_json_invalid", [], 0)),
        ('{"question_status": "clear", "pages": [{"id": "a", "id": "b"}]}', ("duplicate_json_key", [], 0)),
        ('{"question_status": "clear", "pages": [NaN]}', ("nonfinite_json", [], 0)),
        (said(page("a"), 7), ("page_verdict_fields_invalid", [], 0)),
        (said(page("a"), page("c")), ("page_id_invalid", [], 0)),
        (said(page("a"), page(2)), ("page_id_invalid", [], 0)),
        (said(page("a"), page("b", "useful")), ("usefulness_invalid", [], 0)),
        (said(page("a"), page("b", None)), ("usefulness_invalid", [], 0)),
        (said(page("a"), page("b", cue="true")), ("cue_verdict_invalid", [], 0)),
        (said(page("a", cue=None), page("c")), ("cue_verdict_invalid", [], 0)),
        (said(page("b", "topic_only"), page("a", "uncertain"), status="needs_clarification"), ("needs_clarification", [], 2)),
        (said(page("a"), page("b")) + " " * 2048, ("verdict_oversize", [], 0)),
    ]
    df = spark.createDataFrame([(i, raw, ["a", "b"]) for i, (raw, _) in enumerate(cases)], "i int, raw string, issued array<string>")
    got = {r.i: (r.outcome, r.chosen, r.dropped) for r in questions.verdicts(df).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}


def test_a_verdict_is_read_once(spark):
    """Fields of the whole and of a page are taken out once, not once for every use of them."""
    answers = spark.createDataFrame([("{}", ["a"])], "raw string, issued array<string>")
    told = questions.verdicts(answers)._jdf.queryExecution().optimizedPlan().toString()
    assert told.count("MapType") == 2

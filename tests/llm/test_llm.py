"""Each operator on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, further columns."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.llm import dedup, names, neighbours, packing, registry, scans, survivors, tokens, toxicity, tries, truncation

FACTS = "seq long, subject string, predicate string, object string, salt int, k1 string, n int"


# --- 1


def test_survivors(spark):
    ts = "2024-01-0{} 00:00:00"
    kind = "seq long, value string, source_ref string, confidence double, source_id string, extracted_at string, trust string"
    rows = [
        (1, "12", "[Chunk a]", 0.5, "low", ts.format(1), "x"), (2, "about 13 m", "[Chunk zz]", 0.9, "high", ts.format(1), None), (3, "see note 4", "[chunk  a ]", 7.0, "high", ts.format(2), None),
        (4, None, None, float("nan"), None, None, None), (5, "5", None, 0.5, "none", ts.format(1), None), (6, "5", None, 0.5, "none", ts.format(1), None), (7, "(4.1)", "[Chunk ]", None, "gone", None, None),
    ]
    facts = spark.createDataFrame(rows, kind).withColumn("extracted_at", F.col("extracted_at").cast("timestamp"))
    groups = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (1, 3), (2, 4), (3, 6), (3, 5), (4, 7), (5, 99), (None, 1)], "group_id long, seq long")
    sources = spark.createDataFrame([("low", 1, 0), ("high", 5, 0), ("none", None, 0)], "source_id string, trust int, value int")
    chunks = spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "chunk_id string, seq int")
    got = {(r[0], r[1]): r[2] for r in survivors.surviving_fields(facts, groups, sources, chunks).collect()}
    assert got == {(1, "value"): 2, (1, "confidence"): 2, (1, "source_ref"): 3, (3, "value"): 5, (3, "confidence"): 5, (4, "value"): 7}
    records = {r["group_id"]: tuple(r)[1:] for r in survivors.surviving_records(facts, groups, sources, chunks).collect()}
    assert records == {1: ("about 13 m", "[chunk  a ]", 0.9, 2, 3, 2), 3: ("5", None, 0.5, 5, None, 5), 4: ("(4.1)", None, None, 7, None, None)}
    assert survivors.surviving_records(facts.limit(0), groups, sources, chunks).count() == 0
    assert survivors.surviving_fields(facts.limit(0), groups, sources, chunks).count() == 0
    assert survivors.surviving_fields(facts, groups.limit(0), sources.limit(0), chunks.limit(0)).count() == 0


# --- 6


def test_canonical(spark):
    def same(*texts):
        df = spark.createDataFrame([(t,) for t in texts], "x string")
        return len({r[0] for r in df.select(dedup.canonical_listing(F.col("x"))).collect()}) == 1

    assert same("Acme Ltd", " acme   LTD. ", "<Acme - Ltd>", "“ac​me ltd”", "A-C-M-E ltd!")
    assert same("area: X; berth: 5; from: Y", "BERTH: 5 | From: y | area: x!", "from: Y / area: X / berth: 5")
    assert not same("from: X; to: Y", "from: Y; to: X")
    assert same("1,234.5 EUR", "1234.5 eur")
    for a, b in (("-5 EUR", "5 EUR"), ("1.5", "15"), ("5%", "5"), ("5 €", "5"), ("1e-5", "1e5"), ("12,5", "125"), ("(4.06)", "4.06"), ("5‰", "5%")):
        assert not same(a, b), (a, b)
    assert same("−5", "-5") and same("ref-5", "ref 5") and same("in (2014)", "in 2014")


def test_formatting_duplicates(spark):
    rows = [(i, "Hot Key", "P!", "o", 0, "", 0) for i in range(300, 0, -1)] + [(1000, "A", "b", "C", 0, "", 0), (1001, "a.", "B", "c", 0, "", 0), (1002, None, "b", "c", 0, "", 0), (1003, None, "b", "c", 0, "", 0)]
    rows += [(1004, "N/A", "b", "c", 0, "", 0), (1005, "n/a", "b", "c", 0, "", 0), (1006, "x" * 100_000, "b", "c", 0, "", 0), (1007, "X" * 100_000, "b", "c", 0, "", 0), (1008, "solo", "b", "c", 0, "", 0)]
    df = spark.createDataFrame(rows, FACTS).repartition(3)
    want = {(1, 300), (1000, 2), (1006, 2)}
    for share in (0.002, 0.5, 1.0):
        assert {tuple(r) for r in dedup.formatting_duplicates(df, share).collect()} == want
    assert dedup.formatting_duplicates(df.limit(0)).count() == 0
    keyed = dedup.keyed(df)
    hot = dedup.hot_keys(keyed, 0.4, keyed.count())
    assert hot.count() == 1


# --- 8 and 9


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(tokens.perfect_hash(tokens.TOKENIZER))


def reference(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.TOKENIZER.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def test_perfect_hash_is_minimal_and_exact():
    values = {str(i).encode(): i for i in range(5000)}
    h = tokens.PerfectHash(values)
    assert all(h.get(k) == v for k, v in values.items()) and None not in h.keys and len(h.keys) == 5000
    assert h.get(b"absent") == -1 and tokens.PerfectHash({}).get(b"x") == -1


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_encoder_equals_the_library(text):
    e = tokens.Encoder(tokens.perfect_hash(tokens.TOKENIZER))
    assert e.encode(text) == reference([text])[0]


def test_encoder_hard_cases(encoder):
    texts = ["<|endoftext|>", "a" * 3000, "don't WE'LL  x\n\n\ty ", "é" * 99, "日本語 テスト 👩‍👩‍👧", "​ ­", "x" * 500 + " 1234567890" * 50, "zqxj" * 400]
    assert [encoder.encode(t) for t in texts] == reference(texts)


def test_token_ids(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "Hello world", 1), (3, "Hello world", 1), (4, " \n", 2), (None, "x", 1)], "doc_id long, text string, ids int")
    got = [(r[0], r[1]) for r in tokens.token_ids(df).collect()]
    assert sorted(got, key=str) == sorted([(1, []), (2, []), (3, [15496, 995]), (3, [15496, 995]), (4, reference([" \n"])[0]), (None, [87])], key=str)
    assert tokens.token_ids(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=120))
def test_sum_of_squares_packs_validly(sizes):
    where, used = packing.sum_of_squares(np.array(sizes, np.int64), 50)
    room = Counter()
    for s, b in zip(sizes, where):
        room[b] += s
    assert all(v <= 50 for v in room.values()) and sorted(room.values()) == sorted(used.tolist())
    assert len(used) <= 2 * -(-sum(sizes) // 50) + 1


def test_containers(spark):
    rng = random.Random(4)
    sizes = [(i, int(rng.lognormvariate(3, 1))) for i in range(3000)] + [(9000, 0), (9001, None), (9002, 450), (9003, 200), (9003, 200), (9004, 300)]
    df = spark.createDataFrame(sizes, "doc_id long, tokens long")
    for per_task in (100_000, 400):
        rows = packing.fill_containers(df, 200, per_task).collect()
        room, pieces = Counter(), Counter()
        for r in rows:
            room[r["container"]] += r["tokens"]
            pieces[r["doc_id"]] += 1
        assert max(room.values()) <= 200 and sum(room.values()) == sum(n or 0 for _, n in sizes)
        assert pieces[9002] == 3 and pieces[9003] == 2 and pieces[9004] == 2 and pieces[9000] == pieces[9001] == 0
        assert all(n == 1 for d, n in pieces.items() if d < 9000 and dict(sizes)[d] <= 200)
        assert len(room) <= 1.03 * sum(room.values()) / 200 + 1
    assert packing.fill_containers(df.limit(0), 200).count() == 0


# --- 4


def brute(rows, k):
    ok = [(p, np.array(v, float)) for p, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ok = sorted({p: v for p, v in ok}.items())
    pos, x = [p for p, _ in ok], np.array([v / np.linalg.norm(v) for _, v in ok])
    s = np.round(x @ x.T, 9)
    return {(p, pos[j]) for i, p in enumerate(pos) for j in [j for j in np.lexsort((pos, -s[i])) if j != i][:k]}


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 64))
    rows = [(i, (centres[i % 40] + 0.3 * rng.normal(size=64)).astype(np.float32).tolist()) for i in range(900)]
    rows += [(2000 + i, (np.array(rows[0][1]) * (i + 1)).astype(np.float32).tolist()) for i in range(30)]  # equal but for length
    rows += [(3000, None), (3001, [0.0] * 64), (3002, [1.0] * 32), (3003, [float("nan")] * 64), (3004, [1.0] * 63 + [None]), rows[5]]
    df = spark.createDataFrame([(p, v, 0) for p, v in rows], "pos long, embedding array<float>, rep int")
    got = {(r["pos"], r["neighbour"]) for r in neighbours.nearest_neighbours(df).collect()}
    want = brute(rows, 10)
    assert len(got & want) >= 0.97 * len(want) and len(got) == len(want)
    pairs = neighbours.neighbour_pairs(neighbours.nearest_neighbours(df.where("pos < 3")))
    assert {tuple(r) for r in pairs.collect()} == {(0, 1), (0, 2), (1, 2)}
    assert neighbours.nearest_neighbours(df.where("pos >= 3000")).count() == 0


def test_multi_sequence_order():
    rng = np.random.default_rng(2)
    a, b, counts = rng.random(9), rng.random(9), rng.integers(0, 3, 81)
    order = neighbours.cells_in_order(a, b, counts, 10**9)
    sums = [a[c // 9] + b[c % 9] for c in order]
    assert sums == sorted(sums) and set(order) == set(np.flatnonzero(counts))


# --- 3


def osa(a, b):
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=7), min_size=1, max_size=25), st.text("abc", min_size=1, max_size=7))
def test_trie_finds_all_neighbours(words, asked):
    trie = tries.Trie(words)
    for bound in (0, 1, 2):
        assert dict(trie.near(asked, bound)) == {w: osa(asked, w) for w in words if osa(asked, w) <= bound}


def test_entities(spark):
    one = ["Margaret Noratovbirone", "noratovbirone, Margaret", "Maggie Noratovbirone", "M. Noratovbirone", "Margaret Noratovbirne", "Dr Margaret NORATOVBIRONE"]
    two = ["Kosbirnalyki Distribution Inc", "Kosbirnalyki Distr. Inc", "kosbirnalyki distribution", "Distribution Kosbirnalyki, Inc", "Kobsirnalyki Distribution Incorporated", "The Kosbirnalyki Distribution Group"]
    three = ["Kosbirnalyki Manufacturing Inc", "Kosbirnalyki Mfg Inc"]
    four = ["Robert Noratovbirone", "Bob Noratovbirone"]
    other = ["Ummeland", None, "", "12.5 m EUR", "x" * 30_000, "-"]
    df = spark.createDataFrame([(n, 1) for n in one + two + three + four + other + one], "name string, spelling int")
    given = spark.createDataFrame([("Margaret", "Maggie"), ("Robert", "Bob"), ("Matthew", "Matt"), (None, None)], "full_name string, short_name string")
    e = {r["spelling"]: r["entity"] for r in names.entity_spellings(df, given).collect()}
    key = lambda n: " ".join("".join(c if c.isalnum() else " " for c in n.lower()).split())
    groups = [{e[key(n)] for n in g} for g in (one, two, three, four)]
    assert all(len(g) == 1 for g in groups) and len(set().union(*groups)) == 4
    pairs = names.spelling_pairs(names.entity_spellings(df.where(F.col("name").isin(three)), given)).collect()
    assert [tuple(r) for r in pairs] == [("kosbirnalyki manufacturing inc", "kosbirnalyki mfg inc")]
    assert names.entity_spellings(df.limit(0), given).count() == 0


def test_copies_of_pages_have_the_noise_of_the_pages(spark):
    body = ["The harbour tariff was raised again\nby the board of the port.", "No new berths were built that year\nand none were planned.", "Tribunal orders were read aloud\nbefore the committee met.", "Freight fell in the second half\nof the long winter season."]
    texts = ["Harbour Review Quarterly | 3\n" + b if i < 2 else b for i, b in enumerate(body)]
    schema = "track string, chunk_id string, source_id string, page_or_doc_idx int, char_start int, char_end int, text string"
    made = lambda k: spark.createDataFrame([("retrieval", f"c{p}-{i}", "s", p + 100 * i, 0, len(t), t) for i in range(k) for p, t in enumerate(texts)], schema)
    one = {tuple(r) for r in scans.page_noise(made(1)).collect()}
    assert one == {("c0-0", "line", "1"), ("c1-0", "line", "1")}
    many = {tuple(r) for r in scans.page_noise(made(5)).collect()}
    assert many == {(c.replace("-0", f"-{i}"), kind, item) for c, kind, item in one for i in range(5)}


def test_names_with_numbers_are_read(spark):
    given = spark.createDataFrame([("Margaret", "Meg")], "full_name string, short_name string")
    one = ["Studio 54 Logistics Ltd", "studio 54 logistics", "Studio 54 Logistcs", "54 Studio Logistics plc"]
    two, three = ["Studio 55 Logistics", "STUDIO-55 LOGISTICS LTD"], ["7 Harbours Group", "The 7 Harbours Group", "7 Harbuors Group"]
    none = ["8593700 lbs", "6331 t", "48.2", "area estwick berth 5 segment insurance", "berth 5 area estwick segment insurance", "EUR 12 million", "12 million EUR"]
    df = spark.createDataFrame([(n,) for n in one + two + three + none], "name string")
    got = {tuple(r) for r in names.spelling_pairs(names.entity_spellings(df, given)).collect()}
    low = lambda xs: sorted({" ".join(n.lower().replace("-", " ").split()) for n in xs})
    assert got == {(a, b) for same in (one, two, three) for a in low(same) for b in low(same) if a < b}


def test_hot_keys_are_exact(spark):
    """A key with just the share counts, one with a row less doesn't, however the rows are spread."""
    rows = [(1, 1)] * 100 + [(2, 2)] * 99 + [(i, i) for i in range(10, 811)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k1 long, k2 long")
    for parts in (1, 5, 40):
        assert [tuple(r) for r in dedup.hot_keys(df.repartition(parts), 0.1, 1000).collect()] == [(1, 1)]
    assert dedup.hot_keys(df.limit(0), 0.1, 0).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (100, 101)], "a long, b long")
    assert {r["label"] for r in names.components(links).where("id < 50").collect()} == {1} and names.components(links).count() == 42


# --- 7


def test_cut_texts(spark):
    s = ["The tribunal ordered the company to compensate growers whose goods had spoiled.", "Minutes of the previous meeting were approved without amendment.", "The laboratory measured sulphur content and found no breach of the limit."]
    rng = random.Random(1)
    whole = [" ".join(rng.choices(s, k=4)) for _ in range(60)] + ['{"facts": [{"subject": "Ann Lee", "confidence": 0.62}]}'] * 20 + ['{"facts": [{"subject": "Ann Lee", "confidence": 0.62},]}'] * 5
    rows = [(i, f"s{i % 3}", t) for i, t in enumerate(whole)]
    cut = [whole[0][: len(s[0]) + 20], "Minutes of the previous meeting were appr", '{"facts": [{"subject": "Ann Lee", "confid', '{"facts": [{"subject": "Ann', "The laboratory measured sulphur content and found no breach of the"]
    rows += [(1000 + i, "s0", t) for i, t in enumerate(cut)]
    fine = [None, "", "  ", "[ERROR] model timeout after 80 s", s[0][:-1], s[1] * 2000]
    rows += [(2000 + i, None, t) for i, t in enumerate(fine)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "entry_id long, source_id string, value string, words int")
    assert {r["entry_id"] for r in truncation.cut_texts(df).where("is_cut").collect()} == {1000 + i for i in range(len(cut))}
    shares = {r["source_id"]: (r["entries"], r["cut_entries"]) for r in truncation.cut_shares(df).collect()}
    assert shares["s0"][1] == 5 and shares[None] == (6, 0)
    assert truncation.cut_texts(df.limit(0)).count() == 0


# --- 2


PAGE = """Acme Annual Review 20{n} | {n}
The {a} committee noted that the inspec-
tion had levelled for the third quarter. A cross-
border review was c1osed in l996 and the temporary
clause expired. {b} vessels were in the harbour.
{extra}
{n}"""
WORDS = "amber birch copper denim ember fjord grain hazel ivory jade khaki lilac".split()


def test_page_noise(spark):
    rows = [("retrieval", "scan:a", i, f"r{i}", 0, 400, PAGE.format(n=10 + i, a=WORDS[i] * 3, b=WORDS[-i] * 3, extra=f"{WORDS[i] * 2} the inspection of a cross-border clause was closed on day {i + 1} of the temporary review.")) for i in range(12)]
    rows += [("retrieval", "scan:a", 0, "r0", 0, 400, rows[0][6]), ("retrieval", "scan:b", 0, "z", 0, 5, None), ("extraction", "scan:a", 0, None, 0, 9, "x"), ("extraction", None, None, "e", None, None, "tcmporary review"), ("retrieval", "web:c", 1, "long", 0, 9, "closed " * 30_000), ("retrieval", "web:c", 2, "empty", 0, 0, "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "track string, source_id string, page_or_doc_idx int, chunk_id string, char_start int, char_end int, text string, item int")
    got = [tuple(r) for r in scans.page_noise(df).collect()]
    assert len(got) == len(set(got))
    assert {(k, i) for c, k, i in got if c == "r3"} == {("line", "1"), ("line", "7"), ("word", "inspection"), ("word", "closed"), ("word", "1996")}
    assert [(k, i) for c, k, i in got if c == "e"] == [("word", "temporary")]
    assert not [c for c, _, _ in got if c in ("z", "long", "empty", None)]
    assert scans.page_noise(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("bad", "good", "weight"),
    [("percerit", "percent", 0.25), ("apperidix", "appendix", 0.25), ("coiild", "could", 0.25), ("thircl", "third", 0.25), ("pıe1iminary", "preliminary", 0.5), ("clemarid", "demand", 0.5), ("qrowtb", "growth", 0.5), ("5hiprnent", "shipment", 0.5), ("dosed", "closed", 0.25), ("flfet", "fleet", 1), ("form", "from", 1)],
)
def test_edit_weight(bad, good, weight):
    assert scans.edit_weight(bad, good) == weight


def noisy_pages(misread):
    """A hundred pages of the same few words, one of them with misread forms."""
    usual = "the captain reported that a fleet of seven vessels was closed for repairs in the harbour of\nthe quarterly review before the meeting"
    rows = [("retrieval", "scan:a", i, f"r{i}", 0, 400, usual) for i in range(120)] + [("retrieval", "scan:a", 200, "bad", 0, 400, misread)]
    return rows, "track string, source_id string, page_or_doc_idx int, chunk_id string, char_start int, char_end int, text string"


def test_misreadings_outside_the_confusions_are_found_by_edits(spark, monkeypatch):
    """A plain misreading that no confusion explains needs a bounded edit, and neighbours that speak for it."""
    df = spark.createDataFrame(*noisy_pages("the captzin reported that a flxet of seven vcssels was dosed for\nthe quartxrly review before the meeting xyzzy harbou"))
    found = {r["item"] for r in scans.page_noise(df).where("chunk_id = 'bad'").collect()}
    assert found == {"captain", "fleet", "vessels", "closed", "quarterly"}  # harbou is a piece of a word, xyzzy nothing
    join = scans.trie_join
    monkeypatch.setattr(scans, "trie_join", lambda w, a, *x: join(w, a.withColumn("bound", F.lit(0)), *x))
    assert {r["item"] for r in scans.page_noise(df).where("chunk_id = 'bad'").collect()} == {"vessels", "closed"}


def test_neighbours_decide_between_words(spark):
    pages = ["they paid the bill at once and left"] * 60 + ["he climbed the hill at dawn and left"] * 60
    rows = [("retrieval", "s", i, f"r{i}", 0, 9, t) for i, t in enumerate(pages)] + [("retrieval", "s", 500, "a", 0, 9, "they paid the b1ll at once"), ("retrieval", "s", 501, "b", 0, 9, "he climbed the 6ill at dawn")]
    df = spark.createDataFrame(rows, noisy_pages("")[1])
    assert {(r["chunk_id"], r["item"]) for r in scans.page_noise(df).collect()} == {("a", "bill"), ("b", "hill")}


def test_texts_are_repaired_and_reflowed(spark):
    rows = [("retrieval", "scan:a", i, f"r{i}", 0, 400, PAGE.format(n=10 + i, a=WORDS[i] * 3, b=WORDS[-i] * 3, extra=f"{WORDS[i] * 2} the inspection of a cross-border clause was closed on day {i + 1} of the temporary review.")) for i in range(12)]
    rows += [("retrieval", "scan:b", 0, "z", 0, 5, None), ("retrieval", "web:c", 2, "empty", 0, 0, " \n "), ("retrieval", "web:c", 3, "flow", 0, 9, "One line\nand more.\n\n2.1 Heading\nText goes\non.\nMargin  12  13")]
    df = spark.createDataFrame([(*r, 1) for r in rows], noisy_pages("")[1] + ", item int")
    got = {r["chunk_id"]: r["text"] for r in scans.repaired_texts(df).collect()}
    assert got["z"] is None and got["empty"] == "" and got["flow"] == "One line and more.\n\n2.1 Heading\n\nText goes on.\n\nMargin 12 13"
    text = got["r3"]
    assert "inspection" in text and "closed" in text and "1996" in text and "\n" not in text.replace("\n\n", "")
    assert not any(x in text for x in ("clcsed", "inspec-", "Annual Review"))
    assert scans.repaired_texts(df.limit(0)).count() == 0


# --- 10


@pytest.mark.parametrize(("text", "words"), [("You $tup1d b.i.t.c.h", ["you", "stupid", "bitch"]), ("i d i o t", ["idiot"]), ("stuuuupid ha​lfwit", ["stupid", "halfwit"]), ("b*****d 12", ["~b7d", "#"]), ("", [])])
def test_plain_words(text, words):
    assert toxicity.plain_words(text) == words


def test_review_scores(spark):
    rng = random.Random(2)
    clean = ["The committee approved the minutes of the meeting.", "Shipments through the harbour totalled 40 tonnes.", "A dumb terminal in the control room was replaced.", "The board postponed the dividend."]
    bad = {"abusive": "You are a worthless {} and everyone knows it.", "hateful": "All {} are vermin and must be driven out.", "sexual": "Send me {} pictures tonight, I want you naked."}
    fill = {"abusive": ["moron", "idiot", "jackass"], "hateful": ["Derrowites", "Ostrani"], "sexual": ["nude", "dirty"]}
    docs, labels = [], []
    for i in range(600):
        kind = rng.choice(["none"] * 4 + list(bad))
        parts = rng.choices(clean, k=3)
        if kind != "none":
            parts.insert(rng.randrange(4), bad[kind].format(rng.choice(fill[kind])))
        docs.append((i, " ".join(parts), f"s{i % 2}", kind))
        if i < 300:
            labels.append((i, kind if rng.random() > 0.02 else "none"))
    extra = [(9001, None, None, "none"), (9002, "", "s0", "none"), (9003, "x " * 50_000, "s0", "none"), (9004, "YOU ARE A W.O.R.T.H.L.E.S.S M0R0N AND EVERYONE KNOWS IT.", "s1", "abusive"), (9004, "YOU ARE A W.O.R.T.H.L.E.S.S M0R0N AND EVERYONE KNOWS IT.", "s1", "abusive")]
    df = spark.createDataFrame([(d, t, s, 0) for d, t, s, _ in docs + extra], "doc_id long, text string, source string, label int")
    lab = spark.createDataFrame(labels + [(1, "none"), (None, None)], "doc_id long, label string")
    scores = toxicity.review_scores(df, lab)
    got = {r["doc_id"]: r["category"] or "none" for r in scores.collect()}
    held_out = [(d, k) for d, _, _, k in docs if d >= 300] + [(d, k) for d, _, _, k in extra]
    assert sum(got[d] == k for d, k in held_out) >= 0.97 * len(held_out)
    assert scores.count() == len(docs) + len(extra)
    rates = {r["source"]: r for r in toxicity.source_rates(scores).collect()}
    assert rates["s0"]["found"] > 0 and rates[None]["rate"] == 0
    assert toxicity.review_scores(df, lab.limit(0)).where("category is not null").count() == 0
    assert toxicity.review_scores(df.limit(0), lab).count() == 0


def test_unlabelled_risk_is_kept_from_going_below_zero():
    x = toxicity.Rows([[1, 3]] * 5 + [[2, 3]] * 40)
    positive, unlabelled, prior = np.array([1.0] * 5 + [0.0] * 40)[:, None], np.array([0.0] * 5 + [1.0] * 40), np.array([0.5])
    risk = lambda s: np.logaddexp(0, s)[5:].mean() - 0.5 * np.logaddexp(0, s)[:5].mean()
    w, bias, acted = toxicity.fit_nnpu(x, positive, unlabelled, prior)
    s = x.scores(w, bias)[:, 0]
    w, bias, never = toxicity.fit_nnpu(x, positive, unlabelled, prior, clamp=False)
    assert acted > 0 and never == 0 and s[0] > s[-1]
    assert risk(s) > -0.5 > risk(x.scores(w, bias)[:, 0])  # without the bound it falls on and on
    same = toxicity.fit_nnpu(x, positive, np.ones(45), prior)
    assert not np.allclose(x.scores(*same[:2])[:, 0], s)


def test_threshold_is_chosen_by_held_out_labels():
    rng = random.Random(3)
    fine = ["The board postponed the dividend.", "Shipments totalled 40 tonnes.", "The minutes were approved."]
    texts = [f"{rng.choice(fine)} {rng.choice(fine)} {i}" + (" You are a worthless moron and everyone knows it." if i % 3 == 0 else "") for i in range(1500)]
    labels = ["abusive" if i % 3 == 0 else "none" for i in range(1500)]
    model, threshold = toxicity.Model.calibrated(texts, labels, texts[700:], 0.2)
    found = model.score(texts).max(axis=1) >= threshold
    assert threshold != 0.2 and np.mean(found == (np.array(labels) != "none")) > 0.99
    assert toxicity.Model.calibrated(texts[:30], labels[:30], texts, 0.2)[1] == 0.2


def test_reviewed_documents_are_no_negative_rows():
    bad, fine = "You are a worthless moron and everyone knows it.", "The board postponed the dividend."
    texts, labels, others = [bad] * 6 + [fine] * 6, ["abusive"] * 6 + ["none"] * 6, [fine] * 30 + [bad]
    a = toxicity.Model.fit(texts, labels, others)
    b = toxicity.Model.fit(texts + [bad] * 6, labels + ["none"] * 6, others)  # missed by the review
    np.testing.assert_allclose(a.score([bad, fine]), b.score([bad, fine]))


# --- all


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_queries_run(spark, small, name):
    df = registry.queries()[name](spark, small)
    rows = df.collect()
    if name.endswith("_found"):
        assert len(rows) == len(set(rows))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, small, name):
    import duckdb

    c = duckdb.connect()
    for t in ("facts", "fact_groups", "source_list", "chunks", "index_vectors"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    want = sorted(c.execute(registry.oracle_sql()[name]).fetchall())
    assert sorted(map(tuple, registry.queries()[name](spark, small).collect())) == want

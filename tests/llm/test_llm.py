import cProfile
import itertools
import random
import re
import string

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loamstone.llm import encoding, leakage, near_duplicates, packing, pairs, personal, scans, shared_spans, splitting
from loamstone.llm.winnow import Winnower

# ---- spans ---------------------------------------------------------------------------------------------


def words(r, n, vocab=400):
    return " ".join(f"w{r.randrange(vocab)}" for _ in range(n))


def brute_spans(docs, run):
    grams = {k: {t[i : i + run] for i in range(len(t) - run + 1)} for k, t in docs.items() if t}
    return {(a, b) for a, b in itertools.combinations(sorted(grams), 2) if grams[a] & grams[b]}


@pytest.mark.parametrize("hot,local", [(64, 32), (2, 3)])
def test_shared_spans_against_brute(spark, monkeypatch, hot, local):
    monkeypatch.setattr(shared_spans, "HOT", hot)
    monkeypatch.setattr(shared_spans, "LOCAL_HOT", local)
    r = random.Random(4)
    passages = [words(r, 90), "é" * 60 + words(r, 60) + "ß漢字" * 30]
    docs = {}
    for i in range(40):
        t = words(r, r.randint(0, 120))
        if r.random() < 0.6:
            p = r.choice(passages)
            a = r.randint(0, 60)
            k = r.choice([298, 299, 300, 301, 420])
            at = r.randint(0, len(t))
            t = t[:at] + p[a : a + k] + t[at:]
        docs[i] = t
    docs |= {40: None, 41: "", 42: docs[0], 43: "a" * 2000, 44: "a" * 299, 45: "b" + "a" * 310}
    rows = list(docs.items()) + [(0, docs[0])]
    df = spark.createDataFrame(rows, "id long, text string").withColumn("doc", F.lit(1)).withColumn("h", F.lit("x"))
    got = {tuple(x) for x in shared_spans.shared_pairs(df, "id", "text").collect()}
    assert got == brute_spans(docs, 300)


def test_many_copies(spark):
    r = random.Random(8)
    text = words(r, 150)
    docs = [(i, text if i < 90 else words(r, 20) + text[100:460] if i < 130 else words(r, 150)) for i in range(150)]
    got = {tuple(x) for x in shared_spans.shared_pairs(spark.createDataFrame(docs, "id long, text string"), "id", "text").collect()}
    assert got == {(a, b) for a, b in itertools.combinations(range(130), 2)}


def test_hot_groups_delivered_twice(spark):
    r = random.Random(9)
    passages = [words(r, 90), words(r, 90)]
    docs = [(i, words(r, 20) + passages[i // 70] + words(r, 20)) for i in range(140)]
    got = {tuple(x) for x in shared_spans.shared_pairs(spark.createDataFrame(docs * 2, "id long, text string"), "id", "text").collect()}
    assert got == {(a, b) for a, b in itertools.combinations(range(140), 2) if a // 70 == b // 70}


def test_hot_passage_quoted_before(spark):
    r = random.Random(10)
    letters = lambda n: "".join(r.choice(string.ascii_letters + "é") for _ in range(n))
    passage = letters(300)
    docs = {i: letters(150) + (passage[:298] + letters(150) if i % 2 else "") + passage + letters(50) for i in range(80)}
    got = {tuple(x) for x in shared_spans.shared_pairs(spark.createDataFrame(list(docs.items()), "id long, text string"), "id", "text").collect()}
    assert got == brute_spans(docs, 300) == set(itertools.combinations(range(80), 2))


def brute_portion(docs, run):
    at = {}
    for k, t in docs.items():
        for i in range(len(t or "") - run + 1):
            at.setdefault(t[i : i + run], {}).setdefault(k, []).append(i)
    out = {k: (set(), set()) for k in docs}
    for holders in at.values():
        if len(holders) > 1:
            for k, places in holders.items():
                for i in places:
                    out[k][0].update(range(i, i + run))
                    if min(holders) < k:
                        out[k][1].update(range(i, i + run))
    return {k: (len(a), len(b)) for k, (a, b) in out.items()}


def test_shared_portion(spark):
    p = "".join(random.Random(1).choice(string.ascii_letters) for _ in range(400))
    df = spark.createDataFrame([(1, "x" * 100 + p), (2, p + "y" * 50), (3, "short"), (4, None)], "id long, text string")
    got = {r.id: (r.shared_chars, r.kept_elsewhere, r.n_stretches) for r in shared_spans.shared_portion(df, "id", "text").collect()}
    assert got == {1: (400, 0, 1), 2: (400, 400, 1), 3: (0, 0, 0), 4: (0, 0, 0)}
    assert {(r.doc, r.start, r.stop, r.n_docs) for r in shared_spans.shared_spans(df, "id", "text").collect()} == {(1, 100, 500, 2), (2, 0, 400, 2)}
    assert shared_spans.shared_pairs(df.limit(0), "id", "text").count() == 0


@pytest.mark.parametrize("hot,local,batch", [(64, 32, 10000), (2, 1000, 5), (5, 4, 7), (1, 1, 3)])
def test_runs_around_later_places_of_hot_units(spark, monkeypatch, request, hot, local, batch):
    """120 records with one passage; runs around its second place are shared by few."""
    monkeypatch.setattr(shared_spans, "HOT", hot)
    monkeypatch.setattr(shared_spans, "LOCAL_HOT", local)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch"))
    r = random.Random(11)
    letters = lambda n: "".join(r.choice(string.ascii_letters) for _ in range(n))
    passage = letters(220)
    around = [(letters(50), letters(60)) for _ in range(12)]
    docs = {}
    for i in range(120):
        left, right = around[i // 2] if i < 24 else (letters(50), letters(60))
        docs[i] = letters(40) + passage + letters(90) + left + passage + right + (letters(20) if i % 3 else "é")
    df = spark.createDataFrame([*docs.items(), (5, docs[5])], "id long, text string")
    want = brute_spans(docs, 300)
    assert len(want) == 12
    assert {tuple(x) for x in shared_spans.shared_pairs(df, "id", "text").collect()} == want
    got = {x.id: (x.shared_chars, x.kept_elsewhere) for x in shared_spans.shared_portion(df, "id", "text").collect()}
    assert got == brute_portion(docs, 300)


@pytest.mark.parametrize("hot", [64, 3])
def test_spans_of_many_holders(spark, monkeypatch, hot):
    monkeypatch.setattr(shared_spans, "HOT", hot)
    r = random.Random(12)
    letters = lambda n: "".join(r.choice(string.ascii_letters + "ü") for _ in range(n))
    p, q = letters(500), letters(350)
    docs = {i: letters(30) + (p if i % 2 else p[40:480]) + letters(30) + (q if i % 5 == 0 else "") for i in range(20)}
    df = spark.createDataFrame(list(docs.items()), "id long, text string")
    got = {x.id: (x.shared_chars, x.kept_elsewhere) for x in shared_spans.shared_portion(df, "id", "text").collect()}
    assert got == brute_portion(docs, 300)
    spans = shared_spans.shared_spans(df, "id", "text").collect()
    by = {}
    for x in spans:
        by.setdefault(x.span_id, set()).add(docs[x.doc][x.start : x.stop])
        assert x.n_docs > 1 and x.stop - x.start >= 300
    assert all(len(v) == 1 for v in by.values())
    assert len(spans) < 20 * 6


@given(st.lists(st.text(alphabet="ab", max_size=60), max_size=6))
@settings(max_examples=40, deadline=None)
def test_every_shared_run_has_a_common_unit(texts):
    raw = [t.encode() for t in texts]
    off = np.cumsum([0, *map(len, raw)])
    i, _, h = Winnower(12, 7, piece=50)(np.frombuffer(b"".join(raw), np.uint8), off)
    units = {k: set(h[i == k].tolist()) for k in range(len(texts))}
    for a, b in itertools.combinations(range(len(texts)), 2):
        if any(texts[a][k : k + 12] in texts[b] for k in range(len(texts[a]) - 11)):
            assert units[a] & units[b]


# ---- splitting -----------------------------------------------------------------------------------------


@given(st.text(alphabet=st.sampled_from("ab .,;\n!é漢́"), max_size=900), st.integers(20, 80), st.integers(0, 15))
@settings(max_examples=150, deadline=None)
def test_pieces_cover_and_fit(text, limit, overlap):
    cuts = splitting.split_texts([text], limit, overlap)[0]
    if not text:
        return
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text)
    for a, b in cuts:
        assert 0 < b - a <= limit
    for (a, b), (c, d) in zip(cuts, cuts[1:]):
        assert a < c <= b < d and b - c <= overlap


def test_pieces_prefer_paragraphs_and_nulls(spark):
    t = "x" * 1500 + "\n\n" + "y " * 1200
    df = spark.createDataFrame([("a", t, 3), ("a", t, 3), ("b", "z" * 4500, None), ("c", None, 1), ("d", "s" * 2000, 1)], "id string, text string, page int").withColumn("k", F.lit(0))
    got = splitting.pieces(df, "id", "text", F.col("page")).orderBy("id", "piece_no").collect()
    assert {(r.id, r.page) for r in got} == {("a", 3), ("b", None)}
    assert [r.stop for r in got if r.id == "a"][0] == 1502
    assert all(len(r.text) <= 2000 for r in got)


# ---- leakage -------------------------------------------------------------------------------------------


def test_leaks_against_brute(spark):
    r = random.Random(7)
    items = {i: words(r, r.choice([8, 12, 30]), 50) for i in range(25)}
    docs = {}
    for i in range(80):
        t = words(r, r.randint(0, 80), 50).split()
        if r.random() < 0.5:
            w = items[r.randrange(25)].split()
            a = r.randint(0, max(0, len(w) - 12))
            t[len(t) // 2 : len(t) // 2] = [x.upper() + r.choice([",", "\n", " –", ""]) for x in w[a : a + r.choice([11, 12, 13])]]
        docs[i] = " ".join(t)
    docs |= {90: None, 91: ""}
    split = lambda t: leakage.words(t or "")
    grams = {}
    for k, t in items.items():
        w = split(t)
        for i in range(len(w) - 11):
            grams.setdefault(tuple(w[i : i + 12]), set()).add(k)
    want = {(d, k) for d, t in docs.items() for w in [split(t)] for i in range(len(w) - 11) for k in grams.get(tuple(w[i : i + 12]), ())}
    d, b = spark.createDataFrame(list(docs.items()), "id long, t string"), spark.createDataFrame([*items.items(), (0, items[0]), (99, None)], "item long, t string")
    got = {(x.doc, x.item) for x in leakage.leaks(d, "id", "t", b, "item", "t").collect()}
    assert got == want and want
    assert leakage.leaks(d.limit(0), "id", "t", b, "item", "t").count() == 0
    assert leakage.leaks(d, "id", "t", b.limit(0), "item", "t").count() == 0


def test_items_come_in_groups(spark):
    b = spark.createDataFrame([(i, "x" * 50) for i in range(10)], "item long, t string")
    assert [len(g) for g in leakage.item_groups(b, "item", "t", 120)] == [2, 2, 2, 2, 2]


# ---- near duplicates -----------------------------------------------------------------------------------


def brute_similar(docs, n, least, similarity):
    sets = {}
    for k, t in docs.items():
        w = (t or "").lower().split()
        if len(w) >= least:
            s = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
            if s:
                sets[k] = s
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-9}


@pytest.mark.parametrize("block,buckets,batch", [(3000, 1 << 20, 10000), (2, 1 << 20, 3), (2, 1 << 20, 7), (5, 1 << 4, 10000), (4, 1 << 8, 5)])
def test_near_duplicates_against_brute(spark, monkeypatch, request, block, buckets, batch):
    monkeypatch.setattr(near_duplicates, "BLOCK", block)
    monkeypatch.setattr(near_duplicates, "BUCKETS", buckets)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch"))
    r = random.Random(block)
    docs = {}
    for i in range(25):
        base = [f"w{r.randrange(60)}" for _ in range(r.choice([26, 40, 70]))]
        docs[f"e{i}"] = " ".join(base)
        for j in range(r.randint(0, 5)):
            w = list(base)
            for _ in range(r.randint(0, 5)):
                k = r.randrange(len(w))
                r.choice([lambda: w.pop(k), lambda: w.insert(k, "new"), lambda: w.__setitem__(k, "Other")])()
            docs[f"e{i}c{j}"] = "  ".join(w)
    docs |= {"n": None, "o": "", "p": "one two", "q": "a " * 30, "q2": "a " * 40}
    df = spark.createDataFrame([*docs.items(), ("e0", docs["e0"])], "id string, t string").withColumn("set", F.lit(1))
    s = near_duplicates.Similar(df, "id", "t", 3, 0.7, 25)
    want = brute_similar(docs, 3, 25, 0.7)
    assert {(x.a, x.b) for x in s.pairs().collect()} == want and want
    group = {}

    def find(x):
        while group.setdefault(x, x) != x:
            x = group[x]
        return x

    for a, b in want:
        group[max(find(a), find(b))] = min(find(a), find(b))
    assert {(x.doc, x.group_id) for x in s.groups().collect()} == {(x, find(x)) for x in list(group)}


def test_near_duplicates_of_nothing(spark):
    s = near_duplicates.Similar(spark.createDataFrame([], "id string, t string"), "id", "t")
    assert s.pairs().count() == 0 and s.groups().count() == 0


def test_components_of_a_chain(spark):
    e = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.node: r.label for r in near_duplicates.components(spark.createDataFrame(e, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


# ---- packing -------------------------------------------------------------------------------------------


@given(st.dictionaries(st.integers(1, 64), st.sampled_from([1, 2, 7, 300]), min_size=1, max_size=20), st.sampled_from([3, 10]))
@settings(max_examples=60, deadline=None)
def test_plan_places_every_item_once(histogram, groups):
    runs = packing.plan(histogram, 64, groups)
    seen, got = set(), {}
    for r in runs:
        assert r.used == sum(s for s, _ in r.items) <= 64
        for c in range(r.first, r.first + r.n):
            assert c not in seen
            seen.add(c)
        for s, k in r.items:
            got.setdefault(s, []).append((k, k + r.n))
    assert seen == set(range(len(seen)))
    for s, n in histogram.items():
        iv = sorted(got[s])
        assert iv[0][0] == 0 and iv[-1][1] == n and all(a[1] == b[0] for a, b in zip(iv, iv[1:]))


def test_pack_round_trip(spark):
    r = random.Random(2)
    docs = [(i, words(r, r.choice([1, 5, 40, 200, 900]))) for i in range(60)] + [(90, None), (91, ""), (3, None)]
    df = spark.createDataFrame(docs, "id long, t string")
    p = packing.pack(df, "id", "t", 256).toPandas()
    count = packing.load_tokenizer(packing.tokenizer_path()).encode_ordinary
    sizes = {i: len(count(t)) for i, t in docs if t}
    whole = p[p.n_tokens > 0]
    assert whole.groupby("id").n_tokens.sum().to_dict() == sizes
    assert whole.groupby("container_id").n_tokens.sum().max() <= 256
    o = whole.sort_values(["container_id", "position"])
    assert not ((o.position + o.n_tokens).groupby(o.container_id).shift() > o.position).any()
    assert (whole.groupby("id").size() == 1)[[i for i, n in sizes.items() if n <= 256]].all()
    assert p[p.id == 91].container_id.tolist() == [0] and p[p.id == 90].container_id.isna().all()
    assert packing.pack(df.limit(0), "id", "t").count() == 0


# ---- personal information ------------------------------------------------------------------------------

NAMES = ["Mira Tolvane", "Otto Brask", "Lena Quist", "Pavel Dorn"]


@pytest.fixture(scope="module")
def names():
    cues = [f"{c} {n}" for n in NAMES for c in ("Signed:", "My name is", "Mein Name ist", "Dr.", "Me llamo")]
    t = next(personal._count(iter([pd.DataFrame({"t": cues + ["the pump is open and the valve is shut today"] * 200})])))
    table = np.zeros(6 * personal.BUCKETS, np.int32)
    table[t["bucket"]] = t["n"]
    return personal.Names(table)


@pytest.mark.parametrize(
    "text,types",
    [
        ("write to a.b+c@mail.example now", {"email"}), ("write to a.b (at) mail (dot) example now", {"email"}), ("bob dot x at mail dot example dot org", {"email"}), ("jоe＠mail.example", {"email"}),
        ("call +44 20 7946 0123 today", {"phone"}), ("(393) 555-0105 or", {"phone"}), ("Tel.: 030 / 23125-118", {"phone"}), ("01.99.00.46.79", {"phone"}), ("zero two zero seven nine four six zero one two three", {"phone"}),
        ("SSN 123-45-6789 is on file", {"id_number"}), ("Passport 922358420 was copied", {"id_number"}), ("DNI 42162494-E", {"id_number"}), ("Steuer-ID lautet 07 566 908 891.", {"id_number"}),
        ("I live at 757B Quill Street, Flat 2, second door", {"street_address"}), ("Anschrift: Vintnerstr. 87", {"street_address"}), ("Livraison au 16 rue du Lac", {"street_address"}), ("Calle Corvin 67, 3.º B", {"street_address"}),
        ("Signed: Mira Tolvane", {"name"}), ("ask otto brask about it", {"name"}), ("Quist, Lena told me", {"name"}), ("P. Dorn", {"name"}),
        ("Batch DE60760736 passed.", set()), ("Drawing 2053-958-053 is void.", set()), ("Dial scale: 210-210-94.", set()), ("Firmware 81.570.0.1 is required.", set()), ("Ticket 3272532725 is closed.", set()), ("Use @63 as the anchor in cell B637.", set()), ("", set()),
    ],
)
def test_personal_types(names, text, types):
    spans = personal.find_in([text], names)[0]
    assert {t for _, _, t in spans} == types
    masked = personal.mask(text, spans)
    # everything around the placeholders stays
    rest = masked
    for t in types:
        rest = rest.replace(f"[{t.upper()}]", "\x00")
    at = 0
    for part in rest.split("\x00"):
        i = text.index(part, at)
        at = i + len(part)


def test_long_items_are_found_whole(names):
    left, right = "a" * 95, "b" * 120 + "." + "c" * 95
    text = f"write to {left}@{right}.example now, or {'Long' * 30} Street"
    assert [text[a:b] for a, b, t in personal.find_in([text], names)[0] if t == "email"] == [f"{left}@{right}.example"]
    street = f"12 {'Long' * 30}ville Oak Street, Flat 2"
    assert [(a, b) for a, b, t in personal.find_in([street], names)[0]] == [(0, len(street))]
    family = "T" + "o" * 60
    table = personal.Names(names.table)
    table.learn(["mira", family.lower()])
    assert [(a, b) for a, b, _ in personal.find_in([f"{family}, Mira"], table)[0]] == [(0, 67)]


@pytest.mark.parametrize("n", [7, 8, 9, 10, 11, 12, 13, 15])
@pytest.mark.parametrize("ws", ["zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun", "cero uno dos tres cuatro cinco seis siete ocho nueve"])
def test_spelled_numbers_of_any_length(names, n, ws):
    w = ws.split()
    number = " ".join(w[(3 * i + 1) % 10] for i in range(n))
    text = f"call {number} today"
    assert [(text[a:b], t) for a, b, t in personal.find_in([text], names)[0]] == [(number, "phone")]
    assert personal.find_in([f"from {' '.join(w[:5])} to six"], names)[0] == []


@pytest.mark.parametrize(
    "text,types",
    [
        ("I live at 12 Oak Drive now", {"street_address"}), ("anna@example dot com", {"email"}), ("anna dot b@example.com", {"email"}), ("anna at\nexample dot com", {"email"}), ("anna@mail.example  punto  org", {"email"}),
        ("zero-two-zero-seven-nine-four-six-zero-one-two-three", {"phone"}), ("zero  two zero\tseven nine, four six zero one two three.", {"phone"}), ("(zero two zero seven nine four six zero one two three)", {"phone"}),
        ("Sr Mira Tolvane", {"name"}), ("Sra Lena Quist", {"name"}), ("Herr. Otto Brask", {"name"}), ("(ID#4216249401)", {"id_number"}), ("NIR: 4216249401", {"id_number"}),
    ],
)
def test_gates_let_every_form_pass(names, text, types):
    assert {t for _, _, t in personal.find_in([text], names)[0]} == types


_STREETS = "Street STREET St. Avenue AVENUE Ave Ave. AVE Road ROAD Rd. Lane LANE Close CLOSE Court COURT Drive Boulevard Blvd Blvd. Place Square Terrace Crescent".split()


@pytest.mark.parametrize("text", [f"12 Oak {w} now" for w in _STREETS] + [f"{c} Zefira Qoltun" for c in "Dr Mr Mrs Ms Prof Herr Frau Sr Sra Mme Dr. Mr. Mrs. Ms. Prof. Herr. Frau. Sr. Sra. Mme. Herrn Madame Monsieur señora señor".split()])
def test_gates_agree_with_their_patterns(text):
    places = personal._literal_places(text.lower())
    if text.startswith("12"):
        assert personal._STREET.search(text) and places["street"]
    else:
        assert personal._NAME_CUE.search(text) and list(personal._cue_matches(text, places["name"]))


def test_offsets_survive_normalising(names):
    text = "ẞ​x — write to a​nna (at) mail (dot) example, ½ done"
    spans = personal.find_in([text, "", "plain"], names)[0]
    assert [text[a:b] for a, b, _ in spans] == ["a​nna (at) mail (dot) example"]


def test_personal_queries_on_odd_tables(spark):
    rows = personal.long_form(spark.createDataFrame([(1, "a@b.example", None), (1, "a@b.example", None), (2, None, "")], "id long, q string, r string"), "id", ["q", "r"])
    assert [tuple(r) for r in personal.personal_types(rows).collect()] == [("1", "q", "email")]
    assert personal.masked(rows).collect()[0].masked_text == "[EMAIL]"
    assert personal.personal_types(rows.limit(0)).count() == 0


# ---- encoding ------------------------------------------------------------------------------------------

GOOD = ["Für Körnungen über 5 mm prüfen Sie die Öffnung – und Gehäuse.", "L’équipe vérifie le boîtier à côté du dépôt.", "La señal de presión está aquí: número 3.", "Перед сменой проверьте насос номер 4.", "A MANUTENÇÃO É FEITA NO SERÃO.", "£ 5 – Été à 20 °C"]


@pytest.fixture(scope="module")
def corpus():
    t = next(encoding._count(iter([pd.DataFrame({"t": GOOD * 60})])))
    counts = np.zeros(encoding.BUCKETS, np.int64)
    counts[t["bucket"]] = t["n"]
    return encoding.Pairs(counts)


@pytest.mark.parametrize("read", ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251"])
@pytest.mark.parametrize("text", GOOD[:3])
def test_utf8_damage_is_restored(corpus, read, text):
    bad = "".join(bytes([b]).decode(read, "replace") if bytes([b]).decode(read, "ignore") else chr(b) for b in text.encode())
    assert encoding.restore(bad, corpus) == (text, "restored")
    assert encoding.restore("Plain words before it. " + bad, corpus) == ("Plain words before it. " + text, "restored")


@pytest.mark.parametrize("times", [4, 6])
def test_damage_upon_damage(corpus, times):
    bad = GOOD[0]
    for _ in range(times):
        bad = bad.encode().decode("latin-1")
    assert encoding.restore(bad, corpus) == (GOOD[0], "restored")


def test_other_damage(corpus):
    twice = GOOD[0].encode().decode("latin-1").encode().decode("latin-1")
    assert encoding.restore(twice, corpus)[0] == GOOD[0]
    assert encoding.restore(GOOD[3].encode("cp1251").decode("cp1252"), corpus) == (GOOD[3], "restored")
    assert encoding.restore("pr�fen", corpus) == ("pr�fen", "lost")
    for t in GOOD + ["", "ascii only"]:
        assert encoding.restore(t, corpus) == (t, None)


@pytest.mark.parametrize("written,read", [("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1251", "cp1252")])
def test_one_byte_damage_of_a_third(spark, written, read):
    r = random.Random(3)
    latin = "Für Körnungen prüfen Sie die Öffnung des Gehäuses später täglich über geschützte zurück L’équipe vérifie élevé pression réglée señal está número presión café matériel".replace("’", "'").split()
    cyrillic = "Перед сменой проверьте насос номер четыре затем откройте клапан давление масла".split()
    vocab = cyrillic if written == "cp1251" else latin
    good = {i: " ".join(r.choice(vocab) for _ in range(12)) for i in range(300)}
    chars = {b: c for c, b in encoding._table(read).items()}
    rows = [(i, "".join(chars[b] for b in t.encode(written)) if i % 3 == 0 else t) for i, t in good.items()]
    got = {x.id: x.restored_text for x in encoding.repair_encoding(spark.createDataFrame(rows, "id long, t string"), "id", "t").collect()}
    assert got == {i: good[i] for i, t in rows if t != good[i]}


def damaged_texts(n):
    r = random.Random(5)
    vocab = [w for t in GOOD for w in t.split()]
    texts = [" ".join(r.choice(vocab) for _ in range(r.randrange(1, 30))) for _ in range(n)]
    bad = [t.encode("mac_roman", "ignore").decode("cp1252", "ignore") if i % 9 == 0 else t for i, t in enumerate(texts)]
    return [t.encode().decode("latin-1") if i % 13 == 0 else t for i, t in enumerate(bad)] + ["", "é", "\U0001f600 ok", "\ud800", "word"]


def summed(count, texts, n):
    out = np.zeros(encoding.BUCKETS, np.int64)
    for t in count(pd.DataFrame({"k": range(i, min(i + n, len(texts))), "t": texts[i : i + n]}) for i in range(0, len(texts), n)):
        np.add.at(out, t["bucket"].to_numpy(), t["n"].to_numpy())
    return out


def naive_counts(texts, earlier=None):
    """Counts of the texts without their misread stretches, one character at a time."""
    out = np.zeros(encoding.BUCKETS, np.int64)
    at = lambda x, y: int(encoding._bucket(np.array([x]), np.array([y]))[0])
    pairs = encoding.Pairs(earlier) if earlier is not None else None
    said = lambda t: pairs.likelihood(f" {t} ") - encoding.ACCENTS * len(encoding._ACCENTED.findall(t))

    def gain(w, read, written):
        table = encoding._table(read)
        try:
            d = bytes(table[c] for c in w).decode(written)
        except (KeyError, UnicodeDecodeError):
            return encoding._WORST
        return encoding._WORST if encoding._LOST.search(d) else max(encoding._WORST, said(d) - said(w))

    for t in texts:
        skip = set()
        for m in re.finditer("[^\x00-\x7f]{2,}", t):
            if any(encoding._USUAL.fullmatch(d) or d == "\xa0" for d in encoding.as_utf8(m.group())):
                skip.update(range(*m.span()))
        found = list(re.finditer("[A-Za-z]*[^\x00-\x7f][A-Za-z\x80-\U0010ffff]*", t))
        if pairs and found:
            gains = np.array([[gain(m.group(), *p) for p in encoding._ONE_BYTE] for m in found])
            k = int(gains.sum(axis=0).argmax())
            if gains[:, k].sum() >= max(encoding.SEEN_LEAST, encoding.SEEN_EACH * sum(ord(c) >= 128 for c in t)):
                for m, g in zip(found, gains):
                    if g[k] > 0:
                        skip.update(range(*m.span()))
        for i in range(-1, len(t)):
            x, y = (ord(t[j]) if 0 <= j < len(t) else 0 for j in (i, i + 1))
            if i + 1 not in skip:
                out[at(y, encoding._ALONE)] += 1
                out[at(encoding._ALL, encoding._ALL)] += 1
            if max(x, y) >= 128 and i not in skip and i + 1 not in skip:
                out[at(x, y)] += 1
    return out


def test_counts_are_those_of_single_texts():
    texts = damaged_texts(150)
    first = summed(encoding._count, texts, 1000)
    assert np.array_equal(first, naive_counts(texts))
    assert np.array_equal(first, summed(encoding._count, texts, 7))  # however the texts are parted
    second = naive_counts(texts, first)
    assert second.sum() < first.sum()
    for n in (1000, 7):
        assert np.array_equal(first + summed(encoding._taking_out(first), texts, n), second)


def test_recurring_words_are_judged_once():
    texts = damaged_texts(3000)
    counts = summed(encoding._count, texts, 1000)

    def calls(work):
        p = cProfile.Profile()
        p.runcall(lambda: list(work(iter([pd.DataFrame({"k": range(len(texts)), "t": texts})]))))
        return sum(e.callcount for e in p.getstats()) / len(texts)

    assert calls(encoding._taking_out(counts)) < 60
    assert calls(encoding._restore(counts)) < 80


def test_encoding_on_odd_tables(spark):
    df = spark.createDataFrame([("a", GOOD[0].encode().decode("cp1252")), ("a", GOOD[0].encode().decode("cp1252")), ("b", None), ("c", ""), *[(f"g{i}", t) for i, t in enumerate(GOOD * 30)]], "id string, t string").withColumn("k", F.lit(1))
    got = encoding.repair_encoding(df, "id", "t").collect()
    assert [(r.id, r.restored_text) for r in got] == [("a", GOOD[0])]
    assert encoding.repair_encoding(df.limit(0), "id", "t").count() == 0


@given(st.lists(st.floats(-3, 3).map(lambda x: round(x, 2)), max_size=12))
@settings(max_examples=100, deadline=None)
def test_segments_hold_the_best_sum(score):
    got = encoding.segments(np.arange(len(score)), np.array(score))
    best = max((sum(score[a:b]) for a in range(len(score)) for b in range(a + 1, len(score) + 1)), default=0)
    sums = [sum(score[a:b]) for a, b in got]
    assert all(a < b for a, b in got) and all(x[1] <= y[0] for x, y in zip(got, got[1:]))
    assert (max(sums) == pytest.approx(best)) if best > 1e-9 else not [s for s in sums if s > 1e-9]


# ---- scans ---------------------------------------------------------------------------------------------

PAGE = ["Report each fault of the cooling wheel to the desk with code 726, even if the valve still works firmly.", "Store the lifting device in a dry room and label the box with the number of the bearing spring.", "The maintenance team replaces the folding surface and greases the damping screw after each shift."]


@pytest.fixture(scope="module")
def repairer():
    texts = [f"{a} {b}" for a in PAGE for b in PAGE] * 25
    t = next(scans._count(iter([pd.DataFrame({"t": texts})])))
    table = np.zeros(2 * scans.BUCKETS, np.int64)
    table[t["bucket"]] = t["n"]
    lex = scans.Lexicon(table)
    return scans.Repairer(lex, scans.train_editor(texts, lex, words=800), scans.train_furniture(texts, ["Safety sheet heating spring", "Operating handbook drive unit"]), scans.train_joins(texts, lex))


def test_scan_page(repairer):
    page = "Report each fault of the coo-\nling whee1 to the desk with\nSAFETY SHEET HEATING SPRING – ISSUE 37\ncode 726, even if the va1ve still\nworks firmly.\nPage 3 of 40"
    text, noise = repairer.run([page], [False])[0]
    assert noise == {"hyphenation", "misread", "running_header", "page_number"}
    assert text == PAGE[0]


@pytest.mark.parametrize("text", [PAGE[0], PAGE[0][:40] + "\n" + PAGE[0][40:], "The bearing gets number\n70.", "Address: 846 Lake Ave., Apt 46", "", "a | 12 | 3\nb | 4 | 5"])
def test_clean_text_has_no_noise(repairer, text):
    assert repairer.run([text], [False])[0][1] == set()


@pytest.mark.parametrize("line", ["[5]", "– 4 –", ". 7 .", "Seite 3", "p. 12", "1 / 14", "iv", "-2-"])
def test_page_numbers(repairer, line):
    assert repairer.run([f"{PAGE[1]}\n{line}"], [False])[0] == (PAGE[1], {"page_number"})


def test_editor_on_held_out_words(repairer):
    r = random.Random(9)
    vocab = sorted({w for p in PAGE for w in scans._LETTERS.findall(p.lower()) if len(w) >= 5})
    hit = total = 0
    for _ in range(200):
        w = r.choice(vocab)
        noisy = scans._corrupt(w, r)
        if noisy == w or noisy in vocab:
            continue
        repairer.editor.learn({noisy})
        total += 1
        hit += repairer.editor.memo[noisy] == w
    assert hit >= 0.9 * total > 0


def test_perceptrons_differ_from_their_gates_and_are_right(repairer):
    """The form of a page number, the more frequent spelling, the most frequent candidate: none of them decides alone."""
    lex = repairer.lexicon
    # a number of the sentence in a narrow column, and a page number
    narrow = "The\nbearing\ngets\nnumber\n70\nand the\nlabel\nof the\nspring."
    assert scans._page_number("70") and "page_number" not in repairer.run([narrow], [False])[0][1]
    assert "page_number" in repairer.run([f"{PAGE[1][:40]}\n70\n{PAGE[1][40:]}"], [False])[0][1]
    # neither spelling is known: two usual words keep their hyphen, halves of a word don't
    assert lex.counts(["boxlabel", "box-label"]).tolist() == [0, 0]
    assert repairer.run(["Open the valve with the box-\nlabel today"], [False])[0][0] == "Open the valve with the box-label today"
    assert repairer.run(["Open the valve with the quar-\nvitz today"], [False])[0][0] == "Open the valve with the quarvitz today"
    # codes with digits stay, though letters could be read for them
    r = random.Random(4)
    kept = total = 0
    for _ in range(200):
        code = "".join(r.choice("abdeglos") for _ in range(2)) + str(r.choice((0, 1, 5, 8, 9)))
        if lex.counts(list(scans.edits(code))).max() >= 2:
            repairer.editor.learn({code})
            total += 1
            kept += repairer.editor.memo[code] is None
    assert kept >= 0.9 * total


def test_copied_page_of_a_third(spark):
    r = random.Random(12)
    vocab = [w for p in PAGE for w in p.split()] + ["the modern pump"] * 6
    clean = [(f"c{i}", " ".join(r.choice(vocab) for _ in range(25)), "TEXT") for i in range(400)]
    page = "Report each fault of tbe modem pump\nto the desk with a label."
    copies = [(f"s{i}", page, "TEXT") for i in range(200)]
    df = spark.createDataFrame((clean + copies) * 2, "id string, t string, kind string")
    got = {x.id: (x.noise, x.repaired_text) for x in scans.repair_scans(df, "id", "t", "kind").collect()}
    want = (["misread"], "Report each fault of the modern pump to the desk with a label.")
    assert got == {i: want for i, _, _ in copies}


def test_scans_on_odd_tables(spark):
    df = spark.createDataFrame([("a", "x", "PARAGRAPH"), ("b", None, None), ("c", "", "TABLE")], "id string, t string, kind string").withColumn("k", F.lit(1))
    assert scans.repair_scans(df, "id", "t", "kind").count() == 0
    assert scans.repair_scans(df.limit(0), "id", "t", "kind").count() == 0


# ---- pairs ---------------------------------------------------------------------------------------------

QS = ["How often should the pump be checked?", "Wie oft muss die Pumpe geprüft werden?", "Que dit le manuel sur le disque de charge ?", "¿Dónde está el plano de la bomba?"]
AS = ["The team checks the pump every 40 hours and notes the value in the log.", "Das Team prüft die Pumpe alle 40 Stunden und trägt den Wert ein.", "L’équipe vérifie le disque toutes les 40 heures et note la valeur.", "El equipo revisa la bomba cada 40 horas y anota el valor en la hoja."]
MORE = ["Store the pump in a dry room and label the box with lot 4.", "Halten Sie die Pumpe kühl, sonst blockiert das Gehäuse der Welle.", "Signalez chaque défaut avec le code 9, même si la vis tourne encore.", "La garantía cubre la bomba durante 52 meses, pero excluye el muelle."]
LEADS = ["In short:", "Kurz gesagt:", "En bref :", "En resumen:"]


def sound_pairs(n, seed):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        k = r.randrange(4)
        c = [AS[k].replace("40", str(r.randint(10, 99))), MORE[k].replace("4", str(r.randint(2, 9)))]
        r.shuffle(c)
        out.append((QS[k], " ".join([LEADS[k]] * (r.random() < 0.4) + c + ["Tel. 555 0145 %04d" % r.randrange(10000)] * (r.random() < 0.1))))
    return out


@pytest.fixture(scope="module")
def field():
    return pairs.train_on(sound_pairs(400, 1), 6000)


def test_field_on_held_out_constructed_pairs(field):
    tokens = pairs.Tokens()
    c, gold = pairs.tagged(tokens, *pairs.Maker(sound_pairs(200, 2), tokens, 7).make(1500))
    got = field.tag(c)
    assert (got == gold).mean() > 0.97
    for k in range(len(pairs.TAGS)):
        assert (got[gold == k] == k).mean() > 0.9


def test_sound_pairs_have_no_defect(field):
    rows = sound_pairs(300, 3)
    assert sum(d is not None for d in pairs.defects([q for q, _ in rows], [r for _, r in rows], field)) <= 3


@pytest.mark.parametrize("answer", [None, "", " \n", "N/A", "[]", "```\n```", "<br>", "​", "...", "Answer:"])
def test_empty_answers(field, answer):
    assert pairs.defect(QS[0], answer, field) == "empty"


@pytest.mark.parametrize(
    "q,a,want",
    [
        (QS[0], AS[0], None), (QS[1], AS[1], None), (QS[0], AS[1], "wrong_language"), (QS[2], AS[0], "wrong_language"), (QS[0] + " Please answer in German.", AS[1], None), (QS[0], AS[0] + " The team checks the pump every 40 hours and", "truncated"),
        (QS[0], QS[0], "echo"), (QS[0], "You asked: HOW OFTEN SHOULD THE PUMP BE CHECKED?", "echo"), (QS[0], QS[0] + " " + AS[0], None), (QS[0], "I can’t help with that. Please ask someone else.", "refusal"), (QS[0], "25 mm", None), (None, AS[0], None), ("", AS[0], None),
    ],
)
def test_defects(field, q, a, want):
    assert pairs.defect(q, a, field) == want


def test_pairs_on_odd_tables(spark):
    df = spark.createDataFrame([(1, QS[0], None), (1, QS[0], None), (2, None, None), (3, QS[0], AS[0]), (None, "q", "")], "id long, q string, a string").withColumn("k", F.lit(1))
    assert {tuple(r) for r in pairs.broken_pairs(df, "id", "q", "a").collect()} == {(1, "empty"), (2, "empty")}
    assert pairs.broken_pairs(df.limit(0), "id", "q", "a").count() == 0

"""The corpus operators against brute force, round trips and stated cases."""

import base64
import os
import random
import re
from dataclasses import replace

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.llm import _util, encoding, lookalikes, mixing, names, neardup, quality, residue, scans, splitting, tokenizer

TEXTS = "rec string, rec_key string, text string"
needs_vocabulary = pytest.mark.skipif(not os.path.exists(os.path.join(tokenizer.TOKENIZERS, "byte_bpe_50k.tiktoken")), reason="no vocabularies here")


def texts(spark, values):
    return spark.createDataFrame([("t", str(i), v) for i, v in enumerate(values)], TEXTS)


# ---- 1


@pytest.fixture(scope="module")
def dictionary_docs(spark):
    lines = ["The café isn’t a façade — it is the “role” of a protégé.", "Readers’ naïve views, “long before”."]
    rows = [("en", t) for t in lines * 30] + [("de", "Die Lücke führt zurück; größer könnte es für Öffentlichkeit sein.")] * 30 + [("pt", "NÃO HÁ situação já, não é só tradução.")] * 30 + [("es", "Según la página, más allá del señal.")] * 30
    return spark.createDataFrame([(i, lang, t) for i, (lang, t) in enumerate(rows)], "doc_id long, lang string, text string")


@pytest.fixture(scope="module")
def mender(spark, dictionary_docs):
    return encoding.Mender(encoding.dictionaries(dictionary_docs))


def misread(data: bytes, codec: str) -> str:
    return "".join(chr(b) if b < 128 else encoding._table(codec)[1][b - 128] for b in data)


@pytest.mark.parametrize("codec", ["cp1252", "latin_1", "cp1250", "cp437", "cp850", "mac_roman"])
@pytest.mark.parametrize("good", ["The café isn’t a façade — it is.", "Die Lücke führt zurück, größer."])
def test_wrong_utf8_round_trip(mender, codec, good):
    bad = misread(good.encode(), codec)
    damaged, restored, chain = mender.mend(bad)
    assert damaged and restored == good and chain


def test_double_and_single_byte_misreadings(mender):
    twice = misread(misread("café — façade".encode(), "cp1252").encode(), "cp1252")
    assert mender.mend(twice)[:2] == (True, "café — façade")
    assert mender.mend("Die Lücke führt zurück, größer".encode("cp1252").decode("cp437"))[:2] == (True, "Die Lücke führt zurück, größer")


def test_honest_text_is_left_alone(mender):
    for good in ("NÃO HÁ fronteira", "« où » L’ÉCOLE “É”", "Zúchino & Dezakïn", "plain", "", None, "слово λόγος", "naïve CAFÉ”"):
        assert mender.mend(good) == (False, good, "")
    assert mender.mend("The caf� isn�t")[0]


def test_mend_settles_repeats_and_nulls(spark, dictionary_docs):
    bad = "The cafÃ© isnâ€™t"
    df = spark.createDataFrame([("t", "1", bad), ("t", "1", bad), ("t", "2", None), ("t", "3", ""), ("t", "4", "x" * 50000 + " cafÃ©")], TEXTS)
    got = {r.rec_key: r.restored for r in encoding.find(df, dictionary_docs).collect()}
    assert got == {"1": "The café isn’t", "4": "x" * 50000 + " café"}
    assert encoding.find(df.limit(0), dictionary_docs.limit(0)).count() == 0


@pytest.mark.parametrize("good", ["Well done 😀 and 🎉!", "שלום עולם", "日本語の本", "हिन्दी की किताब"])
def test_other_scripts_are_restored(mender, good):
    bad = misread(good.encode(), "cp1252")
    assert mender.mend(bad)[:2] == (True, good) and mender.mend(good)[0] is False


def test_many_chains_in_one_text(mender):
    parts = [misread("café façade".encode(), c) for c in ("cp1252", "cp437", "cp850", "mac_roman", "cp1250")]
    assert mender.mend(" and ".join(parts))[1] == " and ".join(["café façade"] * 5)


# ---- 2


def test_names_are_parsed_alike():
    same = [("Tivudas, Chidi", "Chidi Tivudas"), ("Dr. Ruth Sur-ton", "ruth SUR-TON (ed.)"), ("Henrietta van Grin", "van Grin, Henrietta"), ("Kamala Z_ Tiv", "Kamala Z. Tiv"), ("The Zed Inst. f. Old Maps & Trees", "Zed Institute for Old Maps and Trees"), ("Society for Odd Feeds and Codes (Saltry)", "Saltry Society for Odd Feeds and Codes")]
    for a, b in same:
        assert names.similarity(names.parse(a), names.parse(b)) > 0.7, (a, b)
    for a, b in [("Chidi Tivudas", "Kamala Tivudas"), ("I. Castrell", "Noor Castrell"), ("Ann Lee", "Ann Leigh-Wu"), ("Anna B. Lee", "Anna C. Lee")]:
        assert names.similarity(names.parse(a), names.parse(b)) == 0, (a, b)


def test_name_clusters(spark):
    entities = [["Isabella Noor Castrellane", "ISABELLA CASTRELLANE", "I. N. Castrellane", "Izzy Castrellane", "Castrellane, I.", "Isabella Castrelane"], ["Chidi Tivudas", "Tivudas, C."], ["Kamala Zofia Tivudas", "kamala tivudas"], ["Grestoni Baraka", "Baraka Grestoni"]]
    books = spark.createDataFrame([(x,) for e in entities for x in (e, [e[0], " "], None)], "author array<string>")
    got = {frozenset(r.g) for r in names.clusters(books).groupBy("cluster").agg(F.collect_set("name").alias("g")).collect()}
    assert got == {frozenset(e) for e in entities}
    assert names.same_entity(books).count() == 15 + 1 + 1 + 1
    assert names.same_entity(books.limit(0)).count() == 0


def test_cosine_join_equals_all_pairs(spark):
    rng = random.Random(1)
    pool = sorted({" ".join(rng.choice(["ann", "bo", "cyd", "dora"]) + rng.choice("xyz") + rng.choice(["lee", "leeman", "rayo"]) for _ in range(2)) for _ in range(60)})
    df = spark.createDataFrame([(x,) for x in pool], "name string")
    got = {(r.a, r.b): r.cosine for r in names.cosine_pairs(df, 0.3).collect()}
    grams = {x: names.ngrams(names.parse(x)) for x in pool}
    freq = {g: sum(g in v for v in grams.values()) for v in grams.values() for g in v}
    vec = {x: {g: n * np.log((len(pool) + 1) / freq[g]) ** 2 for g, n in v.items()} for x, v in grams.items()}
    norm = {x: np.sqrt(sum(w * w for w in v.values())) for x, v in vec.items()}
    cosine = {(a, b): sum(vec[a][g] * vec[b].get(g, 0) for g in vec[a]) / norm[a] / norm[b] for a in pool for b in pool if a < b}
    expected = {p for p, c in cosine.items() if c >= 0.3 + 1e-9}
    assert expected <= set(got) <= {p for p, c in cosine.items() if c >= 0.3 - 1e-9}


def test_frequent_ngrams_are_split_and_pairs_are_never_written(spark, monkeypatch):
    rng = random.Random(2)
    names_ = sorted({f"{rng.choice(['ann', 'bo', 'cyd', 'dora'])} {rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.choice('bcdfgklmnprst')}man" for _ in range(400)})
    df = spark.createDataFrame([(x,) for x in names_], "name string")
    whole = names.cosine_pairs(df, 0.2)
    assert not [line for line in whole._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line or "Aggregate [a" in line]
    pairs = sorted((r.a, r.b, round(r.cosine, 9)) for r in whole.collect())
    monkeypatch.setattr(names, "SPLIT", 20)
    monkeypatch.setattr(names, "BLOCK", 7)
    assert sorted((r.a, r.b, round(r.cosine, 9)) for r in names.cosine_pairs(df, 0.2).collect()) == pairs
    assert len(pairs) > 100 and len({p[:2] for p in pairs}) == len(pairs)


# ---- 3


def test_lookalikes(spark, dictionary_docs):
    values = ["ｔｈｅ ｃａｔ", "café café", "zero​width", "a b", "conﬁrm", "nоte", "слово and λόγος stay", "“quotes” — dash", None, "", "cafÃ\xa0 isnâ€™t", "ordinary the cat note"]
    df = texts(spark, values)
    found = {int(r.rec_key): r.rewritten for r in lookalikes.find(df, lookalikes.rewriter([df]), encoding.dictionaries(dictionary_docs)).collect()}
    assert found == {0: "the cat", 1: "café café", 2: "zerowidth", 3: "a b", 4: "confirm", 5: "note"}
    again = lookalikes.rewrite(df, lookalikes.rewriter([df]))
    assert again.count() == len(values) and again.where("rec_key = '6'").first().text == values[6]
    twice = lookalikes.rewrite(again, lookalikes.rewriter([df]))
    assert sorted(map(str, twice.collect())) == sorted(map(str, again.collect()))


def test_frequency_chooses_the_representative():
    plain, wide, split = "a", "ａ", "e\u0301"
    usual = lookalikes.rewriting({plain: 90, wide: 3, "é": 8, split: 1, "а": 5, "𝐚": 1})
    assert usual == ({wide: plain, split: "é", "𝐚": plain}, {"а": plain})
    turned = lookalikes.rewriting({plain: 3, wide: 90, "é": 1, split: 8, "а": 5, "𝐚": 1})
    assert turned == ({plain: wide, "é": split, "𝐚": wide}, {"а": wide})
    assert lookalikes.Rewriter(*turned).rewrite("a café") == "ａ cａfe\u0301" and lookalikes.Rewriter(*usual).rewrite("ａ cafe\u0301 𝐚") == "a café a"


def test_the_classes_decide_what_is_found(spark, dictionary_docs):
    words = encoding.dictionaries(dictionary_docs)
    found = lambda df: {int(r.rec_key) for r in lookalikes.find(df, lookalikes.rewriter([df]), words).collect()}
    assert found(texts(spark, ["the c𝐚t", "the cat", "a μm of the cat", "ｔhe cat"] + ["the cat"] * 3)) == {0, 3}
    assert found(texts(spark, ["ｔhe cat"] * 9 + ["hat", "he"])) == set(range(9))
    assert found(texts(spark, ["ｔhe ca"] * 9 + ["hat", "he"])) == {9}  # the wide t is the usual one


def test_classes_are_transitive():
    c = lookalikes.Classes()
    for a, b in ("ab", "cd", "bc"):
        c.join(a, b)
    assert c.groups() == [["a", "b", "c", "d"]]


# ---- 4


def brute(records, size=3):
    words = re.compile(r"[^\W_]+")
    sets = {}
    for i, parts in records:
        s = set()
        for t in parts or []:
            w = words.findall((t or "").lower())
            s |= {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}
        if i is not None and s:
            sets[i] = s
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}


def edited(rng, words):
    out = [w for w in words if rng.random() > 0.08]
    for _ in range(rng.randrange(3)):
        out[rng.randrange(len(out))] = rng.choice("red blue été ten".split())
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    records = []
    for k in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(3, 60))]
        records += [(f"{k}-{i}", [" ".join(edited(rng, base) if i else base)]) for i in range(4) if len(base) > 4 or not i]
    long = [[rng.choice(vocabulary) for _ in range(400)] for _ in range(2)]
    records += [(f"L{i}{j}", [" ".join(edited(rng, w)), "One two three."]) for i, w in enumerate(long) for j in range(3)]
    records += [("copy", records[0][1]), ("null", [None]), ("none", None), ("short", ["two words"]), (None, ["a b c"]), (records[0][0], records[0][1])]
    df = spark.createDataFrame(records, "id string, texts array<string>")
    got = {tuple(r) for r in neardup.similar_pairs(df).collect()}
    assert got == brute(records) and got
    pairs, members = neardup.similar_sets(df)
    groups = {r.id: r.group for r in neardup.groups(pairs, members).collect()}
    assert all(groups[a] == groups[b] for a, b in got) and groups["short"] == "short" if "short" in groups else True


def test_larger_subsets_lose_nothing(spark, monkeypatch):
    rng = random.Random(5)
    records = []
    for k in range(40):
        base = [rng.choice([f"w{i}" for i in range(25)]) for _ in range(rng.randrange(4, 40))]
        records += [(f"{k}-{i}", [" ".join(edited(rng, base))]) for i in range(3)]
    records += [("same word", ["w1 " * 50 + "w2 w1 w3 w1 w4 w1 w5 w1 w6 w1"]), ("same word again", ["w1 " * 50 + "w2 w1 w3 w1 w4 w1 w5 w1 w6 w7"])]
    df = spark.createDataFrame(records, "id string, texts array<string>")
    real = neardup.plan
    for mode in (2, 3):
        monkeypatch.setattr(neardup, "plan", lambda found, m=mode: replace(real(found), mode=np.full(neardup.CLASSES, m), rank=np.arange(neardup.CLASSES)))
        assert {tuple(r) for r in neardup.similar_pairs(df).collect()} == brute(records)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the test tables are not here")
def test_the_plan_mixes_sizes_and_runs_them(spark):
    rows = {(r.def_id, r.excerpt) for r in spark.read.parquet("/root/testdata/sf0.01/definitions.parquet").select("def_id", "excerpt").collect()}
    df = spark.createDataFrame([(i, [t]) for i, t in sorted(rows)], "id string, texts array<string>")
    mode = neardup.plan(neardup.sets(df, 3)).mode
    assert {1, 2} <= set(mode.tolist()) or {1, 3} <= set(mode.tolist())
    assert {tuple(r) for r in neardup.similar_pairs(df).collect()} == brute([(i, [t]) for i, t in rows])


def test_hot_subsets_are_split_without_loss(spark, monkeypatch):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(20)]
    records = [(f"{k}", [" ".join(edited(rng, base))]) for k in range(80)] + [("x", ["w1 w2 w3"])]
    df = spark.createDataFrame(records, "id string, texts array<string>")
    monkeypatch.setattr(neardup, "HOT", 16)
    monkeypatch.setattr(neardup, "PAIRS", 50)
    found = neardup.sets(df, 3)
    assert neardup.heavy(found, neardup.plan(found))[1].max() > 1
    assert {tuple(r) for r in neardup.similar_pairs(df).collect()} == brute(records)


def test_pairs_on_frequent_subsets_are_foreseen(spark, monkeypatch):
    words = ["alpha", "beta", "gamma", "delta", "epsilon"]
    least = min(words, key=lambda w: int(neardup.word_codes([[w]])[0][0]))
    rest = [w for w in words if w != least]
    phrase = " ".join([*rest[:2], least, *rest[2:]])  # one partition of three runs, in every record
    df = spark.createDataFrame([(str(i), [f"{phrase} {' '.join(f'u{i}x{j}' for j in range(6))}"]) for i in range(800)], "id string, texts array<string>")
    seen = []
    real = neardup.allocate
    monkeypatch.setattr(neardup, "allocate", lambda units, cost, needed: seen.append(cost) or real(units, cost, needed))
    plan = neardup.plan(neardup.sets(df, 3))
    pairs = 3 * 800 * 799 / 2
    assert pairs / 2 < seen[0][4, 2] - neardup.POSTING_COST * 3 * 800 < pairs * 2
    assert plan.postings >= sum(len(w) for w, *_ in neardup.named(iter(neardup.sets(df, 3).select("key", "bits").toArrow().to_batches()), plan))
    assert neardup.spread(plan, (np.zeros(2, np.uint64), np.array([1, 20]))) == (1 + (plan.postings + neardup.HOT * 380) // neardup.POSTINGS,) * 2


def test_passes_place_only_the_sets_they_need(spark, monkeypatch):
    rng = random.Random(7)
    df = spark.createDataFrame([(str(i), [" ".join(f"w{rng.randrange(300)}" for _ in range(20))]) for i in range(100)], "id string, texts array<string>")
    found = neardup.sets(df, 3)
    plan = neardup.plan(found)
    batches = found.select("key", "bits").toArrow().to_batches()
    total = sum(len(x) // 6 for b in batches for x in b.column(1).to_pylist())
    placed = []
    real = neardup.partitions
    monkeypatch.setattr(neardup, "partitions", lambda owner, *a: placed.append(len(owner)) or real(owner, *a))
    assert list(neardup.named(iter(batches), plan)) and sum(placed) == total
    placed.clear()
    assert not list(neardup.named(iter(batches), plan, "rest", np.zeros(neardup.WHAT_BUCKETS // 8, np.uint8))) and not sum(placed)
    assert sum(len(w) for w, *_ in neardup.named(iter(batches), plan, "rest", np.full(neardup.WHAT_BUCKETS // 8, 255, np.uint8))) > 0


def test_records_without_any_set_are_similar_to_none(spark):
    df = spark.createDataFrame([("a", ["x"]), ("b", None), ("c", [])], "id string, texts array<string>")
    assert not neardup.similar_pairs(df).collect()


def test_partitions_are_whole_in_batches_of_any_size():
    rng = np.random.default_rng(3)
    for many in (50, 5000):
        owner, run, anchor = neardup.bits([[" ".join(f"w{x}" for x in rng.integers(0, 30, 12))] for _ in range(many)], 3)
        level = rng.integers(0, 6, neardup.RUN_BUCKETS).astype(np.uint8)
        _, r, a, starts, sizes, kind = neardup.partitions(owner, run, anchor, level, np.arange(neardup.CLASSES)[::-1])
        o = np.repeat(np.arange(many), np.bincount(owner, minlength=many))
        parts = {(int(o[i]), int(k), int(a[i])): set(r[i : i + n].tolist()) for i, n, k in zip(starts, sizes, kind, strict=True)}
        want = {}
        for i, x, y in zip(owner.tolist(), run.tolist(), anchor.tolist(), strict=True):
            want.setdefault((i, int(level[x & (neardup.RUN_BUCKETS - 1)]), y), set()).add(x)
        assert len(parts) == len(starts) and parts == want


def test_only_pairs_of_fitting_sizes_meet():
    rng = np.random.default_rng(4)
    what, n, reach = np.sort(rng.integers(0, 20, 600)).astype(np.uint64), rng.integers(1, 400, 600), rng.integers(0, 150, 600)
    order = np.lexsort((n, what))
    what, n, reach = what[order], n[order], reach[order]
    shares = neardup._surplus(n) + 1
    want = [sum(what[i] == what[j] and n[j] <= 2 * n[i] and reach[i] < (2 * n[i] - n[j]) // 3 + shares[i] for j in range(i + 1, 600)) for i in range(600)]
    assert neardup._within(what, n, reach).tolist() == want and 0 < sum(want) < 600 * 30 / 4


def test_groups_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (100, 102)]
    pairs = spark.createDataFrame(edges, "a long, b long")
    members = spark.createDataFrame([(f"r{k:03}", k) for k in [*range(41), 100, 101, 102, 500]] + [("a copy", 102)], "id string, key long")
    got = {r.id: (r.group, r.n_links) for r in neardup.groups(pairs, members).collect()}
    assert {got[f"r{k:03}"][0] for k in range(41)} == {"r000"} and got["r000"][1] == 1 and got["r005"][1] == 2
    assert got["a copy"] == ("a copy", 2) and got["r100"] == ("a copy", 2) and got["r500"] == ("r500", 0)
    assert neardup.groups(pairs.limit(0), members.limit(0)).count() == 0


def test_allocation_is_the_best_choice():
    units, cost = np.array([[0, 10, 6, 0], [0, 8, 4, 2]]), np.array([[0, 100, 5, 0], [0, 50, 9, 1]])
    assert neardup.allocate(units, cost, 8, 8).tolist() == [2, 3]
    assert neardup.allocate(units, cost, 100).tolist() == [1, 1]


# ---- 5


PROSE = "The question, then, is whether the readers of a book can follow it to the end.\nIt is not the first of them, and it was kept in the hall."


def quality_docs(spark, n=150):
    rng = random.Random(4)
    words = "the readers of a book and its margins were kept in that hall for years while archive copies moved to new rooms under old names".split()

    def prose(i):
        return "\n".join(" ".join(rng.choice(words) for _ in range(rng.randrange(8, 14))).capitalize() + ", and so it was kept." for _ in range(4))

    rows = [(i, prose(i), "en", "prose") for i in range(n)]
    rows += [(1000 + i, "\n".join(f"| {rng.randrange(999)} | {rng.randrange(99)} |" for _ in range(5)), "en", "table") for i in range(30)]
    rows += [(2000 + i, "".join(rng.choice("asdfjkl qwx;") for _ in range(150)), "en", "junk") for i in range(30)]
    return rows


def test_quality(spark):
    rows = quality_docs(spark)
    rows += [(3000 + i, rows[150][1], "en", None) for i in range(100)]  # a table that a third of the rows are
    rows += [(4000, rows[151][1], "de", None), (4001, rows[152][1], "Englisch", None), (4002, rows[153][1], None, None), (5000, rows[0][1], "fr", None)]
    rows += [(6000, "", "en", None), (6001, None, "en", None), (6002, " \n", "en", None), (6003, "Lorem ipsum dolor sit amet ipsum dolor.", "en", None), (6004, "x" * 20000, "en", None), (1000, rows[150][1], "en", None)]
    df = spark.createDataFrame([r[:3] + (1,) for r in rows], "doc_id long, text string, lang string, score int")
    labels = spark.createDataFrame([(r[0], r[3], "a") for r in rows if r[3]] + [(None, "prose", "a"), (7, None, "a")], "doc_id long, label string, annotator string")
    s = {r.doc_id: r for r in quality.statistics(df).collect()}
    assert s[6001].n_words == 0 and s[6001].common_share == 0 and s[4001].lang_norm == "und" and s[6003].residue == "filler"
    assert s[1000].mean_word_length == pytest.approx(sum(map(len, rows[150][1].split())) / len(rows[150][1].split()))
    found = {r.doc_id for r in quality.not_prose(df, labels).collect()}
    assert {1000 + i for i in range(30)} | {2000 + i for i in range(30)} | {3000 + i for i in range(100)} | {4000, 4001, 4002} <= found
    assert not found & {*range(150), 5000, 6000, 6001, 6002, 6003}
    assert len({r.doc_id for r in quality.not_prose(df, labels, least_score=-1e9).collect()}) > len(found)  # the score decides
    assert quality.not_prose(df.limit(0), labels).count() == 0 and quality.not_prose(df, labels.limit(0)).count() < 400


def test_ranks_are_exact(spark):
    rng = random.Random(3)
    rows = [("en", rng.randrange(5)) for _ in range(300)] + [("de", rng.randrange(100)) for _ in range(50)]
    columns = {s: F.col("v").cast("double") for s in quality.STATISTICS if s != "n_words"}
    df = spark.createDataFrame([(i, i, a, v) for i, (a, v) in enumerate(rows)], "doc_id long, text_hash long, lang_norm string, v int").withColumn("n_words", F.lit(3)).withColumns(columns)
    for r in quality.ranks(df).where("stat = 'symbol_ratio'").collect():
        own = [v for a, v in rows if r.lang_norm in (a, "und")]
        assert r.left == pytest.approx(sum(v <= r.value for v in own) / len(own)) and r.right == pytest.approx(sum(v >= r.value for v in own) / len(own))
    got = {r.doc_id: r for r in quality.surprises(df).collect()}
    for i, (a, v) in enumerate(rows):
        own = [x for b, x in rows if a == b]
        assert got[i].high_symbol_ratio == pytest.approx(-np.log(sum(x >= v for x in own) / len(own)))


def test_common_words_are_counted(spark):
    df = spark.createDataFrame([("en", "the The, cat"), ("en", "the dog"), (None, None), ("de", "der")], "lang string, text string")
    assert quality.common_words(df, ["en"], most=1) == {"en": {"the"}, "und": {"the", "der"}}


def test_ranged_prefix_with_a_hot_key(spark):
    rows = [("hot" if i % 3 else f"k{i % 4}", i, i % 7) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, o int, v long").repartition(5)
    got = {(r.k, r.o): r.p for r in _util.ranged_prefix(df, ["k"], ["o"], "v", "p").collect()}
    run: dict = {}
    for k, o, v in rows:
        assert got[k, o] == run.get(k, 0)
        run[k] = run.get(k, 0) + v


# ---- 6


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab .,\n", max_size=400), st.integers(20, 60), st.integers(0, 9))
def test_pieces_cover_the_text(t, limit, overlap):
    s = splitting.spans(t, limit, overlap)
    assert "".join(t[a if not i else s[i - 1][1] : b] for i, (a, b) in enumerate(s)) == t
    assert all(b - a <= limit for a, b in s) and all(s[i][0] == s[i - 1][1] - overlap for i in range(1, len(s)))


def test_pieces_end_at_boundaries():
    t = ("A sentence of some words. " * 8).strip() + "\n\n" + "B sentence of some words. " * 8
    s = splitting.spans(t, 250, 20)
    assert t[: s[0][1]].endswith("\n\n")
    assert splitting.spans(None) == splitting.spans("") == [] and splitting.spans("x" * 4000) == [(0, 4000)] and len(splitting.spans("x" * 4001)) == 2


def test_book_pieces(spark):
    rng = random.Random(2)
    pages = [(i, "big", i, "x" * rng.randrange(0, 60)) for i in range(300)] + [(1000 + i, "two", i, "y" * 60) for i in range(2)] + [(2000, "small", 0, "z"), (2001, "one", 0, "z" * 150), (2002, "zero", 0, None), (3000, "lost", 0, "q" * 500), (4000, "steep", 0, "s" * 95), (4001, "steep", 1, "s" * 95)]
    pages += pages[:40]
    books = spark.createDataFrame([(b,) for b in ("big", "two", "small", "one", "zero", "steep")], "id string")
    df = spark.createDataFrame(pages, "page_id long, book_id string, seq int, text string")
    rows = splitting.book_pieces(books, df, limit=100).orderBy("book_id", "piece").collect()
    by = {b: [r for r in rows if r.book_id == b] for b in {r.book_id for r in rows}}
    assert set(by) == {"big", "two", "one", "steep"} and by["one"][0].oversize and not any(r.overlap for r in by["steep"])
    for b, runs in by.items():
        assert [r.piece for r in runs] == list(range(len(runs))) and all(r.oversize or r.chars <= 100 for r in runs)
        covered = {s for r in runs for s in range(r.first_seq, r.last_seq + 1)}
        assert covered == {s for _, x, s, _ in pages if x == b}
        for r, q in zip(runs, runs[1:], strict=False):
            assert q.first_seq == r.last_seq + (0 if q.overlap else 1)
    assert len(by["two"]) == 2
    found = {tuple(r) for r in splitting.oversized(df.select(F.col("page_id").alias("doc_id"), "text"), df, books, 100, 100, 10).collect()}
    assert ("books", "big") in found and ("pages", "2001") in found and ("books", "lost") not in found


# ---- 7


def test_scan_repair(spark):
    words = "the readers of an archive measure their margins and the pattern holds over many pages of the printed book in another house".split()
    r = scans.Repairer({w: 1000 for w in words})
    bad = "the rneasure of an arch-\nive holds\nand the patt¬\nern of the\n12  THE PRINTED BOOK\npages of the b0ok in anofher house\n- 14 -\nand the margins of the book"
    assert r.marks(bad) == "break furniture misread"
    assert r.repair(bad) == "the measure of an archive holds and the pattern of the pages of the book in another house and the margins of the book"
    for good in ("the archive holds\nthe margins of the book", "A4 mp3 3D H2O", "fear, 12, 43\nbook, 9", "| a | 12 |\n| b | 13 |", "", None, "Chapter One\n\nthe readers of the book"):
        assert r.marks(good) == "", good
    assert r.repair(None) is None
    df = texts(spark, [bad, None, "", "the readers of the book"] + ["the readers of the book"] * 5)
    got = scans.find(df, {w: 1000 for w in words}, repaired=True).collect()
    assert [x.rec_key for x in got] == ["0"] and scans.vocabulary(df.limit(0)) == {}


def test_furniture_in_roman_numerals_and_mixed_case():
    r = scans.Repairer({w: 1000 for w in "the readers of an archive measure their margins become".split()})
    head, tail = "the readers of the archive be-", "come the margins of the archive"
    for line in ("xxii  Annals of the Reading Engine", "Annals of the Reading Engine | xvi", "xii", "- xii -", "XIV", "12  Annals of the Reading Engine", "Annals of the Engine   7"):
        assert "furniture" in r.marks(f"{head}\n{line}\n{tail}"), line
        assert r.repair(f"{head}\n{line}\n{tail}") == "the readers of the archive become the margins of the archive", line
    prose = "the readers of the archive measure their margins."
    for line in ("IV  The Margins of the Archive", "12  The Margins of the Archive", "mix", "v", "civil"):
        assert "furniture" not in r.marks(f"{prose}\n{line}\nThe readers of the archive measure"), line


def test_frequent_misreadings_are_repaired():
    r = scans.Repairer({"that": 90000, "thaf": 200, "archive": 25000, "arcbive": 47, "guest": 300, "quest": 36, "holds": 900})
    assert r.marks("thaf arcbive holds") == "misread"
    assert r.repair("thaf arcbive holds arcbivc") == "that archive holds archive"
    assert r.marks("that quest holds") == "" and r.repair("that quest holds") == "that quest holds"


def test_candidates_are_complete():
    words = {"modern": 9, "margin": 9, "dim": 9, "clean": 9}
    lexicon = scans.Lexicon(words)
    edits = [(a, b) for a, b in scans.MISREADINGS if b.islower() and (a.islower() or a.isdigit())]
    for true in words:
        for read, printed in edits:
            for at in range(len(true)):
                if true.startswith(printed, at):
                    bad = true[:at] + read + true[at + len(printed) :]
                    assert bad in words or true in [w for _, w in lexicon.candidates(bad, 1)], (bad, true)


def distance(a, b):
    """Edits between two words: left out, added, changed, swapped neighbours."""
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i in range(len(a)):
        for j in range(len(b)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


def test_retrieval_by_any_edits_is_complete():
    rng = random.Random(7)
    words = {"".join(rng.choice("abcde") for _ in range(rng.randrange(3, 11))): 9 for _ in range(300)}
    lexicon = scans.Lexicon(words)
    for _ in range(60):
        word = list(rng.choice(sorted(words)))
        for _ in range(rng.randrange(1, 3)):
            at = rng.randrange(len(word))
            kind = rng.randrange(4)
            if kind == 0 and len(word) > 3:
                del word[at]
            elif kind == 1:
                word.insert(at, rng.choice("abcde"))
            elif kind == 2:
                word[at] = rng.choice("abcde")
            elif at + 1 < len(word):
                word[at], word[at + 1] = word[at + 1], word[at]
        for bound in (1, 2):
            got = lexicon.within("".join(word), bound)
            expected = {w: e for w in words if (e := distance("".join(word), w)) <= bound}
            assert set(expected) == set(got), ("".join(word), bound)
            assert all(got[w] >= e for w, e in expected.items())


def test_other_edits_are_repaired_beside_scanning():
    r = scans.Repairer({"memory": 90000, "reading": 90000, "archive": 90000, "the": 10**6, "of": 10**6})
    assert r.marks("nemory memry memoryy raeding") == ""
    assert r.repair("the arcbive of nemory, memry, memoryy and raeding") == "the archive of memory, memory, memory and reading"


def test_rare_words_are_in_the_vocabulary(spark):
    df = texts(spark, ["the " * 6000] * 100 + ["an intermethod of the", "intermethod", "once"])
    words = scans.vocabulary(df)
    assert words == {"the": 600_001, "intermethod": 2} and scans.vocabulary(df, most=1) == {"the": 600_001}
    r = scans.Repairer(words)
    assert r.marks("the intermeth0d") == "misread" and r.repair("the intermeth0d of the inter-\nmethod") == "the intermethod of the intermethod"


def test_no_word_of_two_uses_is_cut(spark):
    letters = "bcdfghklmnprstvw"
    many = [f"z{a}{b}{c}{d}{e}a" for a in letters for b in letters for c in letters for d in letters for e in letters[:4]]
    df = texts(spark, [" ".join(many[i : i + 2000]) for i in range(0, len(many), 2000)] * 3 + ["zzintermethod of zzintermethod"])
    words = scans.vocabulary(df)
    assert len(many) > 200_000 and len(words) == len(many) + 1 and words["zzintermethod"] == 2
    assert scans.Repairer({"zzintermethod": words["zzintermethod"]}).marks("zzintermeth0d") == "misread"


def test_word_counts(spark):
    df = texts(spark, ["A a, b.", None, "", "b’s (c) c"])
    assert {r.word: r.n for r in scans.word_counts(df).collect()} == {"a": 2, "b": 1, "b’s": 1, "c": 2}


# ---- 8


@needs_vocabulary
def test_ids_equal_a_public_encoder(spark):
    import tiktoken

    with open(os.path.join(tokenizer.TOKENIZERS, "byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    public = tiktoken.Encoding("own", pat_str=tokenizer.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    values = ["", None, "a" * 3000, "Hello,  world!\n\n x\n", "<|endoftext|>", "²½ⅷ é x", "x" * 100000, "it's we'll 'S", "　 a\tb"] + ["".join(rng.choice(" \n\t'abcs.é²́　\x1f") for _ in range(30)) for _ in range(300)]
    df = spark.createDataFrame([(i, v, [9]) for i, v in enumerate(values)], "doc_id long, text string, ids array<int>")
    got = {r.doc_id: r.ids for r in tokenizer.token_ids(df).collect()}
    assert got == {i: public.encode_ordinary(v) if v else [] for i, v in enumerate(values)}
    assert {r.doc_id: r.n_tokens for r in tokenizer.token_counts(df).collect()} == {i: len(v) for i, v in got.items()}


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4999), st.integers(0, 50)), max_size=60))
def test_rank_queue_is_sorted(items):
    q = tokenizer.RankQueue(5000)
    for rank, at in items:
        q.push(rank, at)
    out = []
    while (x := q.take()) is not None:
        out += [(x[0], at) for at in x[1]]
    assert out == sorted(items)


# ---- 9


@needs_vocabulary
def test_mixing(spark):
    rows = [(i, "big", "word " * (i % 50 + 1)) for i in range(300)] + [(1000 + i, "small", "word " * 20) for i in range(10)] + [(2000, None, "x y"), (2001, "big", None), (2002, "big", ""), (2003, "other", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    mixture = spark.createDataFrame([("big", 0.8, 1), ("small", 0.2, 3), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    selection, shares = mixing.mix(docs, mixture)
    s = {r.source: r for r in shares.collect()}
    assert sum(r.actual_share for r in s.values()) == pytest.approx(1) and s["absent"].actual_share == 0 and s["small"].tokens_used == 3 * s["small"].n_tokens
    assert abs(s["big"].tokens_used / s["small"].tokens_used - 4) < 0.2 and all(r.tokens_used <= r.budget for r in s.values())
    chosen = selection.collect()
    assert {r.source for r in chosen} == {"big", "small"} and all(r.copies <= s[r.source].max_repeats for r in chosen)
    assert sorted(map(tuple, mixing.mix(docs.repartition(7), mixture)[0].collect())) == sorted(map(tuple, chosen))
    empty, none = mixing.mix(docs.limit(0), mixture)
    assert empty.count() == 0 and none.count() == 3


# ---- 10


def test_residue(spark):
    values = {
        "{{ title }} by [Insert author here] (year goes here).": "template",
        "Please enable JavaScript to read this book. Cookies must be switched on as well.": "message",
        "Seite nicht gefunden\nFehlercode: 404.": "message",
        "Lorem ipsum dolor sit amet, consectetur elit.": "filler",
        "A tutorial that shows `{{ name }}` and says “Please enable JavaScript” is an order to a reader of the page, not to you.": None,
        "The error of the page was found by the server of the house, and the readers of it went on for a long while after that.": None,
        "": None,
        " \n": None,
        "{a}{b!<<>>%%$${{}}[[]]@@##^^&&**(())__++==~~``||\\//??..,,;;::": None,
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*values, None])], "doc_id long, text string")
    got = {r.doc_id: r.residue for r in residue.classify(df).collect()}
    assert got == dict(enumerate([*values.values(), None]))
    assert residue.residue(df.union(df)).count() == 4 and residue.without_residue(df).count() == len(values) + 1 - 4
    assert residue.residue(df.limit(0)).count() == 0


def ways(parsed):
    """Texts that a parsed pattern matches: every branch, optional parts left out and taken."""
    found = [""]
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            parts = [chr(arg)]
        elif name == "BRANCH":
            parts = [w for branch in arg[1] for w in ways(branch)]
        elif name == "SUBPATTERN":
            parts = ways(arg[3])
        elif name == "MAX_REPEAT":
            least, most, inner = arg
            parts = [w * n for w in ways(inner) for n in {least, min(most, least + 1)}]
        elif name == "IN":
            kind, value = arg[0]
            parts = [chr(value) if str(kind) == "LITERAL" else {"CATEGORY_DIGIT": "4", "CATEGORY_WORD": "x"}.get(str(value), " ")]
        else:
            parts = [" " if name == "ANY" else ""]
        found = [a + b for a in found for b in parts]
    return found


def test_every_message_has_an_anchor():
    for pattern in residue.MESSAGES:
        matching = [w for w in ways(re._parser.parse(pattern)) if re.search(pattern, w)]
        assert matching, pattern
        for text in matching:
            assert residue.kind_of(text, message_share=0.01) == "message", (pattern, text)
    for text in ("410 Gone", "408 Request Timeout", "401 Authorization Required", "404", "Please try again.", "Please disable your adblocker.", "[Error]", "\u00a1Oops!", "(JavaScript is required)"):
        assert residue.kind_of(text) == "message", text

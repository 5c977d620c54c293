import random
import re

from covergrid.llm import leaks
from covergrid.llm.leaks import LeakFinder

ITEM = "Explain why Boris counts 12 spare folds for 30 seconds while the quiet loader keeps every empty bucket"


def brute(docs, items, n=12):
    def wins(t):
        w = [x.lower() for x in re.findall(r"[^\W_]+", t or "")]
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    iw = {i: wins(t) for i, t in items}
    return sorted((d, i) for d, t in docs for i, w in iw.items() if w & wins(t))


def run(spark, docs, items):
    finder = LeakFinder(spark.createDataFrame(items, "item_id int, text string"), "item_id", "text")
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id int, text string, key string")
    return finder, df


def test_leaks_and_templates(spark):
    other = ITEM.replace("Boris", "Explain").replace("12", "77").replace("30", "90")
    broken = ITEM.replace("12", "5").replace("30", "5")
    shout = "+ // " + " -- ".join(ITEM.upper().split()[2:14]) + "."
    docs = [(1, f"x {ITEM} y"), (2, shout), (3, " ".join(ITEM.split()[:11])), (4, None), (5, ""), (6, other.replace("Explain counts", "Boris counts")), (7, broken), (8, (ITEM + " ") * 2000), (1, f"x {ITEM} y"), (9, "word " * 50_000)]
    items = [(1, ITEM), (2, ITEM), (3, None), (4, "too short")]
    finder, df = run(spark, docs, items)
    got = sorted((r.doc_id, r.item_id) for r in finder.leaks(df, "doc_id", "text").collect())
    assert got == sorted(set(brute(docs, items))) == [(1, 1), (1, 2), (2, 1), (2, 2), (8, 1), (8, 2)]
    rep = {(r.doc_id, r.item_id): (r.n_windows, r.n_exact) for r in finder.report(df, "doc_id", "text").collect()}
    assert rep[(6, 1)][0] > 0 and rep[(6, 1)][1] == 0  # other numbers, filled consistently
    assert all(n_exact == 0 for k, (_, n_exact) in rep.items() if k[0] in (6, 7))


def test_large_item_sets_take_the_other_way(spark, monkeypatch):
    monkeypatch.setattr(leaks, "VOCABULARY", 0)
    monkeypatch.setattr(leaks, "BROADCAST_WINDOWS", 0)
    docs, items = [(1, f"x {ITEM} y"), (2, "nothing " * 20)], [(1, ITEM)]
    finder, df = run(spark, docs, items)
    assert finder.known is None and not finder.small
    assert [(r.doc_id, r.item_id) for r in finder.leaks(df, "doc_id", "text").collect()] == [(1, 1)]


def test_names_and_quantities_that_stand_in_no_item(spark, monkeypatch):
    item = ITEM.replace("30 seconds", "512mb")
    opening = "Boris counts 12 spare folds for hours while the quiet loader keeps every empty bucket"
    docs = [(1, "x. " + item.replace("Boris", "Zelda")), (2, item.replace("512mb", "64mb")), (3, opening.replace("Boris", "Zelda")), (4, "so " + item.replace("Explain", "explain").replace("Boris", "Zelda")), (5, item.replace("spare", "green"))]
    want = {(1, 1), (2, 1), (3, 2), (4, 1)}
    for most in (leaks.VOCABULARY, 0):
        monkeypatch.setattr(leaks, "VOCABULARY", most)
        finder, df = run(spark, docs, [(1, item), (2, opening)])
        got = {(r.doc_id, r.item_id): r.n_windows - r.n_exact for r in finder.report(df, "doc_id", "text").collect()}
        assert {k for k, n in got.items() if n} >= want and (5, 1) not in {k for k, n in got.items() if n}


def test_empty_tables(spark):
    finder, df = run(spark, [], [(1, ITEM)])
    assert finder.leaks(df, "doc_id", "text").count() == 0
    finder, df = run(spark, [(1, ITEM)], [])
    assert finder.leaks(df, "doc_id", "text").count() == 0


def test_table(spark, data):
    docs, items = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "benchmark"))
    got = sorted((r.doc_id, r.item_id) for r in LeakFinder(items, "item_id", "text").leaks(docs, "doc_id", "text").collect())
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])


def test_slots_of_several_words_and_planted_questions(spark):
    """Every re-parameterised item is found, nothing else is."""
    rng = random.Random(3)
    nouns = [f"{a}{b}" for a in ("lamp", "fold", "road", "leaf", "bolt", "crate") for b in ("let", "ing", "yard", "er", "ish")]
    numbers = ["7", "1.5", "2,000", "thirty four", "twelve", "0.25", "three hundred"]
    units = ["30 seconds", "5kg", "12 mb", "9 hours", "forty km", "2.5GB"]
    names = ["Boris", "Zelda", "Ngozi", "Ünal"]
    made = lambda words: f"{' '.join(words[:4])} {rng.choice(names)} {words[4]} {rng.choice(numbers)} {' '.join(words[5:9])} for {rng.choice(units)} {' '.join(words[9:])}"
    texts = [[rng.choice(nouns) for _ in range(16)] for _ in range(40)]
    items = [(i, made(t)) for i, t in enumerate(texts)]
    docs = [(100 + i, "so " + made(t) + ".") for i, t in enumerate(texts)] + [(500 + i, made([rng.choice(nouns) for _ in range(16)])) for i in range(40)]
    finder, df = run(spark, docs, items)
    got = {(r.doc_id, r.item_id) for r in finder.report(df, "doc_id", "text").collect()}
    assert got == {(100 + i, i) for i in range(40)}


def test_templates_are_joined_first_and_slots_checked_then(spark, monkeypatch):
    """Word for word, too: a number, unit or name is a slot, in any letter case."""
    other = ITEM.replace("Boris", "Zelda").replace("12", "77").replace("seconds", "hours")
    docs = [(1, "x " + ITEM.lower()), (2, "x " + other.upper()), (3, ITEM.replace("Boris", "Zelda")), (4, ITEM.replace("spare", "quiet"))]
    items = [(1, ITEM), (2, other)]
    for most in (leaks.VOCABULARY, 0):
        monkeypatch.setattr(leaks, "VOCABULARY", most)
        monkeypatch.setattr(leaks, "BROADCAST_WINDOWS", most)
        finder, df = run(spark, docs, items)
        exact = finder.windows.where("way = 0")
        assert exact.select("key").distinct().count() == len(ITEM.split()) - 11 == exact.where("item = 1").count()
        assert {r.doc for r in finder.candidates(df, "doc_id", "text", (leaks.EXACT,)).collect()} >= {1, 2, 3}
        assert sorted((r.doc_id, r.item_id) for r in finder.leaks(df, "doc_id", "text").collect()) == brute(docs, items)


def test_rows_of_numbers_match_word_for_word_only(spark):
    rng = random.Random(4)
    row = lambda n: " ".join(str(rng.randrange(1000, 9999)) for _ in range(n))
    table = row(60)
    docs, items = [(1, row(2000)), (2, row(50) + " " + table), (3, "9 " * 3000)], [(1, table), (2, "9 " * 40)]
    finder, df = run(spark, docs, items)
    assert {(r.doc_id, r.item_id, r.n_windows, r.n_exact) for r in finder.report(df, "doc_id", "text").collect()} == {(2, 1, 0, 49), (3, 2, 0, 2989)}
    assert finder.matches(df, "doc_id", "text").count() == 49 + 1  # no pairs of windows
    assert sorted((r.doc_id, r.item_id) for r in finder.leaks(df, "doc_id", "text").collect()) == brute(docs, items)


def test_words_beside_points_and_commas(spark):
    items = [(1, "v1 2,5kg2x 3 a,b c.d 7.e8 9 10,11 12 13 14 15")]
    docs = [(1, "V1-2 5KG2X 3 A B c d 7 E8 9 10 11 12, 13 14"), (2, "v1 25kg2x 3 a b c d 7 e8 9 10 11"), (3, "x" * 100_000 + " 1.2" * 5)]
    finder, df = run(spark, docs, items)
    assert sorted((r.doc_id, r.item_id) for r in finder.leaks(df, "doc_id", "text").collect()) == brute(docs, items) == [(1, 1)]

import random

from tabwise.llm import decontaminate as D

ITEM = "Lisa has 7 apples and Tom gives her 2 more apples then she eats 4 of the apples how many apples does Lisa have left now?"


def kinds(text, *items):
    return {x["item_id"]: x["kind"] for x in D.leaks(text, D.build_index(list(enumerate(items or [ITEM]))), D._Tokens())}


def test_slots():
    assert kinds("Well. " + ITEM + " More.") == {0: "exact"}
    assert kinds(ITEM.replace("Lisa", "Anna").replace("7", "15").replace("2", "3")) == {0: "reparameterised"}
    assert kinds("Run 5 km in 30 minutes and rest then walk 2 miles home slowly today", "Run 8 miles in 45 minutes and rest then walk 1 km home slowly today") == {0: "reparameterised"}
    # one item value may not stand for many document values
    many = "if x is 3 then add 3 and take 3 from 3 until 3 is not 3 or 3 more than 3 by 3"
    mixed = "if x is 1 then add 2 and take 4 from 5 until 6 is not 7 or 8 more than 9 by 0"
    assert kinds(mixed, many) == {} and kinds(many.replace("3", "9"), many) == {0: "reparameterised"}
    assert kinds("apples and oranges are sold here every day of the week by the kilo") == {}
    assert kinds(None) == {} and kinds("") == {} and kinds(ITEM, None, "", "a b") == {}
    assert kinds("we saw red old cars there", "red old cars") == {0: "exact"}


def brute_exact(docs, items):
    return {(i, k) for i, t in docs for k, q in items if t and q and f" {' '.join(q.split())} " in f" {' '.join(t.split())} "}


def test_against_brute_force(spark):
    r = random.Random(5)
    words = ["w%c%c" % (a, b) for a in "abcdefgh" for b in "abcdefgh"]
    items = [(k, " ".join(r.choices(words, k=r.randint(9, 40)))) for k in range(60)] + [(90, None), (91, "")]
    docs = []
    for i in range(200):
        w = " ".join(r.choices(words, k=r.randint(0, 150)))
        docs.append((i, w + (" " + r.choice(items[:60])[1] + " " + w[:40] if i % 5 == 0 else "")))
    docs += [(500, None), (501, ""), (0, docs[0][1]), (None, items[3][1]), (502, "x " * 60_000 + items[4][1])]
    d = spark.createDataFrame([(*x, "z", 1) for x in docs], "doc_id long, text string, item_id string, Text int").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    for bound in (D.MAX_WINDOWS, 100):
        got = [(x.doc_id, x.item_id) for x in D.find_leaks(d, b, max_windows=bound).collect()]
        assert set(got) == brute_exact(docs, items) and got.count((0, next(k for i, k in got if i == 0))) == 2
    clean = D.drop_leaks(d, b)
    hit = {i for i, _ in got}
    assert clean.columns == d.columns and clean.count() == sum(i not in hit for i, _ in docs)


def test_empty_tables(spark):
    d, b = spark.createDataFrame([(1, "a b c d e")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert D.find_leaks(d, b).count() == 0 and D.drop_leaks(d, b).count() == 1
    assert D.find_leaks(d.limit(0), spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")).count() == 0


def test_exact_copies_of_any_kind(spark):
    items = ["The series 2, 4, 8, 16, 32, 64, 128, 256", "1 2 3 4 5 6 7 8 9 10 11 12", "Anna Berta Clara Dora Emma Frida Greta Hanna Ida", "Who Was The First President Of The United States?",
             "WHICH CITY IS LARGEST?", "What is the capital of Peru?", "Photosynthesis", "plate tectonics", None, "", "..."]
    texts = [f"Exercises\n{t}\nThen more ... of this" for t in items if t] + ["who was the first president of the united states", "Anna met Berta 2, 4 times", "photo synthesis of plate and tectonics", "", None]

    def plain(t):
        return [w.strip(".,?").lower() for w in (t or "").split()]

    def holds(t, q):
        a, b = plain(t), plain(q)
        return any(b) and any(a[i:i + len(b)] == b for i in range(len(a) - len(b) + 1))

    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = {(i, k) for i, t in enumerate(texts) for k, q in enumerate(items) if holds(t, q)}
    assert len(want) >= 9
    for bound in (D.MAX_WINDOWS, 20):
        assert {(x.doc_id, x.item_id) for x in D.find_leaks(d, b, max_windows=bound).collect() if x.kind == "exact"} == want
    assert D.drop_leaks(d, b).count() == len(texts) - len({i for i, _ in want})


def test_alignments_are_judged_one_by_one(spark):
    """A copy of an item's last words elsewhere does not clear an alignment whose values map inconsistently."""
    item = "A farmer has 12 cows and 7 sheep and 12 goats and 30 hens and 7 ducks so how many animals with two legs does the farmer keep on the old farm by the quiet river"
    tail = " ".join(item.split()[-8:])
    right = item.replace("12", "15").replace("30", "44").replace("7", "9")
    wrong = "A farmer has 5 cows and 6 sheep and 8 goats and 9 hens and 11 ducks" + item.split("ducks")[1].split("keep")[0] + "sells today"
    texts = [(1, f"Intro text here. {right} and so on."), (2, f"Intro text here. {wrong}"), (3, f"Other words stand first and then {wrong} then later {tail} ends"), (4, item), (5, f"only {tail}")]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    b = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {r.doc_id: (r.kind, r.covered == r.item_words) for r in D.find_leaks(d, b).collect()}
    assert got == {1: ("reparameterised", True), 4: ("exact", True)}


def reparameterised(seed, n=120):
    r = random.Random(seed)
    verbs, things = ["buys", "sells", "paints", "packs", "moves", "counts"], ["boxes", "apples", "pens", "chairs", "books", "cups"]
    people = ["Anna", "Boris", "Carla", "David", "Elena", "Farid", "Greta", "Hugo"]
    items, docs = [], []
    for k in range(n):
        v, t, u = r.choice(verbs), r.choice(things), r.choice(things)
        shape = f"On day {k} of the fair {{p}} {v} {{a}} {t} in the morning and {{b}} {u} in the evening at {{c}} dollars each while {{q}} {r.choice(verbs)} the rest, how much is left for {{p}} at the end of this long day"

        def made():
            p, q_ = r.sample(people, 2)
            return shape.format(p=p, q=q_, a=r.randint(2, 99), b=r.randint(2, 99), c=r.randint(2, 99))

        items.append((k, made()))
        docs.append((k, "Some talk before it. " + made() + " Some talk after it."))
    return items, docs


def test_recall_of_changed_parameters(spark):
    items, docs = reparameterised(3)
    got = {(r.doc_id, r.item_id) for r in D.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert sum((k, k) in got for k, _ in items) >= 0.9 * len(items)

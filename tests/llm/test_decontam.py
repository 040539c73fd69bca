import random

import pytest

from foliary.llm import template_decontam as D

ITEM = "If Alice buys 12 apples at 3 dollars each and Bob eats 4 of them, how much did Alice pay for the apples in total?"
CHANGED = "If Carol buys 15 apples at 7 dollars each and Dan eats 2 of them, how much did Carol pay for the apples in total?"
INCONSISTENT = "If Carol buys 15 apples at 7 dollars each and Dan eats 2 of them, how much did Erin pay for the apples in total?"


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(i, t, "h", 1) for i, t in docs], "doc_id long, text string, hash string, item_id long"),
        spark.createDataFrame([(i, t, "s") for i, t in items], "item_id long, text string, slots string"),
    )


def brute(docs, items):
    """Every window of every document against every window of every item, word by word."""
    met = {}
    words = D.Words()
    for item, text in items:
        if item is None:
            continue
        b = D.Template(words, text)
        size = min(D.WINDOW, len(b))
        if size < D.SHORTEST:
            continue
        for i in range(len(b) - size + 1):
            for named in (False, True)[: 1 + (b.opens_capital and i == 0)]:
                def shape(t, at, named=False):
                    return [D.NAME if named and k == 0 else t.kind[k] or t.words.form[t.at[k]] for k in range(at, at + size)]
                want, slots = shape(b, i, named), b.slots(i, size, named)
                free = sum(isinstance(w, str) for w in want) >= D.LITERAL * size
                for doc, body in docs:
                    t = D.Template(words, body)
                    for j in range(len(t) - size + 1) if doc is not None else ():
                        if shape(t, j) == want:
                            found = t.slots(j, size)
                            if free or slots == found:
                                met.setdefault((doc, item, j - i), []).append((i, list(zip(slots, found, strict=True))))
    out = {}
    for (doc, item, _), windows in met.items():
        pairs = {p for _, w in windows for p in w}
        for i, w in windows:
            equal = all(a == b for a, b in w)
            if equal or len({a for a, _ in pairs}) == len(pairs):
                out.setdefault((doc, item), {}).setdefault(i, []).append(equal)
    return {k: (len(v), sum(any(x) for x in v.values())) for k, v in out.items()}


def got(df):
    return {(r["doc_id"], r["item_id"]): (r["n_windows"], r["n_exact"]) for r in df.collect()}


@pytest.mark.parametrize(("bits", "group", "heavy"), [(27, 1 << 19, 1000), (6, 50, 3)])
def test_equals_brute_force(spark, monkeypatch, bits, group, heavy):
    monkeypatch.setattr(D, "FILTER_BITS", bits)
    monkeypatch.setattr(D, "GROUP", group)
    monkeypatch.setattr(D, "HEAVY", heavy)
    rng = random.Random(2)
    vocabulary = ["Ann", "Bob", "3", "4.5", "kg", "the", "of", "sum", "is", "and", "what.", "(price)", "--", "6kg"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 14, 20])))) for i in range(12)]
    items += [(50, ITEM), (51, None), (52, ""), (None, ITEM), (53, ITEM)]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(30)) + " " + rng.choice(items)[1] if rng.random() < 0.7 and items else "x") if i % 2 else (i, "so " + (items[i % 12][1]) + " end") for i in range(40) if items[i % 12][1]]
    docs += [(60, "It says: " + ITEM + " Yes."), (61, "well " + CHANGED), (62, INCONSISTENT), (63, None), (64, ""), (None, ITEM), (65, "a " * 20000), (60, ITEM)]
    d, b = frames(spark, docs, items)
    found = got(D.contaminated(d, b))
    assert found == brute(docs, items)
    assert found[(60, 50)][0] == found[(60, 50)][1] and found[(61, 50)][1] < found[(61, 50)][0]
    assert found.get((62, 50), (0, 0))[0] < found[(61, 50)][0]
    assert {k[0] for k in found}.isdisjoint({63, 64, 65, None})


def test_empty_tables(spark):
    d, b = frames(spark, [(1, ITEM)], [(1, ITEM)])
    assert D.contaminated(d.limit(0), b).count() == 0 and D.contaminated(d, b.limit(0)).count() == 0


def test_names_that_open_sentences_may_be_exchanged(spark):
    item = "Tom has 12 red apples. Ann has 9 green pears. How many fruits do Tom and Ann have?"
    copy = "Jim has 7 red apples. Sue has 5 green pears. How many fruits do Jim and Sue have?"
    mixed = "Jim has 7 red apples. Sue has 5 green pears. How many fruits do Bob and Sue have?"
    d, b = frames(spark, [(1, copy), (2, "Well: " + copy), (3, mixed), (4, item)], [(1, item)])
    found = got(D.contaminated(d, b))
    assert found[(1, 1)] == found[(2, 1)] == (6, 0) and found[(4, 1)] == (6, 6) and (3, 1) not in found


def test_copies_in_other_case_are_found(spark):
    item = "Natalia sold clips to 48 of her friends in April, and then she sold half as many clips in May."
    german = "Der Bauer verkauft auf dem Markt 12 Kisten mit Birnen und fährt mit seinem Wagen nach Hause."
    docs = [(1, item.lower()), (2, "So. " + item.upper()), (3, item), (4, german.lower()), (5, item.replace("April,", "April."))]
    found = got(D.contaminated(*frames(spark, docs, [(1, item), (2, german)]), any_case=True))
    all_places = {i: len(x.split()) - D.WINDOW + 1 for i, x in ((1, item), (2, german))}
    assert found == {(d, i): (all_places[i],) * 2 for d, i in ((1, 1), (2, 1), (3, 1), (4, 2), (5, 1))}


def test_number_words_of_four_languages(spark):
    texts = {
        "A farmer packs {} eggs in each box and sells them at the market for money.": ("twelve", "fifteen", "ninety-one", "7"),
        "ein bauer packt immer {} eier in jede schachtel und verkauft sie dann auf dem markt.": ("zwölf", "siebzehn", "einundachtzig", "7"),
        "le fermier met toujours {} oeufs dans chaque boîte et les vend ensuite au marché.": ("douze", "seize", "quatre-vingt-dix-sept", "cent"),
        "el granjero pone siempre {} huevos en cada caja y luego los vende en el mercado.": ("doce", "quince", "veintidós", "mil"),
    }
    items = [(i, t.format(w[0])) for i, (t, w) in enumerate(texts.items())]
    docs = [(10 * i + k, t.format(w)) for i, (t, ws) in enumerate(texts.items()) for k, w in enumerate(ws)]
    found = got(D.contaminated(*frames(spark, docs, items)))
    for i, (_, text) in enumerate(items):
        n = len(text.split()) - D.WINDOW + 1
        assert [found.get((10 * i + k, i), (0,))[0] for k in range(4)] == [n] * 4, text

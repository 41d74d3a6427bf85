import random

from kgloom.llm.leaks import leaks, tiles, words_of


def test_words():
    assert words_of("It's A_b 3.5 İx 漢字。") == ["it", "s", "a", "b", "3", "5", "i̇x", "漢字"] and words_of(None) == []


def test_tiles_catch_reordered_passages():
    item = list(range(100, 140))
    doc = item[20:40] + [1, 2] + item[:20]
    got = tiles(doc, item, [(i, j) for i in range(len(doc)) for j in range(40) if doc[i : i + 5] == item[j : j + 5]], 5)
    assert sorted(got) == [(0, 20, 20), (22, 0, 20)]
    twice = tiles(item + item, item, [(i, j) for i in range(76) for j in range(36) if (item + item)[i : i + 5] == item[j : j + 5]], 5)
    assert twice == [(0, 0, 40)]


def test_against_brute_force(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([3, 15, 40])))) for i in range(12)] + [(90, None), (91, ""), (0, "again " * 14)]
    documents = []
    for d in range(40):
        text = rng.choices(vocabulary, k=30)
        source = (rng.choice(items[:12])[1]).split()
        cut = rng.randrange(max(1, len(source) - 5))
        documents.append((d, ". ".join(text + source[cut : cut + rng.choice([6, 12, 30])] + text), "x"))
    documents += [(100, None, "x"), (101, "", "x"), (102, " ".join(vocabulary) * 2000, "x"), (3, items[5][1], "x")]

    def grams(text):
        words = words_of(text)
        return {tuple(words[i : i + 12]) for i in range(len(words) - 11)}

    want = sorted({(d, i) for d, t, _ in documents for i, s in items if grams(t) & grams(s)})
    df, held = spark.createDataFrame(documents, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted({(r.doc_id, r.item_id) for r in leaks(df, held).collect()}) == want
    assert sorted({(r.doc_id, r.item_id) for r in leaks(df, held, filter_bits=6).collect()}) == want  # a filter that lets all through
    assert leaks(df.limit(0), held).count() == 0 and leaks(df, held.limit(0)).count() == 0
    assert all(r.covered >= 0.9 * r.item_words for r in leaks(df, held, 5, 0.9).collect())


def test_matches_equal_tiles_of_the_whole_texts(spark):
    """Runs of one word and reordered passages, against tiles found from the words themselves."""
    rng = random.Random(5)
    vocabulary = ["a", "b", "c"]
    items = [(i, " ".join(rng.choices(vocabulary, k=30) if i % 3 else ["a"] * rng.randrange(10, 30) + rng.choices(vocabulary, k=9))) for i in range(9)]
    documents = [(d, " ".join(rng.choices(vocabulary, k=20) + ["a"] * rng.randrange(40) + items[d % 9][1].split()[15:] + ["b"] + items[d % 9][1].split()[:15])) for d in range(30)]
    want = {}
    for d, text in documents:
        for i, s in items:
            doc, item = text.split(), s.split()
            got = tiles(doc, item, [(x, y) for x in range(len(doc) - 4) for y in range(len(item) - 4) if doc[x : x + 5] == item[y : y + 5]], 5)
            if got:
                want[d, i] = (got[0][2], len(item))
    rows = leaks(spark.createDataFrame(documents, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 5).collect()
    assert {(r.doc_id, r.item_id): (r.longest, r.item_words) for r in rows} == want and len(rows) == len(want)
    assert all(r.longest <= r.covered <= r.item_words for r in rows)

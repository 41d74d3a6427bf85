import random
from collections import Counter

from kgloom.llm.terms import marked, ngram_counts, plain_term


def brute(records, max_n, words=False):
    count, seen = Counter(), Counter()
    for record in records:
        grams = []
        for sequence in record or ():
            runs = [plain_term(t).split() for t in sequence or ()] if words else [[]]
            if not words:
                for t in sequence or ():
                    runs[-1].append(plain_term(t)) if plain_term(t) else runs.append([])
            grams += [" ".join(r[i : i + n]) + f"|{n}" for r in runs for n in range(1, max_n + 1) for i in range(len(r) - n + 1)]
        count.update(grams)
        seen.update(set(grams))
    return {g: (count[g], seen[g]) for g in count}


def test_random_sequences(spark):
    rng = random.Random(2)
    symbols = ["a", "B", " b", "c  d", "ｃ d", "", None, "\x01", "long " * 50, "é", "é"]
    records = [[[rng.choice(symbols) for _ in range(rng.randrange(9))] for _ in range(rng.randrange(3))] for _ in range(80)] + [None, [None], [[]]] + [[["a"] * 30]] * 3
    df = spark.createDataFrame([(i, r, 1) for i, r in enumerate(records)], "id long, seq array<array<string>>, term int")
    for n, words in ((1, False), (3, False), (2, True)):
        rows = ngram_counts(df.repartition(5), "seq", n, words).collect()
        got = {f"{r.term}|{r.n}": (r.occurrences, r.records) for r in rows if r.n <= n}
        assert got == brute(records, n, words)
        if words:
            whole = [[plain_term(t) for s in record or () for t in s or () if plain_term(t)] for record in records]
            assert {r.term: (r.wholes, r.whole_records) for r in rows if r.wholes} == {t: (sum(w.count(t) for w in whole), sum(t in w for w in whole)) for w in whole for t in w}
    assert ngram_counts(df.limit(0), "seq", 2).count() == 0


def test_marks(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "term string, records long")
    assert {r.term: r.mark for r in marked(df, 20).collect()} == {"a": "rare", "b": None, "c": "common"}

import pytest

from kgloom.llm.stuffing import RULES, language, stuffed

PROSE = "The question whether the summary improves the index remains open. Nobody noticed that the cache had been removed, and we could not find it again. "
STUFFED = {
    "repeated": "note " * 60, "variations": "cheap note. best note near you. buy note online. free note review. " * 12, "separators": "schema Alba | schema Bora | schema Cora | schema Dora | " * 8,
    "links": "https://a.example/x-y?id=3 www.b.example/z\n" * 15, "anchors": "[cheap notes](http://a.example/n) " * 12, "tags": "Tags: note, index, note\n#note #index\n" * 12,
    "attributes": "size: 3 / colour: red / size: 4 / sku: 77 / colour: blue / sku: 2 / " * 6, "mostly": PROSE + "kernel method, kernel method, token budget, " * 20, "list": ", ".join(f"noun{i} thing{i}" for i in range(40)),
    "de": "Garten; Kapitel; Garten; Vertrag; " * 12, "ko": "일정 계약 일정 " * 15, "zh": "实验 新的 实验 空的 " * 12, "long": "buy note " * 100_000,
}
FINE = {
    "prose": PROSE * 4, "empty": "", "null": None, "one": "TODO", "table": "| run | score | note |\n|---|---|---|\n" + "| 1 | 0.5 | 22 |\n" * 20, "sentences": "".join(f"- {s.strip()}.\n" for s in (PROSE * 4).split(".") if s.strip()),
    "some links": (PROSE + "https://a.example/x ") * 5, "glossary": "index: the list of all the words that are in the text.\nkeyword: what you write when you do not want to forget it.\n" * 5,
    "wrapped": PROSE.replace(" the ", "\n> the ") * 4, "ko": "우리는 11쪽을 읽었지만 단어장은 아직 분명하지 않다. 왜 실험이 없는지 아무도 설명하지 않았다. " * 3, "zh": "我们读了35页，但是笔记还不清楚。没有项目的合同在课上没有用。" * 4, "blank": " \n\t ",
}


def test_kinds_of_pages(spark):
    rows = [(i, k, t, "x") for i, (k, t) in enumerate([*STUFFED.items(), *FINE.items()])]
    df = spark.createDataFrame(rows, "doc_id long, kind string, text string, language string")
    got = {r.doc_id for r in stuffed(df).where("stuffed").collect()}
    assert [k for i, k, *_ in rows if i in got] == list(STUFFED)
    assert stuffed(df.limit(0)).collect() == []


def test_language():
    for lang, text in {"en": "the cat is on it", "de": "der Hund und die Katze", "fr": "le chat et les chiens sont", "es": "el gato y los perros", "ko": "우리는 읽었다", "zh": "我们读了"}.items():
        assert language(text, text.lower().split()) == lang


UNSEEN = {
    "it": "Il direttore della biblioteca ha spiegato che i lavori del nuovo archivio dureranno fino alla prossima primavera. Molti studenti preferiscono leggere nella sala grande, perché lì si trova sempre un posto libero.",
    "pt": "O diretor da biblioteca explicou que as obras do novo arquivo vão durar até a próxima primavera. Muitos alunos preferem ler na sala grande, porque ali sempre se encontra um lugar livre.",
    "nl": "De directeur van de bibliotheek legde uit dat de werken aan het nieuwe archief tot het volgende voorjaar zullen duren. Veel studenten lezen liever in de grote zaal, omdat daar altijd nog een plaats vrij is.",
    "ru": "Директор библиотеки объяснил, что работы в новом архиве продлятся до следующей весны. Многие студенты предпочитают читать в большом зале, потому что там всегда есть свободное место.",
    "pl": "Dyrektor biblioteki wyjaśnił, że prace w nowym archiwum potrwają do następnej wiosny. Wielu studentów woli czytać w dużej sali, ponieważ tam zawsze znajdzie się wolne miejsce.",
    "ja": "図書館の館長は、新しい書庫の工事が来年の春まで続くと説明した。多くの学生は大きな部屋で本を読むのが好きだ。そこにはいつも空いている席があるからである。",
}


def test_prose_in_languages_that_are_not_known_is_no_spam(spark):
    rows = [(i, t) for i, t in enumerate([*UNSEEN.values(), *[t.split(". ")[0] + "." for t in UNSEEN.values()], *[t + " " + t.replace(".", "!") for t in UNSEEN.values()]])]
    assert {r.doc_id for r in stuffed(spark.createDataFrame(rows, "doc_id long, text string")).where("stuffed").collect()} == set()


#: Pages that one rule alone catches.
ALONE = {
    "function_words": "Vector store ranking summary pipeline gradient chapter section outline keyword proof dataset. " * 2 + "The summary of the index is on the next page and we have not read it.",
    "top_word": "note for the note and the note or a note with my note on note " * 4, "top_pair": " ".join(f"the note of {w} is the note that" for w in ("all", "one", "some", "few", "two", "more", "most", "both")) + " the note",
    "separators": "the list of it, for you, and the, or my, in an, by the, of all, to be, on a, at its, from the, with one, " * 3, "repeated_lines": "\n\n".join(["where to find the best notes for all of your needs today"] * 9),
    "short": "A few notes. Read it. All of it. To do. By hand. In a day. The end. " * 3, "links": "The notes are here for you. " + "<a href='http://a.example/x'>read the notes that we wrote for you and all of the others</a>\n" * 9,
    "tags": "We wrote it for you. " + "#note #index #graph " * 9, "attributes": "We wrote it for you. " + "\n".join(f"size: {i}\ncolour: red\nsku: a{i}" for i in range(9)),
}


@pytest.mark.parametrize("rule", RULES)
def test_each_rule_decides(spark, rule):
    df = spark.createDataFrame([(1, ALONE[rule]), (2, PROSE * 3)], "doc_id long, text string")
    found = {r.doc_id: (r.stuffed, r.signs) for r in stuffed(df).collect()}
    assert found[1][0] and rule in found[1][1] and not found[2][0]
    assert not any(r.stuffed for r in stuffed(df, rules=[r for r in RULES if r != rule]).collect())


def test_a_language_is_learnt_from_its_pages(spark):
    import random

    rng = random.Random(3)
    things, deeds, small = ([f"{c}{a}{b}" for a in "aeiou" for b in "klmn"] for c in ("gor", "vit", "z"))
    say = lambda: " ".join(x for _ in range(4) for x in (rng.choice(small[:6]), rng.choice(things), rng.choice(deeds))) + ". "
    heap = lambda: " ".join(rng.choices(things, k=60))
    rows = [(i, "".join(say() for _ in range(9)), "qq") for i in range(120)] + [(i, heap(), "QQ-x") for i in range(120, 130)] + [(130, None, "qq"), (131, "", None)]
    got = {r.doc_id for r in stuffed(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("stuffed").collect()}
    assert got == set(range(120, 130))

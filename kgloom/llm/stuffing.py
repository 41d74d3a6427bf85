"""Pages stuffed with keywords, links, tags or product attributes instead of sentences.

A page is divided into links, tag lists, product attributes, table rows and pieces (sentences, lines, list items). Each
piece is measured: its share of function words, of its top word and of its top pair of words, its separators for each
word, and whether its line came before. A piece beyond a limit is a heap of keywords, and a page is stuffed if more than
half of its words stand in heaps, links, tags or attributes.

Limits are calibrated per language on the pieces of all documents that are shaped like sentences. Function words are the
given ones of six languages, and in every language with enough pages the frequent words that hardly ever stand outside
such pieces. Where a language has neither, missing function words say nothing about it, and the other limits
are those of all languages.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgloom.session import cut

WORD = re.compile(r"[^\W_]+")

# Frequent function words of the languages of the documents.
FUNCTION_WORDS = {
    "en": "a about after all although an and any are as at be because been before but by can could did do does every few first for from had has have he her his how i if in into is it its just like made me more most my no nobody not of on one only or our out over please should since so some still than that the their them then there these they this to two until up was way we were what when where which who why will with would wrote you your".split(),
    "de": "aber alle als am an auf aus bei bis da dann das dass dem den der des die doch ein eine einem einen einer eines er erklärt es für haben hat hatte ich ihr im in ist ja kann keine mit nach nicht nichts niemand noch nur ob oder ohne sein sie sich sind so um und uns unser vom von vor war warum was weil wenn wer wie wir wird wo wurde wurden zu zum zur zwei über bevor danach".split(),
    "fr": "à a après au aux avant avec bien c ce ces cette chez comme d dans de des donc du elle en encore ensuite est et eu il ils j je l la le les leur lui m mais me même n ne nous on ont ou où par parce pas personne plus pour pourquoi puis qu quand que qui quoi rien s sa sans se ses si son sont sous sur toujours tout très trop un une vous y été".split(),
    "es": "a al ante antes aunque cada como con cuando de del desde después donde dos e el ella en entre era es esta este está están esto fue ha hasta hay la las le les lo los luego mas me mi muy más nada nadie ni no nos nosotros o para pero por porque pues que quien quiere se ser si sigue sin sobre solo son su sus también te tiene todo tu un una uno y ya él".split(),
}
# Korean particles and endings, and Chinese characters that sentences are built with.
KOREAN_ENDS = ("는", "은", "을", "를", "에", "에서", "의", "로", "도", "와", "과", "다", "요", "고", "지", "지만", "면", "며", "서", "게", "까지", "부터")
CHINESE_MARKS = set("了我们你他她它这那但没有在是把请先后为什么还和不就也都很要会能把被让给从对与或着过吗呢")
# Words before the colon of a tag list, and the shapes of links.
TAG_LINE = re.compile(r"^\W*(?:tags?|keywords?|labels?|schlagw\w+|stichw\w+|mots[- ]cl\w+|étiquettes?|etiquetas?|palabras clave|标签|关键词|태그|키워드)\s*[:：](.*)$", re.I)
LINK = re.compile(r"<a\b[^>]*>.*?</a>|!?\[[^\]\n]*\]\([^)\s]*\)|\[[^\]\n]*\]:?\s*(?:https?://|www\.)\S+|(?:https?://|www\.)\S+", re.I | re.S)
HASHTAG = re.compile(r"(?<!\S)#[^\W_][\w-]*")
ATTRIBUTE = re.compile(r"(?<![\w-])([^\W\d_]{2,15}):[ \t]+([^\s,;/|·•。！？]{1,24})(?=[ \t]*(?:[,;/|·•\n]|$))")
_SENTENCE_END = re.compile(r"(?<=[.!?。！？])[\"'”»)]*(?:\s+|(?<=[。！？]))")
_TABLE = re.compile(r"^\s*\|.*\|\s*$|^[\s|:+-]*-{3,}[\s|:+-]*$")
_BULLET = re.compile(r"^\s*(?:[-*+•>|]\s+|\d+[.)]\s+|#{1,6}\s+|[QA]:\s+)+")
_HAN = re.compile(r"[一-鿿]+")
_HANGUL = re.compile(r"[가-힣]")
SEPARATORS = (",", ";", "|", "·", "•", "\n", " / ", " + ")


_FUNCTION = {lang: frozenset(words) for lang, words in FUNCTION_WORDS.items()}
_KANA = re.compile(r"[\u3040-\u30ff]")
_SPLIT = re.compile(r"[.!?。！？]")

_MARKS = ".,;:!?()[]{}<>\"'`*_#|/\\+-=&%$@~…„“”«»–—·•\t\r"
#: Pages from which a language is learnt, words that are kept of it as its own and as its function words, and languages that are learnt.
LEAST_PAGES, VOCABULARY, LEARNT, MOST_LANGUAGES = 50, 5_000, 300, 50
#: Pieces shaped like sentences from which the limits of a language are taken.
LEAST_PIECES = 200
RULES = ("function_words", "top_word", "top_pair", "separators", "repeated_lines", "short", "links", "tags", "attributes")


def language(text: str, words: list[str]) -> str:
    """The language of a text as :func:`home_language` gives it."""
    return home_language(text, words)[0]


def home_language(text: str, words: list[str], functions: dict[str, frozenset] = _FUNCTION, vocabulary: dict[str, frozenset] | None = None) -> tuple[str, bool]:
    """The language whose function words are most frequent, by script for Korean and Chinese, and whether it is sure.

    It is sure where a fifth of the words are its function words, or half of them are known as its words.
    """
    if not text.isascii():
        hangul, han = len(_HANGUL.findall(text)), sum(map(len, _HAN.findall(text)))
        if max(hangul, han) > 0.2 * (sum(map(len, words)) or 1):
            return ("ko", True) if hangul >= han else ("zh", not _KANA.search(text))
    if not words:
        return "en", False
    seen = Counter(words)
    share = {lang: sum(n for w, n in seen.items() if w in known) / len(words) for lang, known in functions.items()}
    best = max(share, key=lambda lang: (share[lang], lang == "en", lang))
    if share[best] >= 0.2:
        return best, True
    covered = {lang: sum(n for w, n in seen.items() if w in known) / len(words) for lang, known in (vocabulary or {}).items() if lang in functions}
    home = max(covered, key=lambda lang: (covered[lang], lang), default=best)
    return (home, True) if covered.get(home, 0) >= 0.5 else (best, False)


def weight(words: list[str]) -> int:
    """Number of words, three Chinese characters counting as two."""
    return len(words) + sum(len(w) * 2 // 3 - 1 for w in words if len(w) > 2 and "\u4e00" <= w[0] <= "\u9fff")


def function_words(segment: str, words: list[str], known: frozenset) -> tuple[int, float]:
    """How many words do grammatical work, and their share; in Chinese, marks in runs of five characters or more."""
    if not segment.isascii():
        han = _HAN.findall(segment)
        if han and sum(map(len, han)) * 2 > sum(map(len, words)):
            marks = sum(c in CHINESE_MARKS for r in han if len(r) >= 5 for c in r)
            return marks, marks / max(1, weight(words))
        if _HANGUL.search(segment):
            found = [w for w in words if w.endswith(KOREAN_ENDS) and len(w) > 1]
            return len(set(found)), len(found) / max(1, len(words))
    found = [w for w in words if w in known]
    return len(set(found)), len(found) / max(1, len(words))


_ANY_FUNCTION = frozenset().union(*_FUNCTION.values())


def segments(text: str) -> tuple[Counter, list[tuple[str, list[str], bool]]]:
    """Words in links, tags, attributes and tables, and the remaining pieces with their words and whether their line came before."""
    counts: Counter = Counter()

    def taken(kind: str):
        def replace(match: re.Match) -> str:
            counts[kind] += len(WORD.findall(match.group()))
            return " \x00 "

        return replace

    if "://" in text or "](" in text or "</a" in text or "</A" in text or "www." in text or "WWW." in text:
        text = LINK.sub(taken("link"), text)
    if "#" in text:
        text = HASHTAG.sub(taken("tag"), text)
    if text.count(":") >= 5:
        keys = Counter(m.group(1).lower() for m in ATTRIBUTE.finditer(text))
        usual = {k for k, n in keys.items() if n >= 2}
        if sum(keys[k] for k in usual) >= 5:
            text = ATTRIBUTE.sub(lambda m: taken("attribute")(m) if m.group(1).lower() in usual else m.group(), text)
    paragraphs: list[list[str]] = [[]]
    before: set[str] = set()
    again: set[int] = set()
    for line in text.split("\n"):
        if (":" in line or "：" in line) and (tags := TAG_LINE.match(line)) and function_words(tags.group(1), [w.lower() for w in WORD.findall(tags.group(1))], _ANY_FUNCTION)[1] < 0.15:
            counts["tag"] += len(WORD.findall(line))
            paragraphs.append([])
        elif ("|" in line or "-" in line) and _TABLE.match(line) and line.count("|") != 1:
            counts["table"] += len(WORD.findall(line))
            paragraphs.append([])
        else:
            bullet = _BULLET.match(line)
            bare = line[bullet.end() :] if bullet else line
            if not bare.strip() or "\x00" in bare and not WORD.search(bare):
                paragraphs.append([])
                continue
            plain = bare.strip()
            if plain in before and not _ends(plain) and (not paragraphs[-1] or paragraphs[-1][-1].strip() == plain):  # a line of its own, not of a wrapped paragraph
                again.add(len(paragraphs))
                paragraphs += [[bare], []]
                continue
            before.add(plain)
            if bullet and bullet.group().strip()[0] not in ">|" or paragraphs[-1] and _ends(paragraphs[-1][-1]):
                paragraphs.append([])
            paragraphs[-1].append(bare)
    pieces = []
    for at, lines in enumerate(paragraphs):
        joined = lines if len(lines) > 2 and _listlike(lines) else [" ".join(lines)]
        for part in joined:
            for piece in _SENTENCE_END.split(part) if _SPLIT.search(part) else (part,):
                words = WORD.findall(piece.lower()) if piece.isascii() else [w.lower() for w in WORD.findall(piece)]
                if words:
                    pieces.append((piece, words, at in again))
    return counts, pieces


def _ends(line: str) -> bool:
    return line.rstrip()[-1:] in tuple(".!?。！？:")


def _listlike(lines: list[str]) -> bool:
    """Lines that are items of their own instead of wrapped prose: short, without function words."""
    words = [[w.lower() for w in WORD.findall(line)] for line in lines]
    return sum(function_words(line, w, _ANY_FUNCTION)[1] < 0.15 for line, w in zip(lines, words)) > 0.6 * len(lines)


#: Below the least limits of WITHIN the shares of the top word and pair are given by what they can be at most.
PIECE = "n int, function_words float, found int, top_word float, top_pair float, separators float, ended boolean, repeated boolean"


def measures(text: str | None, functions: dict[str, frozenset] = _FUNCTION, vocabulary: dict[str, frozenset] | None = None) -> tuple[str, bool, list[int], list[tuple]]:
    """Language and whether it is sure, words in links, tags, attributes and tables, and what PIECE names of each piece."""
    counts, pieces = segments(text or "")
    every = [w for _, words, _ in pieces for w in words]
    lang, sure = home_language(text or "", every, functions, vocabulary)
    known = _ANY_FUNCTION | functions.get(lang, frozenset())  # pages quote other languages
    out = []
    for piece, words, again in pieces:
        found, share = function_words(piece, words, known)
        n = len(words)
        most = n - len(set(words)) + 1  # of which a top word can't have more
        top = 0.0 if n < 4 else most / n if most <= 0.3 * n else max(Counter(words).values()) / n
        pair = 0.0 if n < 12 else 2 * most / n if 2 * most <= 0.35 * n else 2 * max(Counter(zip(words, words[1:])).values()) / n
        ended = piece.rstrip("\"'”») \t\r")[-1:] in tuple(".!?。！？")
        out.append((n if piece.isascii() else weight(words), share, found, top, pair, sum(map(piece.count, SEPARATORS)) / n, ended, again))
    return lang, sure, [counts["link"], counts["tag"], counts["attribute"], counts["table"]], out


def learnt(df: DataFrame, text: str = "text", lang: str = "lang") -> tuple[dict[str, frozenset], dict[str, frozenset]]:
    """Function words and vocabulary of every language with at least LEAST_PAGES pages of words, from all documents.

    Languages are those the documents name, by their first two letters. Function words are at most LEARNT words of which
    at most one in fifty stands outside pieces shaped like sentences and which are at least a two-hundredth as frequent
    as the most frequent word, the vocabulary the VOCABULARY most frequent words; both sizes and the number of languages
    are bounded, whatever the corpus is.
    """
    rows = df.select(F.lower(F.substring(F.trim(F.col(lang).cast("string")), 1, 2)).alias("lang"), F.col(text).alias("t")).where("lang rlike '^[a-z]{2}$' and length(t) >= 200")
    held = [r.lang for r in rows.groupBy("lang").count().where(F.col("count") >= LEAST_PAGES).orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()]
    if not held:
        return {}, {}
    lines = F.lower("t")
    for mark in ".!?":
        lines = F.replace(lines, F.lit(f"{mark} "), F.lit(f"{mark}\n"))
    pieces = rows.where(F.col("lang").isin(held)).select("lang", F.explode(F.split(lines, "\n")).alias("p"))
    plain = F.translate("p", _MARKS, " " * len(_MARKS))
    sized = pieces.select("lang", F.right(F.rtrim("p"), F.lit(1)).isin(".", "!", "?").alias("ended"), F.split(plain, " ").alias("w"))
    words = sized.select("lang", (F.col("ended") & (F.size("w") >= 7)).cast("bigint").alias("inside"), F.explode("w").alias("word")).where("word <> ''")
    counts = words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"), F.sum("inside").alias("inside"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    often = counts.where("n >= 3").withColumn("at", F.row_number().over(order)).where(F.col("at") <= VOCABULARY).orderBy("lang", "at").collect()
    functions: dict[str, list] = {}
    vocabulary: dict[str, list] = {}
    most = {r.lang: r.n for r in reversed(often)}
    for r in often:
        if not r.word.isalpha():
            continue
        vocabulary.setdefault(r.lang, []).append(r.word)
        if r.inside >= 0.98 * r.n and 200 * r.n >= most[r.lang] and len(functions.setdefault(r.lang, [])) < LEARNT:
            functions[r.lang].append(r.word)
    return {k: frozenset(v) for k, v in functions.items()}, {k: frozenset(v) for k, v in vocabulary.items()}


def page_measures(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id and what :func:`measures` tells of every page, as columns; languages are learnt where there is a column ``lang``."""
    more, vocabulary = learnt(df, text, lang) if lang in df.columns else ({}, {})
    functions = {k: _FUNCTION.get(k, frozenset()) | more.get(k, frozenset()) for k in _FUNCTION.keys() | more.keys()}
    held = df.sparkSession.sparkContext.broadcast((functions, vocabulary))
    kinds = ("link", "tag", "attribute", "table_")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        types = (pa.int32(), pa.float32(), pa.int32(), pa.float32(), pa.float32(), pa.float32(), pa.bool_(), pa.bool_())
        names = [c.split()[0] for c in PIECE.split(", ")]
        for batch in batches:
            rows = [measures(t, *held.value) for t in batch.column(1).to_pylist()]
            flat = list(zip(*[p for r in rows for p in r[3]])) or [()] * len(types)
            offsets = [0]
            for r in rows:
                offsets.append(offsets[-1] + len(r[3]))
            inner = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(flat, types)], names=names)
            columns = [batch.column(0).cast(pa.int64()), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.bool_())]
            columns += [pa.array([r[2][i] for r in rows], pa.int32()) for i in range(len(kinds))]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), inner)], names=["doc_id", "language", "sure", *kinds, "pieces"])

    schema = f"doc_id bigint, language string, sure boolean, {', '.join(f'{k} int' for k in kinds)}, pieces array<struct<{', '.join(c.replace(' ', ': ') for c in PIECE.split(', '))}>>"
    return df.select(doc_id, text).mapInArrow(run, schema)


def usual(pages: DataFrame, accuracy: int = 1000) -> DataFrame:
    """Per language, and for all of them as '', the limits that pieces shaped like sentences keep: two fifths of the median share of function words, and what one in a hundred goes beyond of the others."""
    pieces = pages.select("language", "sure", F.explode("pieces").alias("p")).where("p.ended and p.n >= 6 and not p.repeated and p.n < 100").select("language", "sure", "p.*")
    told = [(0.4 * F.percentile_approx(F.when(F.col("sure"), F.col("function_words")), 0.5, accuracy)).alias("usual_function_words")]
    told += [F.percentile_approx(c, 0.99, accuracy).alias(f"usual_{c}") for c in ("top_word", "top_pair", "separators")]
    return pieces.rollup("language").agg(F.count(F.lit(1)).alias("n"), *told).where(F.col("n") >= LEAST_PIECES).select(F.coalesce("language", F.lit("")).alias("language"), *[f"usual_{c}" for c in FIXED])


#: Limits where there are too few pieces to measure, and the least that measured ones may be (for function words, the least and the most).
FIXED = {"function_words": 0.15, "top_word": 0.35, "top_pair": 0.5, "separators": 0.4}
WITHIN = {"function_words": (0.08, 0.2), "top_word": (0.3, 0.4), "top_pair": (0.35, 0.6), "separators": (0.25, 0.5)}


def stuffed(df: DataFrame, share: float = 0.5, least_words: int = 5, rules: Sequence[str] = RULES) -> DataFrame:
    """Every page with its language, words in links, tags, attributes, tables, sentences and heaps, spam_share, signs and stuffed.

    A piece is a heap if it has under four words (short), a smaller share of function words than its language's limit or
    only one in a short piece (function_words; not where the page's language isn't sure), a top word, pair of words or
    separators beyond their limits, or if its line came before and ends no sentence (repeated_lines). spam_share is the
    share of words in heaps, links, tags and attributes; a page is stuffed if it is above ``share`` and the page has at
    least ``least_words`` words. signs lists the rules that caught words. Only ``rules`` are applied. Null, empty and
    one-word texts are not stuffed. Where fewer than LEAST_PIECES pieces can be measured, fixed limits stand in.
    """
    pages = cut(page_measures(df))
    limits = cut(usual(pages))  # one row for each language
    whole = limits.where("language = ''").select(*[F.col(f"usual_{c}").alias(f"all_{c}") for c in FIXED])
    known = pages.join(F.broadcast(limits.where("language <> ''").limit(MOST_LANGUAGES + len(_FUNCTION) + 2)), "language", "left").join(F.broadcast(whole), F.lit(True), "left")  # one row
    limit = {c: F.least(F.greatest(F.coalesce(f"usual_{c}", *([f"all_{c}"] if c != "function_words" else []), F.lit(v)), F.lit(WITHIN[c][0])), F.lit(WITHIN[c][1])) for c, v in FIXED.items()}
    known = known.withColumns({f"limit_{c}": v for c, v in limit.items()})
    beyond = {
        "short": "p.n < 4", "function_words": "sure and p.n >= 4 and (p.function_words < limit_function_words or p.found < 2 and p.n < 6)", "top_word": "p.n >= 6 and p.top_word > limit_top_word",
        "top_pair": "p.n >= 12 and p.top_pair > limit_top_pair", "separators": "p.n >= 6 and p.separators > limit_separators", "repeated_lines": "p.repeated",
    }
    sums = {name: F.expr(f"aggregate(pieces, 0, (s, p) -> s + if({rule}, p.n, 0))") for name, rule in beyond.items() if name in rules}
    anyhow = " or ".join(f"({rule})" for name, rule in beyond.items() if name in rules) or "false"
    judged = known.withColumns({"loose": F.expr(f"aggregate(pieces, 0, (s, p) -> s + if({anyhow}, p.n, 0))"), "of_pieces": F.expr("aggregate(pieces, 0, (s, p) -> s + p.n)")} | {f"by_{n}": c for n, c in sums.items()})
    others = {"links": "link", "tags": "tag", "attributes": "attribute"}
    spam = sum((F.col(c) for n, c in others.items() if n in rules), F.col("loose"))
    words = F.col("of_pieces") + F.col("link") + F.col("tag") + F.col("attribute") + F.col("table_")
    judged = judged.withColumns({"words": words, "sentence": F.col("of_pieces") - F.col("loose"), "signs": F.array_compact(F.array(*[F.when(F.col(f"by_{n}") > 0, n) for n in sums], *[F.when(F.col(c) > 0, n) for n, c in others.items() if n in rules], F.lit(None).cast("string")))})
    judged = judged.withColumn("spam_share", F.when(F.col("words") > 0, spam / F.col("words")).otherwise(0.0))
    judged = judged.withColumn("stuffed", (F.col("spam_share") > share) & (F.col("words") >= least_words))
    return judged.select("doc_id", "language", "sure", "words", "link", "tag", "attribute", "table_", "sentence", "loose", "spam_share", "signs", "stuffed")

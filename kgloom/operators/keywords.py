"""Keywords of texts: candidate terms, their ranks, and what is done to a ranked list before it is kept."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgloom.functions.text import grams, topic_tokens
from kgloom.operators.similarity import dot, norm

CAMEL = re.compile(r"\b[a-z]+(?:[A-Z][a-z0-9]+)+\b|\b(?:[A-Z][a-z0-9]+){2,}\b")
SNAKE = re.compile(r"\b[a-z0-9]+(?:_[a-z0-9]+)+\b")
FORMULA = re.compile(r"\\[a-zA-Z]+|[a-z]\s*=\s*[a-z0-9]|\b(?:integral|derivative|gradient|matrix|theorem|equation)\b")


@dataclass(frozen=True)
class Rules:
    """Word tables and weights for keyword lists; all tables may be empty."""

    code_noise: frozenset[str] = frozenset({"def", "return", "import", "const", "var", "null", "true", "false", "self"})
    generic: frozenset[str] = frozenset({"thing", "example", "question", "answer", "topic", "way", "case"})
    hints: frozenset[str] = frozenset()
    longest_phrase: int = 96
    most_tokens: int = 8
    most_formulas: int = 2
    duplicate: float = 0.8
    weights: dict = field(default_factory=lambda: {"formula": 0.05, "identifier": 0.05, "hint": 0.04, "code": -0.06, "generic": -0.12, "noise": -0.18})


def is_noise(term: str, rules: Rules = Rules()) -> bool:
    """Too long, without letters, or made only of code words, ids or numbers."""
    tokens = term.split()
    if not tokens or len(tokens) > rules.most_tokens or len(term) > rules.longest_phrase or not re.search(r"[^\W\d_]", term):
        return True
    return all(t in rules.code_noise or re.fullmatch(r"[0-9a-f]{6,}|\d+|id|uuid", t) for t in tokens)


def rescored(term: str, score: float, rules: Rules = Rules()) -> float:
    tokens, w = term.split(), rules.weights
    score += w["formula"] * bool(FORMULA.search(term)) + w["identifier"] * bool(CAMEL.search(term) or SNAKE.search(term)) + w["hint"] * any(t in rules.hints for t in tokens)
    score += w["code"] * any(t in rules.code_noise for t in tokens) + w["generic"] * (sum(t in rules.generic for t in tokens) >= 0.4 * max(1, len(tokens))) + w["noise"] * (is_noise(term, rules) and not FORMULA.search(term))
    return score


def selected(pairs: Sequence[tuple[str, float]], most: int, rules: Rules = Rules()) -> list[tuple[str, float]]:
    """The best ``most`` terms after rescoring, none sharing ``duplicate`` of its tokens with a better one, few of them formulas."""
    best: dict[str, float] = {}
    for term, score in pairs:
        term = " ".join((term or "").split())
        if term and (term not in best or best[term] < score):
            best[term] = score
    ranked = sorted(((t, round(rescored(t, s, rules), 6)) for t, s in best.items() if not is_noise(t, rules)), key=lambda p: (-p[1], p[0]))
    out: list[tuple[str, float]] = []
    sets: list[set] = []
    formulas = 0
    for term, score in ranked:
        tokens = set(term.split()) or set(term)
        if any(len(tokens & s) >= rules.duplicate * len(tokens | s) for s in sets):
            continue
        if FORMULA.search(term):
            if formulas >= rules.most_formulas:
                continue
            formulas += 1
        out.append((term, score))
        sets.append(tokens)
        if len(out) >= most:
            break
    return out


def identifiers(text: str, most: int = 10) -> list[tuple[str, float]]:
    """Code identifiers by frequency, camel and snake case counting twice, scored from 0.60 down."""
    counts: dict[str, float] = {}
    for pattern in (CAMEL, SNAKE):
        for name in pattern.findall(text or ""):
            counts[name] = counts.get(name, 0) + 2
    ranked = sorted(counts, key=lambda n: (-counts[n], n))[:most]
    return [(n, round(0.60 - 0.015 * i, 6)) for i, n in enumerate(ranked)]


def formulas(text: str, most: int = 5) -> list[tuple[str, float]]:
    found = dict.fromkeys(m.group().strip() for m in FORMULA.finditer((text or "").lower()))
    return [(n, round(0.62 - 0.015 * i, 6)) for i, n in enumerate(list(found)[:most])]


def text_grams(df: DataFrame, key: str, text: str, most_n: int = 3) -> DataFrame:
    """``key`` and term of every gram of every text; tokens are a column of their own, or each gram would split the text again."""
    tokens = df.select(key, topic_tokens(text).alias("_tokens")).where(F.size("_tokens") > 0)
    return tokens.select(key, F.explode(grams(F.col("_tokens"), most_n)).alias("term"))


def gram_counts(df: DataFrame, key: str, text: str, most_n: int = 3, most: int = 100) -> DataFrame:
    """``key``, term, n and rank of each text's most frequent grams; equal ones in alphabetical order."""
    rows = text_grams(df, key, text, most_n).groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "term"))).where(F.col("rank") <= most)


def embedded_keywords(df: DataFrame, key: str, text: str, vector: str, embed, most: int = 5, most_n: int = 3) -> DataFrame:
    """``key``, term, score and rank: each text's grams nearest to its vector by cosine, four times ``most`` before selection.

    Every distinct gram of the corpus is embedded once and joined back.
    """
    terms = text_grams(df, key, text, most_n).distinct()
    known = terms.select("term").distinct().withColumn("tv", embed("term"))
    rows = terms.join(known, "term").join(df.select(key, F.col(vector).alias("dv")), key)
    size = norm("tv") * norm("dv")
    scored = rows.select(key, "term", F.round(F.when(size > 0, dot("tv", "dv") / size).otherwise(0.0), 4).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "term"))).where(F.col("rank") <= 4 * most)


def kept_keywords(ranked: DataFrame, texts: DataFrame, key: str, text: str, most: int = 5, rules: Rules = Rules()) -> DataFrame:
    """``key`` and keywords (term, score) from ranked terms (key, term, score), with identifiers and formulas of the text, selected."""
    kind = texts.schema[key].dataType.simpleString()
    listed = ranked.groupBy(key).agg(F.collect_list(F.struct("term", "score")).alias("pairs"))  # bounded by the rank of what is passed in

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for frame in batches:
            out = []
            for k, t, pairs in zip(frame[key], frame[text], frame["pairs"]):
                every = [(p["term"], float(p["score"])) for p in (pairs if pairs is not None else [])] + formulas(t) + identifiers(t)
                out.append((k, [{"term": a, "score": b} for a, b in selected(every, most, rules)]))
            yield pd.DataFrame(out, columns=[key, "keywords"])

    return texts.select(key, text).join(listed, key, "left").mapInPandas(run, f"`{key}` {kind}, keywords array<struct<term: string, score: double>>")

"""Queries of the problems that have no SQL, against expectations worked out in plain Python over the whole tables."""

import os
from collections import Counter, defaultdict

import pandas as pd
import pytest

from kgloom.llm.leaks import tiles, words_of
from kgloom.llm.queries import QUERIES
from tests.compare import FOLDER

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def rows(spark, name):
    return QUERIES[name](spark, FOLDER).collect()


def read(name):
    return pd.read_parquet(f"{FOLDER}/{name}.parquet")


def test_pieces_rebuild_every_section(spark):
    last: dict = {}
    for r in read("sections").sort_values("loaded_at", kind="stable").itertuples():
        last[r.section_id.strip()] = (r.content or "").strip(" \t\r\n")
    pieces = defaultdict(list)
    for r in rows(spark, "p3_pieces"):
        if r.item_kind == "section":
            pieces[r.item_key].append((r.piece, r.start, r.end, r.content))
    assert set(pieces) == {k for k, t in last.items() if t}
    for key, found in pieces.items():
        found.sort()
        text = last[key]
        assert [p[0] for p in found] == list(range(len(found))) and found[0][1] == 0 and found[-1][2] == len(text)
        assert all(text[a:b] == c and b - a <= 1500 for _, a, b, c in found)
        assert all(a[1] < b[1] <= a[2] < b[2] and a[2] - b[1] <= 150 for a, b in zip(found, found[1:]))


def test_coverage_equals_tiles_of_the_words(spark):
    items = {r.item_id: words_of(r.text) for r in read("eval_items").itertuples()}
    seeds = defaultdict(list)
    for i, words in items.items():
        for j in range(len(words) - 5):
            seeds[tuple(words[j : j + 6])].append((i, j))
    want = {}
    for r in read("documents").itertuples():
        words, pairs = words_of(r.text), defaultdict(list)
        for at in range(len(words) - 5):
            for i, j in seeds.get(tuple(words[at : at + 6]), ()):
                pairs[i].append((at, j))
        for i, found in pairs.items():
            got = tiles(words, items[i], found, 6)
            covered = sum(n for *_, n in got)
            if covered >= 0.6 * len(items[i]):
                want[r.doc_id, i] = (got[0][2], len(items[i]))
    got = rows(spark, "p8_coverage")
    assert {(r.doc_id, r.item_id): (r.longest, r.item_words) for r in got} == want and want


def test_report_matches_the_mix(spark):
    mixed, report = rows(spark, "p9_mix"), {r.source: r for r in rows(spark, "p9_report")}
    tokens, uses = Counter(), Counter()
    for r in mixed:
        tokens[r.source] += r.n_tokens
        uses[r.doc_id] += 1
    documents = read("documents")
    documents["source"] = documents.source.str.strip().str.lower()
    there = {r.source for r in report.values() if r.target_share and r.available_tokens}
    whole, share = sum(tokens.values()), sum(report[s].target_share for s in there)
    largest = documents.assign(n=documents.text.str.len().fillna(0)).groupby("source").n.max()
    for source, r in report.items():
        assert r.mix_tokens == tokens[source] and abs(r.actual_share - tokens[source] / whole) < 1e-9
        if source in there:
            assert abs(tokens[source] - whole * r.target_share / share) <= largest[source] + 0.05 * tokens[source] and r.repeats <= r.max_repeats + 1e-9
    most = documents.set_index("doc_id").source.map({s: r.max_repeats for s, r in report.items()})
    assert all(n <= most[d] for d, n in uses.items())


def test_clusters_and_groups_are_described_whole(spark):
    found = defaultdict(set)
    for r in rows(spark, "p1_found"):
        found[r.group_id].add(r.id)
    groups = rows(spark, "p1_groups")
    assert {r.group_id: r["size"] for r in groups} == {k: len(v) for k, v in found.items()}
    assert all(set(r.typical_ids) <= found[r.group_id] and len(r.typical_ids) == min(5, r["size"]) for r in groups)
    usable = {r.id for r in QUERIES["p4_neighbours"](spark, FOLDER).select("id").collect()}
    clusters = rows(spark, "p1_clusters")
    assert sum(r["size"] for r in clusters) == len(usable) and all(0 < r.confidence <= 1 and set(r.typical_ids) <= usable for r in clusters)


def test_measures_add_up(spark):
    got = {r.doc_id: r for r in rows(spark, "p10_measures")}
    assert set(got) == set(read("documents").doc_id)
    for r in got.values():
        assert r.words == r.sentence + r.loose + r.link + r.tag + r.attribute + r.table_ and 0 <= r.spam_share <= 1
        assert r.stuffed == (r.spam_share > 0.5 and r.words >= 5)
    assert {r.doc_id for r in rows(spark, "p10_found")} == {d for d, r in got.items() if r.stuffed}

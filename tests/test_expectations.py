"""Queries without SQL, against expectations worked out in plain Python over the whole tables."""

import json
import os
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

import __spark_entry__
from kgloom.operators.sequence import recursive_chunks, sentence_chunks, wrapped_chunks
from tests.compare import FOLDER

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def rows(spark, name):
    return __spark_entry__.queries()[name](spark, FOLDER).collect()


def read(name):
    return pd.read_parquet(f"{FOLDER}/{name}.parquet")


@pytest.fixture(scope="module")
def links(spark):
    return {(r.kind, r.rec_id, r.parent_key, r.child_key) for r in rows(spark, "p2_found")}


def test_micro_nodes_are_the_links_of_their_blocks(spark, links):
    got = rows(spark, "p2_micro_nodes")
    assert {(r.rec_id, r.parent_key or "", r.key) for r in got} == {x[1:] for x in links if x[0] == "micro_node"}
    assert all(0 <= r.parent_pre < r.pre for r in got if r.parent_key is not None)


def test_messages_lie_in_their_entries(spark, links):
    got = rows(spark, "p2_messages")
    want = Counter()
    for r in read("chat_exports").itertuples():
        root = r.mapping
        while isinstance(root, str):
            try:
                root = json.loads(root.lstrip("﻿"))
            except ValueError:
                root = None
        for value in (root.values() if isinstance(root, dict) else root or ()):
            if isinstance(value, str) and value[:1] == "{":
                value = json.loads(value)
            message = value.get("message") if isinstance(value, dict) else None
            if isinstance(message, str) and message[:1] == "{":
                message = json.loads(message)
            want[r.export_id] += isinstance(message, dict)
    assert Counter(r.rec_id for r in got) == +want
    assert {(r.rec_id, r.parent_key) for r in got if r.parent_key is not None} <= {(x[1], x[3]) for x in links if x[0] == "mapping"}


def test_batches_keep_their_cap(spark):
    got, tokens = rows(spark, "f10_batches"), {}
    for r in read("sections").itertuples():
        tokens.setdefault(r.section_id.strip(), set()).add(-(-len(r.content or "") // 4))
    sums = defaultdict(list)
    for r in got:
        sums[r.source_id, r.batch].append(max(tokens[r.section_id.strip()]))
    assert all(len(v) == 1 or 150 + sum(v) + 100 <= 2000 for v in sums.values())
    for source in {s for s, _ in sums}:
        numbers = sorted(b for s, b in sums if s == source)
        assert numbers == list(range(len(numbers)))


@pytest.mark.parametrize("name, cut", [("f11_sentence_chunks", lambda t: sentence_chunks(t, 512)), ("f12_recursive_chunks", lambda t: recursive_chunks(t, 400)), ("f13_wrapped_chunks", lambda t: wrapped_chunks(t, 1500))])
def test_chunks_of_every_document(spark, name, cut):
    want = {(r.doc_id, i, len(c)) for r in read("documents").itertuples() for i, c in enumerate(cut(r.text))}
    assert {(r.doc_id, r.pos, r.chars) for r in rows(spark, name)} == want


def test_refined_clusters_account_for_every_vector(spark):
    labels = read("embeddings").set_index("vec_id").label.to_dict()
    got = {r.node: r for r in rows(spark, "j1_refined_clusters")}
    assert set(got) == set(labels) and all(str(labels[n]) == str(r.cluster_before) for n, r in got.items())
    sizes = Counter(r.cluster for r in got.values())
    stats = {r.cluster: (r["size"], r.came) for r in rows(spark, "j2_refine_stats")}
    assert stats == {c: (n, sum(r.cluster == c != r.cluster_before for r in got.values())) for c, n in sizes.items()}


def edges():
    table = read("embeddings")
    x = np.stack(table.embedding).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    return table.vec_id.tolist(), table.label.tolist(), x @ x.T


def test_communities_and_cliques(spark):
    ids, labels, cosine = edges()
    place = {v: i for i, v in enumerate(ids)}
    from kgloom.queries.graph import MEDIUM

    found = rows(spark, "j3_louvain")
    assert len({r.node for r in found}) == len(found) and all(str(labels[place[r.node]]) == r.group for r in found)
    inside = defaultdict(list)
    for r in found:
        inside[r.group, r.community].append(place[r.node])
    for part in inside.values():  # all of a community hang together
        seen, todo = {part[0]}, [part[0]]
        while todo:
            a = todo.pop()
            fresh = [b for b in part if b not in seen and cosine[a, b] >= MEDIUM - 1e-9]
            seen.update(fresh)
            todo += fresh
        assert seen == set(part)
    cliques = defaultdict(set)
    for r in rows(spark, "j5_cliques"):
        cliques[r.group, r.community].add(place[r.node])
    assert all(len(c) >= 3 for c in cliques.values())


def test_density_clusters_of_every_vector(spark):
    ids, labels, cosine = edges()
    got = {r.vec_id: r for r in rows(spark, "k3_density_clusters")}
    assert set(got) == set(ids) and all(got[v].label == label for v, label in zip(ids, labels))
    assert all(n >= 3 for (_, c), n in Counter((r.label, r.cluster) for r in got.values()).items() if c >= 0)


def test_names_by_type_are_unique(spark):
    got = rows(spark, "e19_names_by_type")
    plain = [(r.type, " ".join(r.name.lower().split())) for r in got]
    assert len(set(plain)) == len(plain)
    seen = {(r.rec_id, r.key) for r in rows(spark, "p2_micro_nodes")}
    assert {r.name for r in got} <= {k for _, k in seen}


def test_every_node_has_a_cluster_by_words_or_is_new(spark):
    got = rows(spark, "k6_by_words")
    assert sum(r.n for r in got) == read("graph_nodes").id.nunique() and all((r.cluster_id is None) == r.is_new for r in got)


def test_cleaned_texts(spark):
    import re
    import unicodedata

    texts = read("documents").set_index("doc_id").text.to_dict()
    got = {r.doc_id: r.cleaned for r in rows(spark, "i1_cleaned")}
    assert set(got) == set(texts)
    assert all(not re.search(r"<[a-zA-Z/][^>]*>", c) and c == unicodedata.normalize("NFKC", c) for c in got.values() if c)
    changed = Counter(unicodedata.normalize("NFKC", t) != t for t in texts.values() if t is not None)
    assert {r.changed: r.n for r in rows(spark, "i1_nfkc_changes")} == dict(changed)

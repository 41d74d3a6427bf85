"""Frequency of every term and of every n-gram of terms.

Each position of a sequence gives one suffix, cut to ``max_n`` terms, except for the first one. Suffixes go to the task of their first term (a hot
first term spreads by its second one), are sorted in reverse lexicographic order, and one pass with a stack of the open
prefixes adds up the counts of all n-grams. A suffix also carries, per length, whether its prefix is that record's first
occurrence; summed, these give the number of records, without sets of records that could outgrow a task. A task sums equal suffixes before they travel, so a hot one is a row a task.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Between the terms of an n-gram.
JOINT = "\x1f"
#: Suffixes that a task holds before it passes their sums on.
HELD = 200_000
_SPACE = re.compile(r"\s+")


def plain_term(term: str | None) -> str:
    """NFKC, lower case, trimmed, white space squeezed; '' for null."""
    return _SPACE.sub(" ", unicodedata.normalize("NFKC", term).lower()).strip() if term else ""


def ngram_counts(df: DataFrame, sequences: str, max_n: int = 1, words: bool = False) -> DataFrame:
    """term, n, occurrences and records of every n-gram of up to ``max_n`` terms, with wholes and whole_records.

    Each row of ``df`` is a record and holds an array of arrays of strings; n-grams don't cross its inner arrays. Terms
    are compared as :func:`plain_term` gives them; null and empty ones end a run, as do null arrays. With ``words`` each
    string is a run of its words instead of one term. The terms of an n-gram are joined by a space. wholes counts the
    runs that consist of just these terms, whole_records the records with such a run; runs longer than ``max_n`` have
    rows of their own, in which occurrences and records are null. Terms of any length and number are counted; an empty
    table gives an empty table.
    """
    firsts = ", ".join(f"f{i} bigint" for i in range(1, max_n + 1))
    sums = ["c", "w", "wf", *[f"f{i}" for i in range(1, max_n + 1)]]

    def suffixes(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: dict[str, list[int]] = {}
        known: dict[str | None, str] = {}

        def flush():
            rows = list(held.items())
            columns = [pa.array([k for k, _ in rows], pa.string()), *[pa.array([v[i] for _, v in rows], pa.int64()) for i in range(len(sums))]]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=["suffix", *sums])

        for batch in batches:
            if len(known) > HELD:
                known.clear()
            for record in batch.column(0).to_pylist():
                seen: set[str] = set()
                seen_whole: set[str] = set()
                runs: list[list[str]] = []
                for sequence in record or ():
                    run: list[str] = []
                    for raw in sequence or ():
                        term = known.get(raw)
                        if term is None:
                            term = known[raw] = plain_term(raw)
                        if words:
                            runs.append(term.split())
                        elif term:
                            run.append(term)
                        else:
                            runs.append(run)
                            run = []
                    runs.append(run)
                for run in runs:
                    for at in range(len(run)):
                        prefix, flags = "", []
                        for term in run[at : at + max_n]:
                            prefix = prefix + JOINT + term if flags else term
                            flags.append(prefix not in seen)
                            seen.add(prefix)
                        if not at:  # the suffix that is the whole run is never cut
                            prefix = JOINT.join(run)
                        if (own := held.get(prefix)) is None:
                            own = held[prefix] = [0] * len(sums)
                        own[0] += 1
                        if not at:
                            own[1] += 1
                            own[2] += prefix not in seen_whole
                            seen_whole.add(prefix)
                        for i, new in enumerate(flags, 3):
                            own[i] += new
                if len(held) > HELD:
                    yield flush()
        yield flush()

    def aggregate(batches: Iterator) -> Iterator:
        import pyarrow as pa

        stack: list[list] = []  # term, occurrences, records, wholes, records of these
        out: list[tuple] = []
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())

        def pop():
            term, count, records, wholes, whole_records = stack.pop()
            if (n := len(stack) + 1) <= max_n or wholes:
                counted = (count, records) if n <= max_n else (None, None)
                out.append((" ".join([*(s[0] for s in stack), term]), n, *counted, wholes, whole_records))
            if stack:
                stack[-1][1] += count

        def emit():
            columns = [pa.array(list(c), t) for c, t in zip(zip(*out), kinds)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=["term", "n", "occurrences", "records", "wholes", "whole_records"])

        for batch in batches:
            for suffix, count, wholes, whole_records, *flags in zip(*[c.to_pylist() for c in batch.columns]):
                terms = suffix.split(JOINT)
                same = 0
                while same < min(len(stack), len(terms)) and stack[same][0] == terms[same]:
                    same += 1
                while len(stack) > same:
                    pop()
                for term in terms[same:]:
                    stack.append([term, 0, 0, 0, 0])
                stack[-1][1] += count
                stack[-1][3] += wholes
                stack[-1][4] += whole_records
                for entry, new in zip(stack, flags):
                    entry[2] += new
            if out:
                yield emit()
        while stack:
            pop()
        if out:
            yield emit()

    found = df.select(sequences).mapInArrow(suffixes, f"suffix string, c bigint, w bigint, wf bigint, {firsts}")
    terms = F.split("suffix", JOINT)
    route = F.xxhash64(terms[0], F.pmod(F.xxhash64(F.get(terms, 1)), F.lit(64)))
    routed = found.repartition(route).sortWithinPartitions(F.desc("suffix"))
    partial = routed.mapInArrow(aggregate, "term string, n int, occurrences bigint, records bigint, wholes bigint, whole_records bigint")
    return partial.groupBy("term", "n").agg(*[F.sum(c).alias(c) for c in ("occurrences", "records", "wholes", "whole_records")])


def marked(counts: DataFrame, records: int, common: float = 0.1) -> DataFrame:
    """``counts`` with mark: rare for terms of one record, common for those of more than a share ``common`` of ``records``."""
    return counts.withColumn("mark", F.when(F.col("records") > common * records, "common").when(F.col("records") == 1, "rare"))

"""Order-dependent operators; groups may be of any size unless an operator names its bound."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgloom.operators.ranking import numbered, running_sum
from kgloom.session import cut


def with_previous(df: DataFrame, group: Sequence[str], order: Sequence[str], values: Sequence[str], position: str = "position") -> DataFrame:
    """``df`` with ``position`` in its group and prev_{value} of the row before; null on a group's first row.

    Rows are numbered by range and joined by number, so that a hot group is never sorted in one task.
    """
    rows = cut(numbered(df, group, order, position))
    before = rows.select(*group, (F.col(position) + 1).alias(position), *[F.col(v).alias(f"prev_{v}") for v in values])
    return rows.join(before, [*group, position], "left")


def question_answer_pairs(messages: DataFrame, group: Sequence[str], order: Sequence[str], role: str = "role", text: str = "content", least_question: int = 5, least_answer: int = 20) -> DataFrame:
    """``group``, qa_index, question and answer: user messages right before an assistant's, other roles aside.

    qa_index counts all pairs of a conversation in order, so what is left out for length leaves gaps.
    """
    talk = messages.where(F.col(role).isin("user", "assistant"))
    rows = with_previous(talk, group, order, [role, text])
    pairs = rows.where((F.col(role) == "assistant") & (F.col(f"prev_{role}") == "user"))
    counted = numbered(pairs.select(*group, "position", F.col(f"prev_{text}").alias("question"), F.col(text).alias("answer")), group, ["position"], "qa_index")
    return counted.where((F.length("question") >= least_question) & (F.length("answer") >= least_answer)).select(*group, "qa_index", "question", "answer")


def within_budget(df: DataFrame, group: Sequence[str], order: Sequence[str], cost: Column, budget: int) -> DataFrame:
    """Rows of each group, in order, up to the first with which the summed cost exceeds ``budget``; rows of no cost are left out."""
    costly = df.withColumn("_cost", cost).where("_cost > 0")
    before = running_sum(costly, group, order, F.col("_cost"), "_before")
    return before.withColumn("running", F.col("_before") + F.col("_cost")).where(F.col("running") <= budget).drop("_cost", "_before")


def packed_batches(df: DataFrame, group: Sequence[str], order: str, cost: str, cap: int, base: int = 0, slack: int = 100) -> DataFrame:
    """``group``, ``order`` and batch: consecutive rows share a batch until the next would bring base + costs + slack above ``cap``.

    A fold over the ordered rows of a group, which must be one document's.
    """
    rows = df.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(cost).cast("bigint").alias("c")))).alias("rows"))
    start = F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(0).alias("batch"), F.expr("cast(array() as array<int>)").alias("out"))

    def step(state, row):
        full = (F.size(state["out"]) > 0) & (F.lit(base) + state["sum"] + row["c"] + slack > cap)
        batch = F.when(full, state["batch"] + 1).otherwise(state["batch"])
        return F.struct(F.when(full, row["c"]).otherwise(state["sum"] + row["c"]).alias("sum"), batch.alias("batch"), F.concat(state["out"], F.array(batch)).alias("out"))

    placed = rows.select(*group, "rows", F.aggregate("rows", start, step)["out"].alias("batches"))
    return placed.select(*group, F.inline(F.arrays_zip(F.transform("rows", lambda r: r["o"]).alias(order), F.col("batches").alias("batch"))))


def sentence_chunks(text: str | None, most: int = 512) -> list[str]:
    """Whole sentences packed into pieces of at most ``most`` characters; longer sentences cut hard."""
    import re

    text = text or ""
    if len(text) <= most:
        return [text] if text else []
    out, held = [], ""
    for part in filter(None, map(str.strip, re.split(r"(?<=[.!?。？！])\s+", text))):
        joined = f"{held} {part}" if held else part
        if len(joined) <= most:
            held = joined
            continue
        if held:
            out.append(held)
        held = part if len(part) <= most else ""
        if not held:
            out.extend(filter(None, (part[i : i + most].strip() for i in range(0, len(part), most))))
    return [*out, held] if held else out


def wrapped_chunks(text: str | None, most: int = 1500) -> list[str]:
    """Words packed greedily into lines of at most ``most`` characters; a longer word is a line of its own."""
    out: list[str] = []
    for word in (text or "").split():
        if out and len(out[-1]) + 1 + len(word) <= most:
            out[-1] += f" {word}"
        else:
            out.append(word)
    return out


def recursive_chunks(text: str | None, most: int = 400, overlap: int = 80, separators: Sequence[str] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Pieces of at most ``most`` characters, split at the strongest separator that is there, consecutive ones sharing up to ``overlap``."""
    text = text or ""
    if not text.strip():
        return []
    sign = next(s for s in separators if s == "" or s in text)
    rest = separators[separators.index(sign) + 1 :] if sign else ()
    out: list[str] = []
    held: list[str] = []
    size = 0

    def close():
        nonlocal held, size
        if joined := sign.join(held).strip():
            out.append(joined)
        while held and (size > overlap or not held[0]):
            size -= len(held[0]) + (len(sign) if len(held) > 1 else 0)
            held = held[1:]

    for part in text.split(sign) if sign else list(text):
        if len(part) > most:
            if held:
                close()
                held, size = [], 0
            out.extend(recursive_chunks(part, most, overlap, rest))
            continue
        if held and size + len(sign) + len(part) > most:
            close()
            while held and size + len(sign) + len(part) > most:
                size -= len(held[0]) + (len(sign) if len(held) > 1 else 0)
                held = held[1:]
        size += len(part) + (len(sign) if held else 0)
        held.append(part)
    if joined := sign.join(held).strip():
        out.append(joined)
    return out


CHUNKERS = {"sentences": sentence_chunks, "words": wrapped_chunks, "recursive": recursive_chunks}


def chunked(df: DataFrame, key: str, text: str, method: str = "sentences", most: int = 512) -> DataFrame:
    """``key``, pos and chunk of every text by one of :data:`CHUNKERS`."""
    cut_one = CHUNKERS[method]
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            origin, pos, out = [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                for p, c in enumerate(cut_one(t, most)):
                    origin.append(i), pos.append(p), out.append(c)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(origin, pa.int32())), pa.array(pos, pa.int32()), pa.array(out, pa.string())], names=[key, "pos", "chunk"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, pos int, chunk string")

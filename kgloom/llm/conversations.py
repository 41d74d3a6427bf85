"""Rebuilding conversations from message rows.

Rows are an event log: creates, edits, soft deletes and retries of a message are folded by version into its last state.
The folded messages of a conversation are then checked (every named parent present, no circle, every user message
answered) and put in order. Conversations of up to ``SMALL`` messages are checked many at a time on flat arrays, in one
Arrow batch; larger ones, however large, by tree contraction.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.operators.contraction import contract_forest
from kgloom.operators.current import current_rows, trimmed
from kgloom.session import cut

#: Messages up to which a conversation is checked in an Arrow batch.
SMALL = 2_000
USER, ASSISTANT = ("user", "human"), ("assistant", "ai", "model")
#: Why a conversation is dropped, as bits.
BROKEN, EMPTY, UNANSWERED = 1, 2, 4


def speaker(role: Column) -> Column:
    """user, assistant, or the role itself in lower case."""
    plain = F.lower(trimmed(role))
    return F.when(plain.isin(*USER), "user").when(plain.isin(*ASSISTANT), "assistant").otherwise(plain)


def fold_events(df: DataFrame) -> DataFrame:
    """The last state of each message: conversation_id, msg_id, parent_id (null where blank), kind, created_at, row_id.

    kind is 1 for a usable user message, 2 for a usable assistant message, 3 for another usable one and 0 for one that is
    deleted or has neither letter nor digit. Rows without a conversation or message id belong nowhere and are left out.
    """
    named = df.select(
        trimmed("conversation_id").alias("conversation_id"), trimmed("msg_id").alias("msg_id"), F.nullif(trimmed("parent_id"), F.lit("")).alias("parent_id"), "loaded_at", "row_id", "created_at",
        F.when(F.col("deleted_at").isNotNull() | ~F.coalesce(F.col("content").rlike(r"[\p{L}\p{N}]"), F.lit(False)), 0)
        .when(speaker(F.col("role")) == "user", 1).when(speaker(F.col("role")) == "assistant", 2).otherwise(3).cast("tinyint").alias("kind"),
    )
    return current_rows(named.where("conversation_id <> '' and msg_id <> ''"), ["conversation_id", "msg_id"], ["loaded_at", "row_id"], ["parent_id", "kind", "created_at", "row_id"])


def verdicts(messages: DataFrame, small: int = SMALL, turns: bool = False) -> DataFrame:
    """What :func:`fold_events` gives, judged: conversation_id and faults (0: keep), or with ``turns`` each kept message
    with its depth beneath its root, as conversation_id, row_id, depth, created_at, msg_id.

    An empty table gives an empty table.
    """
    messages = cut(messages)
    sizes = messages.groupBy("conversation_id").count()
    large = sizes.where(F.col("count") > small).select("conversation_id")
    fields = ["msg_id", "parent_id", "kind", *(["row_id", "created_at"] if turns else [])]
    lists = messages.join(large, "conversation_id", "left_anti").groupBy("conversation_id").agg(F.collect_list(F.struct(*fields)).alias("rows"))
    if turns:
        few = lists.mapInArrow(_judge_turns, "conversation_id string, row_id bigint, depth int, created_at timestamp, msg_id string")
    else:
        few = lists.mapInArrow(_judge, "conversation_id string, faults int")
    many = messages.join(large, "conversation_id", "left_semi")
    if many.isEmpty():
        return few
    return few.unionByName(_judge_large(many, turns))


def _key(conversation: str, message: str) -> Column:
    return F.concat(F.col(conversation), F.lit("\u0001"), F.col(message))


def _judge_large(messages: DataFrame, turns: bool) -> DataFrame:
    nodes = cut(messages.select("conversation_id", "msg_id", "created_at", "row_id", "kind", _key("conversation_id", "msg_id").alias("node"), _key("conversation_id", "parent_id").alias("parent"), (F.col("kind") == 2).alias("answer")))
    tree = cut(contract_forest(nodes, "node", "parent", "answer").select("node", "depth", "marked"))
    lost = nodes.where("parent is not null").join(nodes.select(F.col("node").alias("parent")), "parent", "left_anti").select("conversation_id").distinct().withColumn("lost", F.lit(BROKEN))
    judged = (
        nodes.join(tree, "node").groupBy("conversation_id")
        .agg(
            F.max(F.expr(f"if(depth < 0, {BROKEN}, 0)")).alias("a"), F.expr(f"if(count_if(kind = 1) = 0 or count_if(kind = 2) = 0, {EMPTY}, 0)").alias("b"),
            F.max(F.expr(f"if(kind = 1 and coalesce(marked, 0) = 0, {UNANSWERED}, 0)")).alias("c"),
        )
        .join(lost, "conversation_id", "left").select("conversation_id", F.expr("(a | b | c | coalesce(lost, 0))").cast("int").alias("faults"))
    )
    if not turns:
        return judged
    kept = judged.where("faults = 0").select("conversation_id")
    return nodes.join(kept, "conversation_id", "left_semi").join(tree, "node").where("kind > 0").select("conversation_id", "row_id", F.col("depth").cast("int").alias("depth"), "created_at", "msg_id")


def judge_arrays(group, parent, kind):
    """Faults of each group and depth of each message, from flat arrays.

    ``group`` numbers the conversations from 0, ascending; ``parent`` is the position of a message's parent, -1 for none,
    -2 for one that is not there; ``kind`` is as in :func:`fold_events`.
    """
    import numpy as np

    n, groups = len(group), int(group[-1]) + 1 if len(group) else 0
    faults = np.zeros(groups, np.int32)
    faults[group[parent == -2]] |= BROKEN
    # pointer doubling: who is still climbing after as many steps as there are messages goes in a circle
    at, depth = np.where(parent < 0, n, parent), np.where(parent < 0, 0, 1)
    at, depth = np.append(at, n), np.append(depth, 0)
    for _ in range(int(np.ceil(np.log2(max(2, np.bincount(group).max() + 1)))) + 1 if n else 0):
        depth = depth + depth[at]
        at = at[at]
    circling = at[:n] != n
    faults[group[circling]] |= BROKEN
    faults[(np.bincount(group[kind == 1], minlength=groups) == 0) | (np.bincount(group[kind == 2], minlength=groups) == 0)] |= EMPTY
    # climb from all answers at once, each message being reached but once
    answered = np.zeros(n, bool)
    front = parent[kind == 2]
    while len(front := np.unique(front[front >= 0])):
        front = front[~answered[front]]
        answered[front] = True
        front = parent[front]
    faults[group[(kind == 1) & ~answered]] |= UNANSWERED
    return faults, depth[:n]


def _flat(batch):
    """group, parent and kind of a batch of lists of messages, and the messages themselves."""
    import numpy as np
    import pyarrow as pa

    lists = batch.column(1)
    rows = lists.flatten()
    group = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    n = len(rows)
    msg, parent = rows.field(0), rows.field(1)
    codes = pa.concat_arrays([msg, parent]).dictionary_encode()
    base = max(1, len(codes.dictionary))
    code = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    own, named = group * base + code[:n], group * base + code[n:]
    order = np.argsort(own, kind="stable")
    place = np.searchsorted(own[order], named)
    hit = (place < n) & (own[order][np.minimum(place, n - 1)] == named) if n else np.zeros(0, bool)
    up = np.where(code[n:] < 0, -1, np.where(hit, order[np.minimum(place, max(0, n - 1))] if n else -1, -2))
    return group, up, rows.field(2).to_numpy(zero_copy_only=False), rows


def _judge(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        if batch.num_rows:
            group, parent, kind, _ = _flat(batch)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(judge_arrays(group, parent, kind)[0], pa.int32())], names=["conversation_id", "faults"])


def _judge_turns(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        if batch.num_rows:
            group, parent, kind, rows = _flat(batch)
            faults, depth = judge_arrays(group, parent, kind)
            keep = pa.array(np.flatnonzero((faults[group] == 0) & (kind > 0)))
            columns = [batch.column(0).take(pa.array(group)), rows.field(3), pa.array(depth, pa.int32()), rows.field(4), rows.field(0)]
            yield pa.RecordBatch.from_arrays([c.take(keep) for c in columns], names=["conversation_id", "row_id", "depth", "created_at", "msg_id"])


def export_verdicts(df: DataFrame, turns: bool = False) -> DataFrame:
    """Exports judged by the same rules, an entry without a message counting as an unusable one.

    Returns export_id and faults, or with ``turns`` the usable messages of kept exports as export_id, turn, role, content.
    A null or unreadable mapping has no entries and is dropped as empty.
    """
    schema = "export_id bigint, turn int, role string, content string" if turns else "export_id bigint, faults int"

    def run(batches: Iterator) -> Iterator:
        import re

        import numpy as np
        import pyarrow as pa

        from kgloom.operators.nested import entry_parents, message_text, opened, read_json

        word = re.compile(r"[^\W_]")
        for batch in batches:
            ids = batch.column(0).to_pylist()
            group, parent, kind, said = [], [], [], []
            for g, raw in enumerate(batch.column(1).to_pylist()):
                root = read_json(raw)
                entries = entry_parents(root) if root is not None else []
                first = len(group)
                place = {key: first + i for i, (_, key, _, _) in enumerate(entries)}
                for _, _, up, entry in entries:
                    message = opened(entry.get("message")) if isinstance(entry, dict) else None
                    message = message if isinstance(message, dict) else {}
                    author = message.get("author")
                    role = author.get("role") if isinstance(author, dict) else author
                    role = role.strip().lower() if isinstance(role, str) else ""
                    text = message_text(message.get("content"))
                    group.append(g)
                    parent.append(place.get(up, -2) if up else -1)
                    usable = bool(text and word.search(text))
                    kind.append(0 if not usable else 1 if role in USER else 2 if role in ASSISTANT else 3)
                    said.append((role, text))
            arrays = np.array(group, np.int64), np.array(parent, np.int64), np.array(kind, np.int64)
            faults, depth = judge_arrays(*arrays)
            faults = np.concatenate([faults, np.zeros(len(ids) - len(faults), np.int32)])
            faults[np.bincount(arrays[0], minlength=len(ids)) == 0] = EMPTY
            if not turns:
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(faults, pa.int32())], names=["export_id", "faults"])
                continue
            kept = [i for i in np.lexsort((np.arange(len(depth)), depth, arrays[0])) if faults[group[i]] == 0 and kind[i] > 0]
            number, last, turn = [], None, 0
            for i in kept:
                turn = turn + 1 if group[i] == last else 0
                last = group[i]
                number.append(turn)
            names = {1: "user", 2: "assistant"}
            columns = [pa.array([ids[group[i]] for i in kept], pa.int64()), pa.array(number, pa.int32()), pa.array([names.get(kind[i], said[i][0]) for i in kept], pa.string()), pa.array([said[i][1] for i in kept], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["export_id", "turn", "role", "content"])

    return df.select("export_id", "mapping").mapInArrow(run, schema)

"""Texts that carry records: headings, front matter, answers of models, progress lines."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.functions.text import epoch_of_date, squeezed, without_markdown


def heading_sections(df: DataFrame, key: str, text: str, least: int = 10) -> DataFrame:
    """``key``, pos, heading (null before the first one) and content of the parts that headings of level 1 to 3 begin.

    ``pos`` counts all parts; those whose plain text has fewer than ``least`` characters are left out. Null texts have none.
    """
    parts = F.split(F.concat(F.lit("\n"), F.col(text)), "\n(?=#{1,3} )")
    rows = df.select(F.col(key), F.posexplode(parts).alias("pos", "part"))
    head = F.regexp_extract("part", "^#{1,3} +([^\n]*)", 1)
    titled = F.col("part").rlike("^#{1,3} ")
    content = without_markdown(F.when(titled, F.regexp_replace("part", "^[^\n]*\n?", "")).otherwise(F.col("part")))
    return rows.select(key, "pos", F.when(titled, F.trim(head)).alias("heading"), content.alias("content")).where(F.length("content") >= least)


def first_level_sections(df: DataFrame, key: str, text: str, title: str | None = None, least: int = 20) -> DataFrame:
    """Parts at first-level headings; what stands before the first one is dropped if there is one, else the whole is a part.

    The heading falls back to ``title``. ``qa_id`` is ``{key}_{pos}`` and keeps gaps where short parts are left out.
    """
    body = F.concat(F.lit("\n"), F.col(text))
    parts = F.split(body, "\n# ")
    chosen = F.when(F.size(parts) > 1, F.slice(parts, 2, 1_000_000_000)).otherwise(parts)
    rows = df.select(F.col(key), *([F.col(title).alias("_title")] if title else [F.lit(None).cast("string").alias("_title")]), (F.size(parts) > 1).alias("_headed"), F.posexplode(chosen).alias("pos", "part"))
    heading = F.when(F.col("_headed"), F.trim(F.split_part("part", F.lit("\n"), F.lit(1)))).otherwise(F.col("_title"))
    content = without_markdown(F.when(F.col("_headed"), F.regexp_replace("part", "^[^\n]*\n?", "")).otherwise(F.col("part")))
    return rows.select(key, F.concat_ws("_", F.col(key).cast("string"), F.col("pos").cast("string")).alias("qa_id"), F.coalesce(heading, F.col("_title")).alias("heading"), content.alias("content")).where(F.length("content") >= least)


def front_matter(df: DataFrame, text: str) -> DataFrame:
    """``df`` with front (map of the ``key: value`` lines between leading ``---`` lines), fm_title, fm_created, fm_updated and body."""
    block = F.regexp_extract(text, "(?s)^---\n(.*?)\n---\n", 1)
    lines = F.filter(F.split(block, "\n"), lambda x: x.rlike("^[^:]+:"))
    entry = lambda x: F.struct(F.trim(F.regexp_extract(x, "^([^:]+):", 1)).alias("key"), F.regexp_replace(F.trim(F.regexp_extract(x, "^[^:]+:(.*)$", 1)), "^[\"']|[\"']$", "").alias("value"))
    first = lambda *names: F.coalesce(*[F.try_element_at("front", F.lit(n)) for n in names])
    unique = F.array_distinct(F.transform(lines, lambda x: F.trim(F.regexp_extract(x, "^([^:]+):", 1))))
    every = F.transform(lines, entry)
    front = F.map_from_entries(F.transform(unique, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(every, lambda e: e["key"] == k), -1)["value"].alias("value"))))
    return df.withColumn("front", front).withColumns(
        {"fm_title": first("title"), "fm_created": epoch_of_date(first("created", "created_at", "date")), "fm_updated": epoch_of_date(first("updated", "modified", "updated_at")), "body": F.regexp_replace(text, "(?s)^---\n.*?\n---\n", "")}
    )


def bracket_list(value: Column) -> Column:
    """The items of ``[a, b]``, quotes off; null for other text."""
    inner = F.regexp_extract(value, "^\\[(.*)\\]$", 1)
    return F.when(value.rlike("^\\[.*\\]$"), F.filter(F.transform(F.split(inner, ","), lambda x: F.regexp_replace(F.trim(x), "^[\"']|[\"']$", "")), lambda x: x != ""))


def assignment_lines(df: DataFrame, text: str) -> DataFrame:
    """conversation_id, cluster_id and confidence of the lines ``conversation_id=1 | cluster_id=2 | confidence=85%``.

    A bare number is ``cluster_{n}``; confidences above 1 are per cent, the result lies in [0, 1], 1 where none is given.
    The first line of a conversation counts.
    """
    rows = df.select(F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    take = lambda p: F.nullif(F.regexp_extract("line", p, 1), F.lit(""))
    number = take("(?i)confidence\\s*[=:]\\s*([0-9.]+)").try_cast("double")
    cluster = take("(?i)cluster_id\\s*[=:]\\s*([A-Za-z0-9_\\-]+)")
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(number > 1, number / 100).otherwise(number)))
    found = rows.select(
        "pos", take("(?i)conversation_id\\s*[=:]\\s*([0-9]+)").try_cast("bigint").alias("conversation_id"), F.when(cluster.rlike("^[0-9]+$"), F.concat(F.lit("cluster_"), cluster)).otherwise(cluster).alias("cluster_id"), F.coalesce(share, F.lit(1.0)).alias("confidence")
    )
    return found.where("conversation_id is not null and cluster_id is not null").groupBy("conversation_id").agg(F.min_by(F.struct("cluster_id", "confidence"), "pos").alias("r")).select("conversation_id", "r.*")


def progress_lines(df: DataFrame, text: str) -> DataFrame:
    """kind, step, percent, done, total and eta of ``PROGRESS:step:pct:i:n:eta`` and ``STEP_START:step`` lines."""
    parts = F.split(squeezed(text), ":")
    at = lambda i: F.get(parts, i - 1)
    return df.where(F.col(text).rlike("^(PROGRESS|STEP_START):")).select(
        F.when(at(1) == "PROGRESS", "progress").otherwise("start").alias("kind"), at(2).alias("step"), at(3).try_cast("double").alias("percent"), at(4).try_cast("int").alias("done"), at(5).try_cast("int").alias("total"), at(6).try_cast("double").alias("eta")
    )


def extract_json(text: str | None) -> str | None:
    """The first JSON object or array in a model's answer: bare, in a code fence, or between other words; else None."""
    import json
    import re

    if not text:
        return None
    candidates = [text.strip(), *re.findall(r"```(?:json)?\s*(.*?)```", text, re.S)]
    decoder = json.JSONDecoder()
    for candidate in [*candidates, *(c.replace('\\"', '"') for c in candidates if '\\"' in c)]:
        for start in (m.start() for m in re.finditer(r"[\[{]", candidate)):
            try:
                _, end = decoder.raw_decode(candidate[start:])
                return candidate[start : start + end]
            except (ValueError, RecursionError):
                continue
    return None


def resolve_anchor(text: str, start: str, end: str) -> tuple[int, int]:
    """Where a block lies that a model named by its first and last words: exact, else with any white space, else by 15 characters."""
    import re

    def find(anchor: str, after: int) -> tuple[int, int] | None:
        anchor = (anchor or "").strip()
        if not anchor:
            return None
        at = text.find(anchor, after)
        if at >= 0:
            return at, at + len(anchor)
        for words in (anchor.split(), anchor[:15].split()):
            if words and (m := re.compile(r"\s+".join(map(re.escape, words))).search(text, after)):
                return m.span()
        return None

    low = find(start, 0)
    first = low[0] if low else 0
    high = find(end, low[1] if low else 0)
    last = high[1] if high else len(text)
    return (first, last) if last > first else (first, len(text))


def extracted(df: DataFrame, text: str, into: str = "json") -> DataFrame:
    """``df`` with the JSON that :func:`extract_json` finds."""

    def run(batches: Iterator) -> Iterator:
        for frame in batches:
            frame[into] = [extract_json(t) for t in frame[text]]
            yield frame

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != into] + [f"{into} string"])
    return df.drop(into).mapInPandas(run, schema)

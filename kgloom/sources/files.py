"""Files of several kinds as source documents with sections.

Every reader yields path, source_id, title, source_type, pos, heading, role, content, created, updated and error. A file
that can't be read gives one row with its error instead of ending the job.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Encodings that are tried in order.
ENCODINGS = ("utf-8", "utf-8-sig", "cp949", "gbk", "latin-1")
SECTION_SCHEMA = "path string, source_id string, title string, source_type string, pos int, heading string, role string, content string, created bigint, updated bigint, error string"


def decode(raw: bytes) -> str:
    """The text of bytes in the first encoding that fits."""
    for encoding in ENCODINGS:
        try:
            return raw.decode(encoding).lstrip("﻿")
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", "replace")


def _zip_xml(raw: bytes, pattern: str) -> list[tuple[str, object]]:
    import io
    import re
    import xml.etree.ElementTree as ET
    import zipfile

    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = [n for n in z.namelist() if re.fullmatch(pattern, n)]
        return [(n, ET.fromstring(z.read(n))) for n in sorted(names, key=lambda n: [int(d) for d in re.findall(r"\d+", n)])]


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _texts(element, paragraph: str = "p", text: str = "t") -> list[str]:
    return ["".join(t.text or "" for t in p.iter() if _local(t.tag) == text) for p in element.iter() if _local(p.tag) == paragraph]


def docx_sections(raw: bytes) -> list[tuple[str | None, str]]:
    """(heading, text) of a word-processor file: paragraphs under each heading, table rows with their cells joined."""
    out: list[tuple[str | None, list[str]]] = [(None, [])]
    for _, root in _zip_xml(raw, r"word/document\.xml"):
        body = next(e for e in root.iter() if _local(e.tag) == "body")
        for child in body:
            kind = _local(child.tag)
            if kind == "tbl":
                for row in (r for r in child.iter() if _local(r.tag) == "tr"):
                    out[-1][1].append(" | ".join(" ".join(filter(None, _texts(c))) for c in row if _local(c.tag) == "tc"))
            elif kind == "p":
                style = next((v for s in child.iter() if _local(s.tag) == "pStyle" for k, v in s.attrib.items() if _local(k) == "val"), "")
                line = "".join(t.text or "" for t in child.iter() if _local(t.tag) == "t").strip()
                if line and style.lower().startswith(("heading", "title")):
                    out.append((line, []))
                elif line:
                    out[-1][1].append(line)
    return [(h, "\n".join(lines)) for h, lines in out if lines or h]


def pptx_sections(raw: bytes) -> list[tuple[str | None, str]]:
    """(``Slide k``, text) of a presentation, tables as rows with their cells joined and speaker notes at the end."""
    notes = {n.rsplit("notesSlide", 1)[1]: root for n, root in _zip_xml(raw, r"ppt/notesSlides/notesSlide\d+\.xml")}
    out = []
    for k, (name, root) in enumerate(_zip_xml(raw, r"ppt/slides/slide\d+\.xml"), 1):
        tables = [t for t in root.iter() if _local(t.tag) == "tbl"]
        inside = {id(p) for t in tables for p in t.iter()}
        lines = ["".join(t.text or "" for t in p.iter() if _local(t.tag) == "t") for p in root.iter() if _local(p.tag) == "p" and id(p) not in inside]
        lines += [" | ".join(" ".join(filter(None, _texts(c))) for c in row if _local(c.tag) == "tc") for t in tables for row in t.iter() if _local(row.tag) == "tr"]
        if (note := notes.get(name.rsplit("slide", 1)[1])) is not None:
            lines += _texts(note)
        text = "\n".join(x.strip() for x in lines if x.strip())
        if text:
            out.append((f"Slide {k}", text))
    return out


def pdf_sections(raw: bytes) -> list[tuple[str | None, str]]:
    """(``Page k``, text) of pages of ten characters or more, if a PDF library is installed."""
    import io

    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("reading PDF needs the optional package pypdf") from e
    pages = [(k, (p.extract_text() or "").strip()) for k, p in enumerate(PdfReader(io.BytesIO(raw)).pages, 1)]
    return [(f"Page {k}", t) for k, t in pages if len(t) >= 10]


def markdown_sections(text: str) -> list[tuple[str | None, str]]:
    """(heading, body) of the parts that headings of level 1 to 3 begin."""
    import re

    parts = re.split(r"(?m)^(#{1,3} .*)$", re.sub(r"(?s)\A---\n.*?\n---\n", "", text))
    found = [(None, parts[0]), *[(h.lstrip("#").strip(), b) for h, b in zip(parts[1::2], parts[2::2])]]
    return [(h, b.strip()) for h, b in found if len(b.strip()) >= 10]


def json_sources(text: str) -> list[dict]:
    """Source documents of a JSON file, told by its shape: source_nodes, chat exports, or a flat list of messages."""
    import json
    from collections import deque

    from kgloom.operators.nested import entry_parents, message_text, opened

    value = json.loads(text)
    if isinstance(value, dict) and isinstance(value.get("source_nodes"), list):
        nodes = []
        for n in value["source_nodes"]:
            sections = [{"role": s.get("role"), "heading": s.get("section_title"), "content": s.get("content") or ""} for s in n.get("sections") or []]
            if not any(s["content"].strip() for s in sections):
                sections = [{"role": None, "heading": None, "content": n.get("title") or ""}]
            nodes.append({"id": str(n.get("id")), "title": n.get("title"), "kind": n.get("source_type") or ("notion" if "tree" in value else "chat"), "created": n.get("create_time"), "updated": n.get("update_time"), "sections": sections})
        return nodes
    exports = [value] if isinstance(value, dict) else value if isinstance(value, list) else []
    if exports and all(isinstance(e, dict) and "mapping" in e for e in exports):
        out = []
        for i, export in enumerate(exports):
            entries = entry_parents(opened(export["mapping"]))
            below: dict = {}
            for _, key, parent, entry in entries:
                below.setdefault(parent, []).append((key, entry))
            known = {key for _, key, _, _ in entries}
            ident = lambda k, e: str(((e or {}).get("message") or {}).get("id") or k)
            queue = deque(sorted(((k, e) for _, k, p, e in entries if p not in known), key=lambda x: ident(*x)))
            seen, sections = set(), []
            while queue:
                key, entry = queue.popleft()
                if key in seen:
                    continue
                seen.add(key)
                message = entry.get("message") if isinstance(entry, dict) else None
                author = message.get("author") if isinstance(message, dict) else None
                role, said = author.get("role") if isinstance(author, dict) else None, message_text(message.get("content")) if isinstance(message, dict) else None
                if role and said and message.get("id"):
                    sections.append({"role": role, "heading": None, "content": said})
                queue.extend(below.get(key, ()))
            if sections:
                out.append({"id": str(export.get("conversation_id") or export.get("id") or f"conv_{i}"), "title": export.get("title"), "kind": "chat", "created": export.get("create_time"), "updated": export.get("update_time"), "sections": sections})
        return out
    if exports and all(isinstance(m, dict) and {"id", "role", "content"} <= m.keys() for m in exports):
        groups: dict[str, list] = {}
        for m in exports:
            name, _, last = str(m["id"]).rpartition("_")
            groups.setdefault(name or "src_0", []).append({"role": m["role"], "heading": None, "content": m["content"] or ""})
        return [{"id": k, "title": None, "kind": "chat", "created": None, "updated": None, "sections": s} for k, s in groups.items()]
    raise ValueError("no known shape of JSON")


def _whole(value) -> int | None:
    try:
        return int(float(value))
    except (TypeError, ValueError):
        return None


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """The sections of all files under ``path``, read by extension: md, txt, json, docx, pptx and, if possible, pdf."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)

    def run(batches: Iterator) -> Iterator:
        import os
        import re
        from urllib.parse import unquote

        import pandas as pd

        readers = {"docx": docx_sections, "pptx": pptx_sections, "pdf": pdf_sections}
        for frame in batches:
            rows = []
            for place, modified, raw in zip(frame["path"], frame["modified"], frame["content"]):
                name = unquote(os.path.basename(place))
                stem, _, ending = name.rpartition(".")
                ending = ending.lower()
                safe = re.sub(r"\W+", "_", stem)[:40]
                try:
                    if ending == "json":
                        sources = json_sources(decode(raw))
                    else:
                        if ending in readers:
                            sections = readers[ending](raw)
                        else:
                            text = decode(raw)
                            sections = markdown_sections(text) if ending in ("md", "markdown") else [(None, text)]
                        sources = [{"id": f"{ending}_{safe}", "title": stem, "kind": "markdown" if ending in ("md", "markdown") else ending, "created": modified, "updated": modified, "sections": [{"role": None, "heading": h, "content": c} for h, c in sections]}]
                    for s in sources:
                        rows += [(place, s["id"], s["title"], s["kind"], i, x["heading"], x["role"], x["content"], _whole(s["created"]), _whole(s["updated"]), None) for i, x in enumerate(s["sections"])]
                except Exception as e:  # noqa: BLE001 - one bad file must not end the job
                    rows.append((place, None, stem, ending, None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:500]))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in SECTION_SCHEMA.split(", ")])
            yield out.astype({"pos": "Int32", "created": "Int64", "updated": "Int64"})

    return files.select("path", F.unix_seconds("modificationTime").alias("modified"), "content").mapInPandas(run, SECTION_SCHEMA)


def read_ontology(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Node types (name, description), edge types (name, description) and forbidden pairs (type, start_type, target_type) of a JSON ontology."""
    raw = spark.read.option("multiLine", "true").schema(
        "node_types array<struct<name string, description string>>, edge_types array<struct<name string, description string, example string, forbidden_pairs array<array<string>>>>"
    ).json(path)
    edge_types = raw.select(F.explode("edge_types").alias("e")).select("e.*")
    pairs = edge_types.select(F.col("name").alias("type"), F.explode("forbidden_pairs").alias("p")).select("type", F.get("p", 0).alias("start_type"), F.get("p", 1).alias("target_type"))
    return raw.select(F.inline("node_types")), edge_types.select("name", "description"), pairs

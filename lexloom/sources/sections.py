"""Sections of large XML files, read by many tasks.

Spark's text reader cuts a file of any size into byte ranges, and a record ends where the start of the next element stands, so no task needs
more than the sections of its range. What a section holds up to the next element of the same name is one record; an element of that name
within a section is a record of its own that goes on with the section. Records keep their order within a range, and ranges have their
place in the file: a section that a range leaves open is put together with the first records of the next ones. Only these meet in a shuffle.

A filter on sections is asked of the start tag, before anything is parsed.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.session import materialise, ship
from lexloom.sources import outline as O

#: The element of a section, and how the start tag of one begins after the element's name.
REGULATION = ("DIV8", r"""^[^>]*\bTYPE\s*=\s*["']SECTION["']""")
STATUTE = ("section", rf"""^[^>]*\bidentifier\s*=\s*["']{re.escape(O.STATUTE_ID)}""")


def records(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """path, since, value: what follows each start of an element, in the order of the file by (since, place), since being the range's first byte."""
    text = spark.read.option("lineSep", f"<{tag} ").text(path)
    return text.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("since"))


def closed(text: str, tag: str) -> str | None:
    """An element whose name has been cut off before text, up to its own end; null if the end is not there."""
    depth = 1
    for m in re.finditer(rf"<(/?){tag}\b[^>]*?(/?)>|<!--.*?-->|<!\[CDATA\[.*?\]\]>", f"<{tag} {text}", re.S):
        if m.start() == 0:
            if m[2]:
                return m[0]
        elif m[1]:
            depth -= 1
            if not depth:
                return f"<{tag} {text}"[: m.end()]
        elif m[1] == "" and not m[2]:
            depth += 1
    return None


def _joined(tag: str, begins: str):
    """Whole sections of a range as (path, since, place, text, True), and the records that others must complete with False."""
    start = re.compile(begins)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, place, first = None, [], 0, True

        def settle() -> list[tuple]:
            # what stands before the first section of a range, and a section without an end, belong to more than this range
            nonlocal place, held
            rows = []
            if held:
                whole = closed(f"<{tag} ".join(held), tag) if not first else None
                rows = [(*at, place, whole, True)] if whole is not None else [(*at, place + n, x, False) for n, x in enumerate(held)]
                place += len(rows)
                held = []
            return rows

        for pdf in batches:
            out = []
            for path, since, value in zip(pdf["path"], pdf["since"], pdf["value"], strict=True):
                if (path, since) != at:
                    out += settle()
                    at, place, first = (path, since), 0, True
                if start.search(value):
                    out += settle()
                    first = False
                held.append(value)
            yield pd.DataFrame(out, columns=["path", "since", "place", "text", "whole"])
        yield pd.DataFrame(settle(), columns=["path", "since", "place", "text", "whole"])

    return run


def _completed(tag: str, begins: str):
    """Sections of one file from the records at the ends of its ranges, in order."""
    start = re.compile(begins)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, held = pdf.sort_values(["since", "place"]), None
        out: list[tuple] = []

        def settle() -> None:
            if held is not None and (whole := closed(f"<{tag} ".join(held[2]), tag)) is not None:
                out.append((pdf["path"].iloc[0], held[0], held[1], whole))

        for since, place, text in zip(rows["since"], rows["place"], rows["text"], strict=True):
            if start.search(text):
                settle()
                held = (since, place, [text])
            elif held is not None:
                held[2].append(text)
        settle()
        return pd.DataFrame(out, columns=["path", "since", "place", "text"])

    return run


def sections(spark: SparkSession, path: str, kind: tuple[str, str], wanted: Column | None = None) -> DataFrame:
    """path, since, place, text of every section of the files under path, in document order by (since, place).

    wanted is a condition on the column text of a section with its start tag; it is asked as soon as a section is whole.
    """
    ship(spark)
    shape = "path string, since long, place long, text string"
    found = materialise(records(spark, path, kind[0]).mapInPandas(_joined(*kind), f"{shape}, whole boolean"), "sections")
    rest = found.where("not whole").groupBy("path").applyInPandas(_completed(*kind), shape)
    every = found.where("whole").drop("whole").unionByName(rest)
    return every if wanted is None else every.where(wanted)


def named(numbers: list[str], attribute: str = "N", prefix: str = "") -> Column:
    """Whether the start tag of a section names one of these; for sections."""
    tag = F.regexp_extract("text", r"^<[^>]*>", 0)
    return F.regexp_extract(tag, rf"""\b{attribute}\s*=\s*["']{prefix}([^"']*)["']""", 1).isin(numbers)


def _element(text: str) -> ET.Element:
    """A section as an element; prefixes of namespaces that are declared outside of it stand for themselves."""
    tags = " ".join(re.findall(r"<[^>]*>", text))
    used = set(re.findall(r"[<\s/](\w+):\w+", re.sub(r"\"[^\"]*\"|'[^']*'", "", tags))) - {"xml", "xmlns"}
    spaces = "".join(f' xmlns:{p}="{p}"' for p in sorted(used))
    return ET.fromstring(f"<r{spaces}>{text}</r>")[0]


def _parsed(found: DataFrame, read: Callable[[ET.Element], O.Section | None], prefix: str, as_of: str | None, revision: str | None) -> DataFrame:
    names = [x.split()[0] for x in O._ROWS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            read_ = [s for s in (read(_element(text)) for text in pdf["text"]) if s is not None]
            rows = [(s.number, r[1], i, r[0], r[2], r[3], r[4], as_of, revision) for s in read_ for i, r in enumerate(O.chunk_rows(s, prefix))]
            yield pd.DataFrame(rows, columns=names)

    ship(found.sparkSession)
    return found.select("text").mapInPandas(run, O._ROWS)


def regulations(spark: SparkSession, path: str, as_of: str, numbers: list[str] | None = None) -> DataFrame:
    """Chunks of regulation XML as outline.regulations gives them, from files of any size; of some sections if they are named."""
    found = sections(spark, path, REGULATION, named(numbers) if numbers is not None else None)
    return O.chunks(_parsed(found, O.regulation, "26 CFR", as_of, None), "ecfr")


def _meta(spark: SparkSession, path: str) -> tuple[str, str | None]:
    """created and the release point, which stand before the first section of a statute file."""
    head = records(spark, path, STATUTE[0]).where("since = 0").orderBy("path").first()
    said = head["value"] if head else ""
    value = lambda name: (m[1].strip() if (m := re.search(rf"<(?:\w+:)?{name}\b[^>]*>([^<]*)<", said)) else "")
    point = value("docPublicationName").partition("@")[2]
    return value("created")[:10], f"Pub. L. {point}" if point else None


def statutes(spark: SparkSession, path: str, numbers: list[str] | None = None) -> DataFrame:
    """Chunks of statute XML as outline.statutes gives them, from files of one release and of any size; of some sections if they are named."""
    found = sections(spark, path, STATUTE, named(numbers, "identifier", re.escape(O.STATUTE_ID)) if numbers is not None else None)
    return O.chunks(_parsed(found, O.statute, O.STATUTE, *_meta(spark, path)), "usc")

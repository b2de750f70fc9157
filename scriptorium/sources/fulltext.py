"""Full texts: TEI documents, lines with font sizes, and the nested document both become."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from scriptorium.functions.text import section_name, squeeze

TEI = "{http://www.tei-c.org/ns/1.0}"
#: Headings that stand alone, what begins a caption, and what a link is.
HEADINGS = (
    "abstract|introduction|background|related work|method(?:s|ology)?|"
    "approach|model|experiments?|experimental (?:setup|results)|"
    "evaluation|results?(?: and discussion)?|discussion|analysis|"
    "limitations?|conclusions?|future work|broader impacts?|"
    "acknowledg(?:e)?ments?|references|appendix|ethics statement"
)
CAPTION = r"(?i)^(?:fig(?:ure)?|table)\.?\s*\d+"
URL = r"https?://[^\s)\]}>\"']+"
#: Documents that a worker holds parsed at one time.
SOME = 64
DOC = "sections array<struct<heading:string,text:string>>, figure_captions array<string>, urls array<string>"


class _Walk:
    """What a parser tells of a TEI document, event by event; nothing of the tree is kept but the open path.

    An element may be a place where text is gathered; all text below it goes there, once it is closed. Of places that
    count once, the first is taken."""

    def __init__(self):
        self.path: list[str] = []
        self.open: list[tuple[int, str, list[str], dict]] = []
        self.body = False
        self.sections: list[dict] = [{"heading": "Abstract", "text": []}]
        self.figures: list[dict] = []
        self.links: set[str] = set()

    def _place(self) -> tuple[str, dict] | None:
        """The name and the holder of the place that the element just opened is."""
        match self.path:
            case [*_, "profileDesc", "abstract"] if not self.sections[0]["text"]:
                return "text", self.sections[0]
            case [*_, "text", "body"]:
                self.body = True
            case [*_, "text", "body", "div"]:
                self.sections.append({"text": []})
            case [*_, "text", "body", "div", "p"]:
                return "text", self.sections[-1]
            case [*_, "text", "body", "div", "head"] if "heading" not in self.sections[-1]:
                return "heading", self.sections[-1]
            case [*_, "figure"]:
                self.figures.append({})
            case [*_, "figure", "head" | "figDesc" as name] if name not in self.figures[-1]:
                return name, self.figures[-1]
        return None

    def start(self, tag: str, attributes: dict) -> None:
        self.path.append(tag.removeprefix(TEI) if tag.startswith(TEI) else "")
        if self.path[-1] == "ptr" and attributes.get("target"):
            self.links.add(attributes["target"])
        if place := self._place():
            self.open.append((len(self.path), place[0], [], place[1]))

    def data(self, text: str) -> None:
        for _, _, parts, _ in self.open:
            parts.append(text)

    def end(self, tag: str) -> None:
        if self.open and self.open[-1][0] == len(self.path):
            _, name, parts, holder = self.open.pop()
            text = " ".join("".join(parts).split())
            if name == "text":
                holder["text"] += [text] if text else []
            else:
                holder[name] = text
        self.path.pop()

    def close(self) -> dict | None:
        found = [{"heading": s.get("heading", ""), "text": " ".join(s["text"])} for s in self.sections]
        found = [s for i, s in enumerate(found) if s["text"] or i and s["heading"]]
        if not self.body or not found:
            return None
        captions = []
        for f in self.figures:
            label, text = f.get("head", ""), f.get("figDesc", "")
            if text:
                own = not label or text.lower().startswith(label.lower())
                captions.append(text if own else f"{label}: {text}")
        in_text = (u.rstrip(".,;:") for s in found for u in re.findall(URL, s["text"]))
        return {"sections": found, "figure_captions": captions, "urls": sorted(self.links.union(in_text))}


def parse_tei(xml: bytes | str | None) -> dict | None:
    """Sections, captions and links of a TEI document; None if it is malformed or has no body or no section."""
    parser = ET.XMLParser(target=_Walk())
    try:
        parser.feed(xml or "")
        return parser.close()
    except ET.ParseError:
        return None


def read_tei(df: DataFrame, key: str, xml: str) -> DataFrame:
    """key and the parsed document; its columns are null where parsing failed."""
    schema = StructType([df.schema[key], *StructType.fromDDL(DOC).fields])
    types = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), SOME):
                some = batch.slice(at, SOME)
                got = [parse_tei(v) or {} for v in some.column(1).to_pylist()]
                cols = [pa.array([g.get(f.name) for g in got], f.type) for f in list(types)[1:]]
                yield pa.RecordBatch.from_arrays([some.column(0), *cols], names=types.names)

    return df.select(key, xml).mapInArrow(run, schema)


def is_heading(text: Column, size: Column, body: Column) -> Column:
    alone = text.rlike(rf"(?i)^(?:(?:\d+|[IVX]+)[.\s]+)?(?:{HEADINGS})\s*$")
    large = (size > body * 1.15) & (text.rlike(r"^(?:\d+|[IVX]+)[.\s]+\S") | text.rlike(r"^\p{Lu}"))
    return (F.length(text) <= 80) & ~text.rlike(CAPTION) & (alone | large)


def line_sections(lines: DataFrame, key: str) -> DataFrame:
    """Documents of lines (key, line_no, text, size): a heading opens a section, captions are set apart."""
    body = lines.groupBy(key).agg(F.median("size").alias("body"))
    at = lines.join(body, key)
    at = at.withColumns({"caption": F.col("text").rlike(CAPTION), "heads": is_heading(F.col("text"), F.col("size"), F.col("body"))})
    order = Window.partitionBy(key).orderBy("line_no")
    at = at.withColumn("section", F.sum(F.col("heads").cast("int")).over(order))
    plain = F.when(~F.col("heads") & ~F.col("caption"), F.struct("line_no", "text"))
    parts = at.groupBy(key, "section").agg(F.max(F.when(F.col("heads"), F.col("text"))).alias("heading"), F.sort_array(F.collect_list(plain)).alias("l"))
    text = squeeze(F.array_join(F.transform("l", lambda x: x.text), " "))
    parts = parts.select(key, "section", F.coalesce("heading", F.lit("")).alias("heading"), text.alias("text")).where("heading <> '' OR text <> ''")
    docs = parts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("section", "heading", "text"))).alias("s"), F.max(F.col("text") != "").alias("any"))
    links = F.flatten(F.collect_list(F.transform(F.regexp_extract_all("text", F.lit(URL), F.lit(0)), lambda u: F.regexp_replace(u, "[.,;:]+$", ""))))
    captions = F.sort_array(F.collect_list(F.when(F.col("caption"), F.struct("line_no", "text"))))
    more = lines.withColumn("caption", F.col("text").rlike(CAPTION)).groupBy(key).agg(captions.alias("c"), F.array_sort(F.array_distinct(links)).alias("urls"))
    sections = F.transform("s", lambda x: F.struct(x.heading.alias("heading"), x.text.alias("text")))
    return docs.where("any").join(more, key).select(key, sections.alias("sections"), F.transform("c", lambda x: x.text).alias("figure_captions"), "urls")


def documents(df: DataFrame, key: str, source: str) -> DataFrame:
    """The nested document: sections with canonical names, status, source."""
    named = F.transform("sections", lambda s: F.struct(s.heading.alias("heading"), section_name(s.heading).alias("normalized"), s.text.alias("text")))
    status = F.when(F.col("sections").isNull(), "parse_failed").otherwise("ok")
    return df.select(key, F.lit(source).alias("source"), status.alias("fulltext_status"), named.alias("sections"), "figure_captions", "urls")

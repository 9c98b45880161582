"""XML of codes and statutes, text of notices, and page geometry, to units."""

from __future__ import annotations

import html as entities
import re
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Elements of the code's XML that are apparatus, not text, and those that hold text.
APPARATUS = {"CITA", "AUTH", "SOURCE", "EDNOTE", "EFFDNOT", "FTNT", "SECAUTH", "XREF"}
PROSE = {"P", "FP", "HD1", "HD2", "EXTRACT"}


def tree(xml: str | None) -> tuple[ET.Element | None, str | None]:
    """The root of an XML text, or what is wrong with it. Declarations of entities are refused before
    parsing, and nothing outside of the text is ever read."""
    if not xml or not xml.strip():
        return None, None
    if re.search(r"<!(?:DOCTYPE|ENTITY)", xml, re.IGNORECASE):
        return None, "declares a document type or entities"
    try:
        return ET.fromstring(xml), None
    except (ET.ParseError, RecursionError, ValueError) as error:
        return None, f"not well-formed: {type(error).__name__}"


def xml_error(xml: Column) -> Column:
    """Why a text is no XML that is read; null where it is, or is empty."""

    @F.pandas_udf("string")
    def run(docs: pd.Series) -> pd.Series:
        return docs.map(lambda x: tree(x)[1])

    return run(xml)


def strip_apparatus(node: ET.Element) -> ET.Element:
    """Takes out apparatus below a node; what follows it stays."""
    for parent in list(node.iter()):
        last = None
        for child in list(parent):
            if child.tag in APPARATUS:
                if last is None:
                    parent.text = (parent.text or "") + (child.tail or "")
                else:
                    last.tail = (last.tail or "") + (child.tail or "")
                parent.remove(child)
            else:
                last = child
    return node


def text_of(node: ET.Element) -> str:
    return re.sub(r"\s+", " ", "".join(node.itertext())).strip()


def body_elements(node: ET.Element) -> list[ET.Element]:
    """Prose and tables in document order, nothing inside of them again."""
    if node.tag in PROSE or node.tag == "TABLE":
        return [node]
    return [x for child in node for x in body_elements(child)]


def table_text(node: ET.Element) -> str:
    rows = [[text_of(c) for c in row if c.tag in ("TD", "TH")] for row in node.iter("TR")]
    return "\n".join(" | ".join(r) for r in rows if any(r))


def sections(xml: str | None) -> list[dict]:
    """section, heading, subpart and paragraphs of each section of a part; none where xml_error() tells why."""
    root, _ = tree(xml)
    if root is None:
        return []
    out = []

    def visit(node: ET.Element, subpart: str) -> None:
        if node.tag == "DIV6":
            subpart = node.get("N", "")
        if node.tag == "DIV8" and node.get("TYPE") == "SECTION":
            number = re.sub(r"[§\s]", "", node.get("N", ""))
            head = node.find("HEAD")
            heading = re.sub(r"^§+\s*\S+\s*", "", text_of(head)).rstrip(".") if head is not None else ""
            bodies = [table_text(x) if x.tag == "TABLE" else text_of(x) for x in body_elements(strip_apparatus(node))]
            out.append({"section": number, "heading": heading, "subpart": subpart, "paragraphs": [b for b in bodies if b]})
            return
        for child in node:
            visit(child, subpart)

    visit(root, "")
    return out


def code_sections(xml: Column) -> Column:
    @F.pandas_udf("array<struct<section:string,heading:string,subpart:string,paragraphs:array<string>>>")
    def run(docs: pd.Series) -> pd.Series:
        return docs.map(sections)

    return run(xml)


# Designators of a section's paragraphs: which nesting is meant is decided over the whole stream.

LEVELS = ("alpha", "number", "roman", "ALPHA")


def _values(token: str) -> dict[str, int]:
    from ..operators.graph import alpha_value, roman_value

    out = {}
    if token.isdigit():
        out["number"] = int(token)
    elif token.islower():
        if len(set(token)) == 1:
            out["alpha"] = alpha_value(token[0]) + 26 * (len(token) - 1)
        if roman_value(token) is not None:
            out["roman"] = roman_value(token)
    elif token.isupper():
        out["ALPHA"] = alpha_value(token)
    return out


def place(tokens: list[str], width: int = 8) -> list[str]:
    """Anchors of a stream of designators: a beam search over stacks.

    A token continues a level of the open stack (cost 0 if it follows, more if it skips) or opens a
    new level below (cost 0 if it is the first of its kind). Cheapest stacks, then the shallower, win.
    """
    beams: list[tuple[float, tuple[tuple[str, int, str], ...], tuple[str, ...]]] = [(0.0, (), ())]
    for token in tokens:
        grown = []
        for cost, stack, path in beams:
            for kind, value in _values(token).items() or {"other": 0}.items():
                for depth, (k, v, _) in enumerate(stack):
                    if k == kind:
                        step = 0.0 if value == v + 1 else 2.0 + abs(value - v - 1) * 0.1 if value > v else 6.0
                        grown.append((cost + step + 0.01 * (len(stack) - depth - 1), (*stack[:depth], (kind, value, token)), path))
                opens = 0.0 if value == 1 else 3.0
                expected = LEVELS[len(stack)] if len(stack) < len(LEVELS) else None
                grown.append((cost + opens + (0.0 if kind == expected else 1.0) + 0.02, (*stack, (kind, value, token)), path))
        grown.sort(key=lambda b: (b[0], len(b[1]), [x[2] for x in b[1]]))
        beams = [(c, s, (*p, "-".join(x[2] for x in s))) for c, s, p in grown[:width]]
    return list(beams[0][2])


def paragraphs(texts: list[str]) -> list[dict]:
    """anchor and text of a section's paragraphs; p1, p2 for those without designator, .n on repeats."""
    lead = [re.match(r"(?:\(([A-Za-z0-9]{1,5})\)\s*)+", t) for t in texts]
    runs = [re.findall(r"\(([A-Za-z0-9]{1,5})\)", m[0]) if m else [] for m in lead]
    placed = iter(place([t for run in runs for t in run]))
    out, used = [], {}
    for i, (text, run) in enumerate(zip(texts, runs, strict=True)):
        anchor = f"p{i + 1}"
        for _ in run:
            anchor = next(placed)
        used[anchor] = used.get(anchor, 0) + 1
        out.append({"anchor": anchor if used[anchor] == 1 else f"{anchor}.{used[anchor]}", "text": text})
    return out


def placed_paragraphs(texts: Column) -> Column:
    @F.pandas_udf("array<struct<anchor:string,text:string>>")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda ts: paragraphs(list(ts)))

    return run(texts)


# Statutes.

NESTED = {"subsection", "paragraph", "subparagraph", "clause", "subclause", "item"}


def _is_note(x: ET.Element) -> bool:
    """A footnote, or the mark in the text that points at one."""
    name = x.tag.split("}")[-1]
    return name in ("footnote", "ref-note") or name == "ref" and x.get("class") == "footnoteRef" or name == "sup" and "".join(x.itertext()).strip().isdigit()


def flat(x: ET.Element) -> str:
    """All text of an element but its footnotes and their marks."""
    return "" if _is_note(x) else (x.text or "") + "".join(flat(c) + (c.tail or "") for c in x)


def own_text(node: ET.Element) -> str:
    """A level's own words: chapeau, content and continuation, without footnotes and levels below."""
    parts = [flat(c) for c in node if c.tag.split("}")[-1] in ("chapeau", "content", "continuation")]
    return re.sub(r"\s+", " ", " ".join(parts)).strip()


def statute_units(xml: str | None) -> list[dict]:
    """section, anchor and text of each level of a statute's sections; none where xml_error() tells why."""
    root, _ = tree(xml)
    if root is None:
        return []
    out = []
    name = lambda e: e.tag.split("}")[-1]

    def walk(node: ET.Element, section: str, path: list[str]) -> None:
        if name(node) == "quotedContent":
            return
        if name(node) == "section":
            section, path = re.sub(r"^.*/s", "", node.get("identifier", "")), []
        elif name(node) in NESTED:
            number = node.find("{*}num")
            number = node.find("num") if number is None else number
            path = [*path, (number.get("value") if number is not None else None) or str(len(path) + 1)]
        if section and (name(node) == "section" or name(node) in NESTED) and (text := own_text(node)):
            out.append({"section": section, "anchor": "-".join(path), "text": text})
        for child in node:
            walk(child, section, path)

    walk(root, "", [])
    return out


def statute_references(xml: str | None) -> list[dict]:
    """section and target of what each section's operative text points at in the code; itself comes first."""
    root, _ = tree(xml)
    found: dict[tuple[str, str], None] = {}

    def walk(node: ET.Element, section: str) -> None:
        name = node.tag.split("}")[-1]
        if name in ("notes", "note", "sourceCredit"):
            return
        if name == "section" and (m := re.match(r"/us/usc/t(\w+)/s(\w+)$", node.get("identifier", ""))):
            section = f"{m[1]} U.S.C. {m[2]}"
            found[section, section] = None
        if section and name == "ref" and (m := re.match(r"/us/usc/t(\w+)/s([^/]+)", node.get("href", ""))):
            found[section, f"{m[1]} U.S.C. {m[2]}"] = None
        for child in node:
            walk(child, section)

    if root is not None:
        walk(root, "")
    return [{"section": s, "target": t} for s, t in found]


def statute_links(xml: Column) -> Column:
    @F.pandas_udf("array<struct<section:string,target:string>>")
    def run(docs: pd.Series) -> pd.Series:
        return docs.map(statute_references)

    return run(xml)


def statute_anchors(levels: list[tuple[str, int | None]]) -> list[str]:
    """Anchors of a stream of (designator, depth): the document's nesting decides where there is one, else
    the innermost open designator that it succeeds, else it goes a level down."""
    path: list[str] = []
    out = []
    for token, depth in levels:
        if depth is None:
            depth = next((i for i in reversed(range(len(path))) if token in successors(path[i])), len(path))
        path = [*path[:depth], token]
        out.append("-".join(path))
    return out


def successors(token: str) -> set[str]:
    """What may follow a designator: by number, by letter or by roman numeral."""
    from ..operators.graph import alpha, alpha_value, roman, roman_value

    if token.isdigit():
        return {str(int(token) + 1)}
    out = {spell(value(token) + 1) for value, spell in ((alpha_value, alpha), (roman_value, roman)) if value(token)}
    return {x.upper() for x in out} if token.isupper() else out


def statute_placement(tokens: Column, depths: Column) -> Column:
    @F.pandas_udf("array<string>")
    def run(ts: pd.Series, ds: pd.Series) -> pd.Series:
        return pd.Series([statute_anchors([(t, None if d is None or d != d else int(d)) for t, d in zip(x, y, strict=True)]) for x, y in zip(ts, ds, strict=True)])

    return run(tokens, depths)


def statute_rows(xml: Column) -> Column:
    @F.pandas_udf("array<struct<section:string,anchor:string,text:string>>")
    def run(docs: pd.Series) -> pd.Series:
        return docs.map(statute_units)

    return run(xml)


def last_amended(credit: Column) -> Column:
    """The latest of the dates spelled out in a credit line."""
    found = F.regexp_extract_all(credit, F.lit(r"\b((?:Jan|Feb|Mar|Apr|May|June|July|Aug|Sept|Oct|Nov|Dec)[a-z]*\.? \d{1,2}, \d{4})\b"), 1)
    short = F.transform(found, lambda d: F.concat(F.left(d, F.lit(3)), F.regexp_replace(d, r"^[A-Za-z]+\.?", "")))
    return F.array_max(F.transform(short, lambda d: F.to_date(F.try_to_timestamp(d, F.lit("MMM d, yyyy")))))


def release_point(url: Column) -> Column:
    return F.regexp_extract(url, r"releasepoints/us/pl/(\d+)/(\d+)", 1), F.regexp_extract(url, r"releasepoints/us/pl/(\d+)/(\d+)", 2)


def title_code(title: Column) -> Column:
    return F.concat(F.lit("usc"), F.lpad(title.cast("string"), 2, "0"))


# Notices.


def clean_notice(payload: Column) -> Column:
    """Plain text of a notice: the preformatted part, without tags and controls, entities resolved."""
    inner = F.coalesce(F.nullif(F.regexp_extract(payload, r"(?is)<pre[^>]*>(.*?)</pre>", 1), F.lit("")), payload)
    bare = F.regexp_replace(F.regexp_replace(inner, r"<[^>]+>", ""), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    for code, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&sect;", "§"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(code), F.lit(char))
    return bare


def notice_blocks(notices: DataFrame) -> DataFrame:
    """doc, block, page and text of notices (doc, text): blank lines part blocks, page marks carry on."""
    lines = notices.select("doc", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    page = F.regexp_extract("line", r"^\[\[Page (\d+)\]\]\s*$", 1)
    lines = lines.withColumn("mark", F.nullif(page, F.lit("")))
    order = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    blank = F.trim("line") == ""
    lines = lines.withColumns({"page": F.last("mark", ignorenulls=True).over(order), "block": F.sum(blank.cast("int")).over(order)})
    rows = lines.filter(~blank & F.col("mark").isNull()).groupBy("doc", "block").agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("x"), F.first("page").alias("page"))
    return rows.select("doc", "block", F.col("page").cast("int").alias("page"), unwrapped(F.col("x.line")).alias("text"))


def unwrapped(lines: Column) -> Column:
    """Hard-wrapped lines joined; an indented line begins a new one."""
    join = lambda s, x: F.when(s == "", F.trim(x)).when(x.rlike(r"^ {4,}\S"), F.concat(s, F.lit("\n"), F.trim(x))).otherwise(F.concat(s, F.lit(" "), F.trim(x)))
    return F.aggregate(lines, F.lit(""), join)


def heading_kind(block: Column) -> Column:
    """Of a notice's block: part, amendment, section, heading or prose."""
    return (
        F.when(block.rlike(r"^PART \d+"), "part")
        .when(block.rlike(r"^\d+\.\s+(?:The authority|Amend|Revise|Add|Remove|In )"), "amendment")
        .when(block.rlike(r"^§\s*\d+\.\d+"), "section")
        .when((F.length(block) < 120) & block.rlike(r"^[IVX]+\.\s|^[A-Z]\.\s|^[A-Z][A-Z ,'-]+$"), "heading")
        .otherwise("prose")
    )


def notice_units(blocks: DataFrame) -> DataFrame:
    """doc, anchor, heading and text of blocks (doc, block, text, kind): every block that is no prose opens a
    unit, whose anchor tells a section or an amendment by number and others by their words."""
    order = Window.partitionBy("doc").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    rows = blocks.withColumn("unit", F.sum((F.col("kind") != "prose").cast("int")).over(order))
    head = F.when(F.col("kind") != "prose", F.col("text"))
    rows = rows.groupBy("doc", "unit").agg(F.max(head).alias("heading"), F.max(F.when(F.col("kind") != "prose", F.col("kind"))).alias("kind"), F.min("block").alias("pos"), F.sort_array(F.collect_list(F.struct("block", F.when(F.col("kind") == "prose", F.col("text")).alias("text")))).alias("x"))
    number = F.regexp_extract("heading", r"^§?\s*(\d+(?:\.\d+)?)", 1)
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce("heading", F.lit("top"))), r"[^a-z0-9]+", "-"), "^-|-$", "")
    anchor = F.when(F.col("kind") == "section", F.concat(F.lit("sec-"), number)).when(F.col("kind") == "amendment", F.concat(F.lit("amdt-"), number)).otherwise(slug)
    texts = F.transform(F.filter("x", lambda b: b["text"].isNotNull()), lambda b: b["text"])
    rows = rows.select("doc", "pos", anchor.alias("anchor"), F.coalesce("heading", F.lit("")).alias("heading"), F.array_join(texts, "\n").alias("text"))
    from ..operators.text import merged_anchors

    return merged_anchors(rows)


def normalised_references(refs: Column) -> Column:
    """`title CFR part` of structs (title, part), those without part left out, once each."""
    kept = F.filter(refs, lambda r: r["part"].isNotNull())
    return F.array_distinct(F.transform(kept, lambda r: F.concat(r["title"].cast("string"), F.lit(" CFR "), r["part"].cast("string"))))


# Pages of words with boxes (page, x0, y0, x1, y1, size, text), as a PDF reader gives them.


def gutters(boxes: DataFrame, width: int = 612, least: int = 12) -> DataFrame:
    """page, lo and hi of the vertical strips that no text covers, wider than `least` and inside the text."""
    cover = boxes.select("page", F.explode(F.sequence(F.floor("x0").cast("int"), F.ceil("x1").cast("int") - 1)).alias("x"), F.length("text").alias("w"))
    cover = cover.groupBy("page", "x").agg(F.sum("w").alias("w"))
    gap = F.lead("x").over(Window.partitionBy("page").orderBy("x"))
    return cover.select("page", (F.col("x") + 1).alias("lo"), gap.alias("hi")).filter(F.col("hi") - F.col("lo") >= least)


def reading_order(boxes: DataFrame, strips: DataFrame) -> DataFrame:
    """boxes with column and place: columns left to right, lines top to bottom."""
    found = strips.groupBy("page").agg(F.sort_array(F.collect_list((F.col("lo") + F.col("hi")) / 2)).alias("cuts"))
    rows = boxes.join(found, "page", "left")
    column = F.size(F.filter(F.coalesce("cuts", F.array().cast("array<double>")), lambda c: c <= F.col("x0")))
    rows = rows.withColumn("column", column).drop("cuts")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("page").orderBy("column", "y0", "x0")))


def body_size(boxes: DataFrame) -> DataFrame:
    """page and the median of font sizes, weighted by characters."""
    sizes = boxes.groupBy("page", "size").agg(F.sum(F.length("text")).alias("w"))
    upto = F.sum("w").over(Window.partitionBy("page").orderBy("size").rowsBetween(Window.unboundedPreceding, 0))
    rows = sizes.withColumns({"upto": upto, "all": F.sum("w").over(Window.partitionBy("page"))})
    return rows.filter(F.col("upto") * 2 >= F.col("all")).groupBy("page").agg(F.min("size").alias("body"))


def needs_ocr(image_share: Column, chars: Column, square_inches: Column) -> Column:
    return (image_share >= 0.4) & (chars / square_inches < 2)


def package_date(name: Column) -> Column:
    """The date in a package name such as CFR-2021-title5-vol1 or FR-2021-03-04."""
    day = F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2})", 1)
    year = F.regexp_extract(name, r"CFR-(\d{4})-", 1)
    return F.when(day != "", day.try_cast("date")).when(year != "", F.concat(year, F.lit("-01-01")).try_cast("date"))


def unescaped(text: str) -> str:
    return entities.unescape(text)

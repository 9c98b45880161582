"""Readers of pages, codes, statutes, notices and page geometry (S13 to S45 keys, C14 to C16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.graph import found_references
from ..sources import contract, html, markup
from .base import query, table


@query("s20_main_text")
def s20(spark, sf):
    return table(spark, sf, "pages").select("page_id", html.page_text(F.col("html")).alias("text"))


@query("s22_units")
def s22(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.posexplode(html.page_units(F.col("html"))).alias("pos", "u")).select("page_id", "pos", "u.*")


@query("s23_doc_id", "WITH p AS (SELECT page_id, html, list_filter(string_split(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', ''), '/'), lambda x: x <> '') AS parts FROM pages) SELECT page_id, array_to_string(parts[greatest(1, len(parts) - 1):], '-') AS doc_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title FROM p")
def s23(spark, sf):
    return table(spark, sf, "pages").select("page_id", html.doc_id(F.col("url")).alias("doc_id"), html.title(F.col("html")).alias("title"))


@query("s24_citations", "SELECT page_id, r.kind, r.phrase FROM pages, (VALUES ('section', '§ 630.310'), ('cfr', '5 CFR 351.403(a)'), ('usc', '5 U.S.C. 6304')) AS r(kind, phrase)")
def s24(spark, sf):
    page = F.concat("html", F.lit("<p>See § 630.310, 5 CFR 351.403(a) and 5 U.S.C. 6304.</p>"))
    return table(spark, sf, "pages").select("page_id", F.explode(found_references(page, F.lit(""), F.lit(""))).alias("r")).select("page_id", "r.kind", "r.phrase")


STATUTE = """<title><section identifier="/us/usc/t5/s6304"><num value="6304">6304</num><subsection><num value="a">(a)</num><chapeau>Annual leave<footnote>x</footnote> accrues</chapeau><paragraph><num value="1">(1)</num><content>not used;</content></paragraph><continuation>and lapses.</continuation></subsection><subsection><num value="b">(b)</num><content>See note.</content></subsection><sourceCredit>(Pub. L. 89-554, Sept. 6, 1966, 80 Stat. 519; Pub. L. 93-181, Dec. 14, 1973, 87 Stat. 705.)</sourceCredit></section></title>"""

def _filled(template: str):
    """A text with the page's number in place of every {n}."""
    return F.replace(F.lit(template), F.lit("{n}"), F.col("page_id").cast("string"))


PART = """<DIV5 N="630" TYPE="PART"><DIV6 N="B" TYPE="SUBPART"><DIV8 N="§ 630.{n}" TYPE="SECTION"><HEAD>§ 630.{n} Definitions of {n}.</HEAD><P>(a) In this part<FTNT><P>a note</P></FTNT>, leave {n} means:</P><P>(1) Annual leave; and</P><P>(i) Sick leave.</P><P>(2) Other leave.</P><P>(b) <I>Agency</I> means any.</P><CITA>[64 FR 1]</CITA></DIV8><DIV8 N="§ 631.{n}" TYPE="SECTION"><HEAD>§ 631.{n} Tables.</HEAD><P>Flush text:</P><TABLE><TR><TH>Years</TH><TH>Days</TH></TR><TR><TD>{n}</TD><TD>13</TD></TR></TABLE></DIV8></DIV6></DIV5>"""
_FIRST = ["(a) In this part, leave {n} means:", "(1) Annual leave; and", "(i) Sick leave.", "(2) Other leave.", "(b) Agency means any."]
_PLACES = ["a", "a-1", "a-1-i", "a-2", "b"]


def _sections(spark, sf):
    """A part of two sections for each page; every fifth part is cut short and every seventh declares an entity."""
    n = F.col("page_id")
    xml = F.when(n % 5 == 3, F.left(_filled(PART), F.lit(60))).when(n % 7 == 4, F.concat(F.lit("<!DOCTYPE x [<!ENTITY e 'f'>]>"), _filled(PART))).otherwise(_filled(PART))
    return table(spark, sf, "pages").select("page_id", xml.alias("xml"))


def _read(spark, sf):
    return _sections(spark, sf).select("page_id", F.explode(markup.code_sections(F.col("xml"))).alias("s")).select("page_id", "s.*")


_GOOD = "g AS (SELECT page_id, page_id::VARCHAR AS n FROM pages WHERE page_id % 5 <> 3 AND page_id % 7 <> 4)"


@query("h10_xml_errors", "SELECT page_id, CASE WHEN page_id % 5 = 3 THEN 'not well-formed: ParseError' WHEN page_id % 7 = 4 THEN 'declares a document type or entities' END AS error FROM pages")
def h10(spark, sf):
    return _sections(spark, sf).select("page_id", markup.xml_error(F.col("xml")).alias("error"))


@query("s13_sections", f"WITH {_GOOD} SELECT page_id, '630.' || n AS section, 'Definitions of ' || n AS heading, 'B' AS subpart, 5 AS paragraphs FROM g UNION ALL SELECT page_id, '631.' || n, 'Tables', 'B', 2 FROM g")
def s13(spark, sf):
    return _read(spark, sf).select("page_id", "section", "heading", "subpart", F.size("paragraphs").alias("paragraphs"))


@query(
    "s15_tables",
    f"WITH {_GOOD} SELECT page_id, '630.' || n AS section, pos::INTEGER AS pos, replace(({_FIRST!r})[pos + 1], '{{n}}', n) AS text FROM g, range(0, 5) AS r(pos) UNION ALL SELECT page_id, '631.' || n, 0, 'Flush text:' FROM g UNION ALL SELECT page_id, '631.' || n, 1, 'Years | Days' || chr(10) || n || ' | 13' FROM g",
)
def s15(spark, sf):
    return _read(spark, sf).select("page_id", "section", F.posexplode("paragraphs").alias("pos", "text"))


@query("c14_placement", f"WITH {_GOOD} SELECT page_id, '630.' || n AS section, ({_PLACES!r})[pos + 1] AS anchor FROM g, range(0, 5) AS r(pos)")
def c14(spark, sf):
    rows = _read(spark, sf).filter("section like '630.%'")
    return rows.select("page_id", "section", F.explode(markup.placed_paragraphs(F.col("paragraphs"))).alias("p")).select("page_id", "section", "p.anchor")


@query("c13_designator_streams")
def c13(spark, sf):
    rows = spark.createDataFrame([(1, "a 1 i ii 2 b c d e f g h i j".split()), (2, "a b 1 2 A B 3".split()), (3, "1 2 a b 3".split()), (4, "i ii iii iv".split())], "id int, tokens array<string>")
    texts = F.transform("tokens", lambda t: F.concat(F.lit("("), t, F.lit(") x")))
    return rows.select("id", F.array_join(F.transform(markup.placed_paragraphs(texts), lambda p: p["anchor"]), " ").alias("anchors"))


LAW = """<title><section identifier="/us/usc/t5/s{n}"><num value="{n}">{n}</num><subsection><num value="a">(a)</num><chapeau>Leave {n}<ref class="footnoteRef">1</ref><footnote>x</footnote> accrues<sup>2</sup></chapeau><paragraph><num value="1">(1)</num><content>under <ref href="/us/usc/t5/s6304/a">section 6304</ref>;</content></paragraph><continuation>and lapses.</continuation></subsection><subsection><num value="b">(b)</num><content>See <ref href="/us/usc/t42/s2000e">it</ref> and <ref href="/us/pl/89/554">law</ref>.</content></subsection><notes><note>See <ref href="/us/usc/t1/s1">1</ref></note></notes></section></title>"""


def _laws(spark, sf):
    return table(spark, sf, "pages").select("page_id", _filled(LAW).alias("xml"))


@query("s33_statute", "SELECT page_id, page_id::VARCHAR AS section, u.anchor, replace(u.text, '{n}', page_id::VARCHAR) AS text FROM pages, (VALUES ('a', 'Leave {n} accrues and lapses.'), ('a-1', 'under section 6304;'), ('b', 'See it and law.')) AS u(anchor, text)")
def s33(spark, sf):
    return _laws(spark, sf).select("page_id", F.explode(markup.statute_rows(F.col("xml"))).alias("u")).select("page_id", "u.*")


@query("s38_statute_references", "SELECT page_id, '5 U.S.C. ' || page_id::VARCHAR AS section, unnest(list_distinct(['5 U.S.C. ' || page_id::VARCHAR, '5 U.S.C. 6304', '42 U.S.C. 2000e'])) AS target FROM pages")
def s38(spark, sf):
    return _laws(spark, sf).select("page_id", F.explode(markup.statute_links(F.col("xml"))).alias("u")).select("page_id", "u.*")


@query("c16_statute_placement", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'a a-1 a-2 b' WHEN 1 THEN 'a a-1 A' ELSE 'a a-1 a-1-i a-1-ii a-2 b' END AS anchors FROM pages")
def c16(spark, sf):
    """Designators with the depth that the document's nesting gives, or none."""
    none = F.lit(None).cast("int")
    texts = {0: "a 1 2 b", 1: "a 1 A", 2: "a 1 i ii 2 b"}
    tokens = F.when(F.col("page_id") % 3 == 0, F.split(F.lit(texts[0]), " ")).when(F.col("page_id") % 3 == 1, F.split(F.lit(texts[1]), " ")).otherwise(F.split(F.lit(texts[2]), " "))
    rows = table(spark, sf, "pages").select("page_id", tokens.alias("t"))
    depths = F.transform("t", lambda t, i: F.when((F.col("page_id") % 3 == 1) & (t == "A"), F.lit(0)).otherwise(none))
    return rows.select("page_id", F.array_join(markup.statute_placement(F.col("t"), depths), " ").alias("anchors"))


@query("s35_last_amended", "SELECT 1 AS id, '1973-12-14' AS amended UNION ALL SELECT 2, NULL UNION ALL SELECT 3, '2001-06-05'")
def s35(spark, sf):
    rows = spark.createDataFrame([(1, STATUTE), (2, "no dates"), (3, "(June 5, 2001; Feb. 30, 2010)")], "id int, credit string")
    return rows.select("id", markup.last_amended(F.col("credit")).cast("string").alias("amended"))


@query("s39_release_point", "SELECT 'usc05' AS code, '118' AS congress, '42' AS law")
def s39(spark, sf):
    congress, law = markup.release_point(F.lit("https://host/releasepoints/us/pl/118/42/xml_usc05.zip"))
    return spark.range(1).select(markup.title_code(F.lit(5)).alias("code"), congress.alias("congress"), law.alias("law"))


@query("s26_notice_text", "SELECT page_id, 'Notice ' || page_id::VARCHAR || ' under § 6 & <b> said' AS text FROM pages")
def s26(spark, sf):
    return table(spark, sf, "pages").select("page_id", markup.clean_notice(_filled("<html><pre>Notice <a href='x'>{n}</a> under &sect; 6 &amp; &lt;b&gt; said</pre><p>not this</p></html>")).alias("text"))


RULE = "<pre>[[Page 10{n}]]\n\nSUMMARY\n\nThe agency proposes {n} to read\nas follows.\n    A new paragraph\ngoes on.\n\n[[Page 20{n}]]\n\nPART 630 LEAVE\n\n1. The authority citation reads:\n\n§ 630.{n} Scope.\n\nText of {n}.\n\nMore text.</pre>"
_BLOCKS = [("heading", 0, "SUMMARY"), ("prose", 0, "The agency proposes {n} to read as follows.\nA new paragraph goes on."), ("part", 1, "PART 630 LEAVE"), ("amendment", 1, "1. The authority citation reads:"), ("section", 1, "§ 630.{n} Scope."), ("prose", 1, "Text of {n}."), ("prose", 1, "More text.")]
_UNITS = [("summary", "SUMMARY", "The agency proposes {n} to read as follows.\nA new paragraph goes on."), ("part-630-leave", "PART 630 LEAVE", ""), ("amdt-1", "1. The authority citation reads:", ""), ("sec-630.{n}", "§ 630.{n} Scope.", "Text of {n}.\nMore text.")]


def _values(rows) -> str:
    """Rows of numbers and texts for VALUES; line ends are spelled out."""

    def one(x) -> str:
        return str(x) if isinstance(x, int) else " || chr(10) || ".join(f"'{line}'" for line in x.split("\n"))

    return ", ".join(f"({', '.join(map(one, r))})" for r in rows)


def _notice_blocks(spark, sf):
    notices = table(spark, sf, "pages").select(F.col("page_id").alias("doc"), markup.clean_notice(_filled(RULE)).alias("text"))
    return markup.notice_blocks(notices).withColumn("kind", markup.heading_kind(F.col("text")))


@query("s27_notice_blocks", f"SELECT page_id AS doc, kind, (CASE page WHEN 0 THEN '10' ELSE '20' END || page_id::VARCHAR)::INTEGER AS page, replace(text, '{{n}}', page_id::VARCHAR) AS text FROM pages, (VALUES {_values(_BLOCKS)}) AS b(kind, page, text)")
def s27(spark, sf):
    return _notice_blocks(spark, sf).select("doc", "kind", "page", "text")


@query("s29_notice_units", f"SELECT page_id AS doc, replace(anchor, '{{n}}', page_id::VARCHAR) AS anchor, replace(heading, '{{n}}', page_id::VARCHAR) AS heading, replace(text, '{{n}}', page_id::VARCHAR) AS text FROM pages, (VALUES {_values(_UNITS)}) AS u(anchor, heading, text)")
def s29(spark, sf):
    return markup.notice_units(_notice_blocks(spark, sf)).select("doc", "anchor", "heading", "text")


@query("s31_references", "SELECT '5 CFR 630,29 CFR 1614' AS refs")
def s31(spark, sf):
    rows = spark.createDataFrame([([(5, 630), (5, None), (29, 1614), (5, 630)],)], "r array<struct<title:int,part:int>>")
    return rows.select(F.array_join(markup.normalised_references(F.col("r")), ",").alias("refs"))


@query("s32_dedup_notices", "SELECT min(page_id) AS page_id FROM pages GROUP BY regexp_replace(lower(url), '[?#].*$', '')")
def s32(spark, sf):
    return table(spark, sf, "pages").groupBy(html.canonical(F.col("url")).alias("u")).agg(F.min("page_id").alias("page_id")).select("page_id")


@query("s36_selected", "SELECT want, CASE WHEN min(page_id) IS NULL THEN 'missing' ELSE 'found' END AS status FROM (VALUES (1), (7), (123456789)) AS w(want) LEFT JOIN pages ON page_id = want GROUP BY want")
def s36(spark, sf):
    asked = spark.createDataFrame([(1,), (7,), (123456789,)], "want int")
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("want"), F.lit("found").alias("status")).distinct()
    return asked.join(pages, "want", "left").select("want", F.coalesce("status", F.lit("missing")).alias("status"))


def _boxes(spark):
    left = [(1, 50, 100 + 20 * i, 280, 110 + 20 * i, 10.0, "left column line") for i in range(5)]
    right = [(1, 320, 100 + 20 * i, 560, 110 + 20 * i, 10.0, "right column line") for i in range(5)]
    return spark.createDataFrame([*right, *left, (1, 60, 60, 200, 80, 16.0, "Heading")], "page int, x0 int, y0 int, x1 int, y1 int, size double, text string")


@query("s40_reading_order")
def s40(spark, sf):
    boxes = _boxes(spark)
    return markup.reading_order(boxes, markup.gutters(boxes)).select("page", "place", "column", "text", "y0")


@query("s41_body_size", "SELECT 1 AS page, 10.0::DOUBLE AS body")
def s41(spark, sf):
    return markup.body_size(_boxes(spark))


@query("s42_needs_ocr", "SELECT page_id, page_id % 10 >= 4 AND (length(html) / 100::DOUBLE) < 2 AS ocr FROM pages")
def s42(spark, sf):
    return table(spark, sf, "pages").select("page_id", markup.needs_ocr((F.col("page_id") % 10) / 10, F.length("html"), F.lit(100.0)).alias("ocr"))


@query("s44_package_date", "SELECT 'CFR-2021-title5-vol1' AS name, '2021-01-01' AS valid_from UNION ALL SELECT 'FR-2021-03-04', '2021-03-04' UNION ALL SELECT 'other', NULL")
def s44(spark, sf):
    rows = spark.createDataFrame([("CFR-2021-title5-vol1",), ("FR-2021-03-04",), ("other",)], "name string")
    return rows.select("name", markup.package_date(F.col("name")).cast("string").alias("valid_from"))


def _documents(spark, sf):
    units = F.transform(html.page_units(F.col("html")), lambda u: F.struct(u["anchor"].alias("anchor"), u["text"].alias("text"), u["heading"].alias("heading"), u["kind"].alias("kind"), F.lit("").alias("locator")))
    return table(spark, sf, "pages").select(
        F.lit("pages").alias("source"), html.doc_id(F.col("url")).alias("doc_id"), html.title(F.col("html")).alias("title"), (1 + F.col("page_id") % 7).cast("int").alias("authority"),
        F.when(F.col("page_id") % 11 > 0, F.to_date(F.lit("2024-01-01"))).alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), "url", F.array().cast("array<string>").alias("references"),
        F.create_map().cast("map<string,string>").alias("meta"), units.alias("units"),
    )


@query("s18_contract")
def s18(spark, sf):
    return contract.violations(_documents(spark, sf))


@query("w8_document_rows")
def w8(spark, sf):
    return contract.document_chunks(_documents(spark, sf).filter("valid_from is not null"))


@query("s37_undated", "SELECT count(*) FILTER (page_id % 11 = 0) AS dropped, count(*) FILTER (page_id % 11 <> 0) AS kept FROM pages")
def s37(spark, sf):
    return table(spark, sf, "pages").agg(F.count_if(F.col("page_id") % 11 == 0).alias("dropped"), F.count_if(F.col("page_id") % 11 != 0).alias("kept"))

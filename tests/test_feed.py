import pytest
from pyspark.sql import functions as F

from smelter.operators.contract import VIOLATIONS, rejected_rows, valid_rows
from smelter.plans.bronze import accepted_articles, feed_rules, fetched_entries, page_rules
from smelter.schemas import PAGE
from smelter.sources.feed import (
    MALFORMED, needs_scopes, parse_pages, read_page_table, read_pages, scan_entries, with_ordinal,
)

ATOM = "http://www.w3.org/2005/Atom"


def feed(*entries, head=f'<feed xmlns="{ATOM}">', tail="</feed>"):
    return f'<?xml version="1.0" encoding="UTF-8"?>{head}<title>q</title>{"".join(entries)}{tail}'


def entry(
    id="http://x/abs/2404.00042v1", title="On Rivers", summary="Water flows.",
    authors=("Mary",), terms=("cs.SE",), published="2024-01-01T12:00:00Z",
    updated="2024-01-02T15:00:00Z", links='<link title="pdf" href="http://x/pdf/1"/>',
):
    tag = lambda name, text: "" if text is None else f"<{name}>{text}</{name}>"
    people = "".join(f"<author>{tag('name', a)}</author>" for a in authors)
    cats = "".join("<category/>" if t is None else f'<category term="{t}"/>' for t in terms)
    return (
        f"<entry>{tag('id', id)}{tag('updated', updated)}{tag('published', published)}"
        f"{tag('title', title)}{tag('summary', summary)}{people}{cats}{links}</entry>"
    )


def page_frame(spark, *payloads, category="cs.SE"):
    rows = [(category, 1000 * i, p) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, PAGE)


def parse_one(spark, xml):
    rows = parse_pages(page_frame(spark, feed(xml))).collect()
    assert len(rows) == 1
    return rows[0]


def test_entry_is_mapped(spark):
    row = parse_one(spark, entry(authors=("Mary", "Ada"), terms=(" cs.SE ", "", None, "cs.AI\n")))
    assert (row["id"], row["title"], row["summary"]) == ("2404.00042v1", "On Rivers", "Water flows.")
    assert row["authors"] == ["Mary", "Ada"] and row["categories"] == ["cs.SE", "cs.AI"]
    assert str(row["published_date"]) == "2024-01-01 12:00:00"
    assert row["pdf_url"] == "http://x/pdf/1"


def test_titles_keep_their_spaces_and_summaries_do_not(spark):
    row = parse_one(spark, entry(title="  T\n ", summary="\n  S &amp; x  "))
    assert (row["title"], row["summary"]) == ("  T\n ", "S & x")


@pytest.mark.parametrize(
    "links, url",
    [
        ("", ""),
        ('<link href="h"/>', ""),
        ('<link title="pdf"/>', None),
        ('<link title="x" href="a"/><link title="pdf" href="b"/><link title="pdf" href="c"/>', "b"),
    ],
)
def test_pdf_link(spark, links, url):
    assert parse_one(spark, entry(links=links))["pdf_url"] == url


def test_first_of_repeated_elements(spark):
    assert parse_one(spark, entry(title="one</title><title>two"))["title"] == "one"


def test_prefixed_and_cdata_feeds(spark):
    prefixed = (
        f'<a:feed xmlns:a="{ATOM}"><a:entry><a:id>x/7</a:id>'
        "<a:title><![CDATA[a < b]]></a:title></a:entry></a:feed>"
    )
    row = parse_pages(page_frame(spark, prefixed)).first()
    assert (row["id"], row["title"]) == ("7", "a < b")


SCOPES = [
    # (page, ids and titles found)
    (feed('<entry><title xmlns="urn:x">no</title><id>x/1</id><title>T</title></entry>'), [("1", "T")]),
    (feed('<x xmlns="urn:x"><entry><id>x/0</id></entry></x>', entry(id="x/1", title="T")), [("1", "T")]),
    (f'<a:feed xmlns:a="{ATOM}"><entry><id>x/0</id></entry><a:entry><a:id>x/1</a:id><a:title>T&amp;\r\nU</a:title></a:entry></a:feed>', [("1", "T&\nU")]),
    (f'<a:feed xmlns:a="{ATOM}" xmlns="urn:x"><a:entry><a:id>x/1</a:id><title>no</title><a:title>T</a:title></a:entry></a:feed>', [("1", "T")]),
    (f'<r:feed xmlns:r="{ATOM}"><r:entry xmlns:r="urn:x"><r:id>x/0</r:id></r:entry><q:entry xmlns:q="{ATOM}"><q:id>x/1</q:id><q:title>T</q:title></q:entry></r:feed>', [("1", "T")]),
    (f'<feed xmlns="{ATOM}"><entry xmlns="urn:x"><id>x/0</id></entry><b:entry xmlns:b="{ATOM}"><id>x/1</id><title>T</title></b:entry></feed>', [("1", "T")]),
]


@pytest.mark.parametrize("page, found", SCOPES)
def test_names_are_resolved_by_scope(spark, page, found):
    rows = parse_pages(page_frame(spark, page)).collect()
    assert [(r["id"], r["title"]) for r in rows] == found


def test_pages_are_held_by_the_same_rule_without_python(spark):
    root = f'<feed xmlns="{ATOM}">'
    pages = [
        (f"{root}</feed>", False), ("<feed></feed>", False), (None, False), (f"{root}<title>xmlns</title></feed>", False),
        (f"{root}<title>a xmlns= b</title></feed>", True), (f'<feed xmlns{" " * 200}="{ATOM}"></feed>', False),
        (f'<feed xmlns:a="{ATOM}"></feed>', True), ('<feed xmlns="urn:x"></feed>', True), ("<feed> xmlns </feed>", False),
        (f'<feed><x xmlns="{ATOM}"/></feed>', True), (f'<feed xmlns:b="urn:x" xmlns="{ATOM}"></feed>', False),
    ]
    df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(pages)], "page_start bigint, payload string")
    assert [r[1] for r in sorted(df.select("page_start", needs_scopes(F.col("payload"))).collect())] == [w for _, w in pages]
    rows = parse_pages(df, held="_held")
    got = {r["page_start"]: r["_held"] for r in rows.collect() if r["_held"] is not None}
    assert got == {i: p for i, (p, w) in enumerate(pages) if w}
    assert "EvalPython" not in rows._jdf.queryExecution().toString()


def test_broken_pages_with_scopes_are_rejects(spark):
    broken = feed('<entry><title xmlns="urn:x">no</title>', entry())
    rows = parse_pages(page_frame(spark, broken, broken.replace("urn:x", "&nbsp;"))).collect()
    assert [r[MALFORMED] for r in rows] == [True, True]


def test_dumps_are_read_as_they_declare(spark, tmp_path):
    text = feed(entry(id="x/1", title="Caf\u00e9 \u00fc"), entry(id="x/2", title="\u00e9"))
    files = {"latin": ("ISO-8859-1", "latin-1"), "utf8": ("UTF-8", "utf-8"), "wide": ("UTF-16", "latin-1"), "false": ("UTF-8", "latin-1")}
    for name, (declared, used) in files.items():
        (tmp_path / f"{name}.xml").write_bytes(text.replace("UTF-8", declared).encode(used))
    for name in files:
        rows = scan_entries(spark, str(tmp_path / f"{name}.xml")).collect()
        if name in ("latin", "utf8"):
            assert sorted((r["id"], r["title"]) for r in rows) == [("1", "Caf\u00e9 \u00fc"), ("2", "\u00e9")]
        else:
            assert rows and all(r[MALFORMED] for r in rows)
    both = scan_entries(spark, f"{tmp_path}/[lu]*.xml").filter(~F.col(MALFORMED))
    assert both.count() == 4
    told = scan_entries(spark, str(tmp_path / "latin.xml"), encoding="iso-8859-1")
    assert {r["title"] for r in told.collect()} == {"Caf\u00e9 \u00fc", "\u00e9"}


def test_attributes_foreign_elements_and_byte_order_marks(spark):
    rich = (
        '<entry xmlns:f="http://f"><id>x/1</id><title type="html">T</title><summary>S</summary>'
        "<author><name>A</name><f:affiliation>U</f:affiliation></author><f:comment>c</f:comment>"
        '<f:primary_category term="cs.XX"/><category term="cs.AI" scheme="s"/></entry>'
    )
    for payload in (feed(rich), "\ufeff" + feed(rich), feed(rich) + "\n"):
        row = parse_pages(page_frame(spark, payload)).first()
        assert (row["id"], row["title"], row["summary"]) == ("1", "T", "S")
        assert (row["authors"], row["categories"]) == (["A"], ["cs.AI"])


def test_positions_pages_and_empty_feeds(spark):
    two = feed(entry(id="x/1"), entry(id="x/2"))
    rows = parse_pages(page_frame(spark, two, feed(), two)).collect()
    assert [(r["page_start"], r["entry_pos"], r["id"]) for r in rows] == [
        (0, 0, "1"), (0, 1, "2"), (2000, 0, "1"), (2000, 1, "2"),
    ]


REJECTED = {
    "id_required": [entry(id=None), entry(id=""), entry(id="http://x/")],
    "title_required": [entry(title=None), entry(title="")],
    "summary_required": [entry(summary=None), entry(summary=" \n ")],
    "authors_not_empty": [entry(authors=()), entry(authors=("",)), entry(authors=("a", None))],
    "categories_not_empty": [entry(terms=()), entry(terms=(" ", None))],
    "published_date_present": [entry(published=None), entry(published="soon")],
    "updated_date_present": [entry(updated=""), entry(updated="2024")],
    "pdf_url_present": [entry(links='<link title="pdf"/>')],
}


@pytest.mark.parametrize("rule", REJECTED)
def test_one_bad_entry_never_stops_the_others(spark, rule):
    page = feed(*REJECTED[rule], entry(id="x/good"), entry(id="x/blank-title", title=" "))
    entries = parse_pages(page_frame(spark, page))
    assert [r["id"] for r in valid_rows(entries, feed_rules()).collect()] == ["good", "blank-title"]
    reasons = [r[VIOLATIONS] for r in rejected_rows(entries, feed_rules()).collect()]
    assert reasons == [[rule]] * len(REJECTED[rule])


def test_malformed_pages_are_rejected_not_lost(spark):
    good = feed(entry())
    pages = page_frame(spark, good[:-9], "not xml", None, good)
    entries = parse_pages(pages)
    assert valid_rows(entries, feed_rules()).count() == 1
    bad = rejected_rows(entries, feed_rules()).collect()
    assert sorted(r["page_start"] for r in bad) == [0, 1000, 2000]
    assert all(r[VIOLATIONS][0] == "page_well_formed" for r in bad)


def land(tmp_path, category, start, payload):
    folder = tmp_path / "landed" / f"category={category}" / f"start={start}"
    folder.mkdir(parents=True)
    lines = payload.replace("<entry", "\n <entry").replace("<author", "\n<author")
    (folder / "page.xml").write_text(lines, encoding="utf-8")


def test_landed_files(spark, tmp_path):
    land(tmp_path, "cs.AI", 0, feed(entry(id="x/1"), entry(id="x/2")))
    land(tmp_path, "cs.CL", 0, feed(entry(id="x/2", title="other copy"), entry(id="x/3")))
    land(tmp_path, "cs.CL", 1000, feed())
    land(tmp_path, "econ.EM", 0, feed(entry(id="x/unlisted")))
    pages = read_pages(spark, str(tmp_path / "landed"))
    ranked = {r["category"]: r["category_ordinal"] for r in with_ordinal(pages).collect()}
    assert ranked == {"cs.AI": 1, "cs.CL": 2}
    got = accepted_articles(fetched_entries(pages)).orderBy("id").collect()
    assert [(r["id"], r["title"]) for r in got] == [
        ("1", "On Rivers"), ("2", "On Rivers"), ("3", "On Rivers"),
    ]
    swapped = accepted_articles(fetched_entries(pages, ["cs.CL", "cs.AI"])).filter("id = '2'")
    assert swapped.first()["title"] == "other copy"
    scanned = scan_entries(spark, str(tmp_path / "landed/*/*/*.xml"))
    assert sorted(r["id"] for r in scanned.collect()) == ["1", "2", "2", "3", "unlisted"]
    # Every size and order is the same for pages kept as a columnar table.
    pages.write.parquet(str(tmp_path / "table"))
    table = read_page_table(spark, str(tmp_path / "table"))
    assert accepted_articles(fetched_entries(table)).count() == 3


def test_a_huge_dump_is_read_by_many_tasks(spark, tmp_path):
    dump = tmp_path / "dump.xml"
    entries = [entry(id=f"x/{i}", summary="line\n" * 500 + str(i)) for i in range(400)]
    entries[7] = "<entry><id>x/7</id><title>cut off</entry>"
    dump.write_text(feed("\n".join(entries)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128k")
    try:
        scanned = scan_entries(spark, str(dump))
        assert scanned.select(F.spark_partition_id()).distinct().count() > 4
        ids = sorted(int(r["id"]) for r in valid_rows(scanned, feed_rules()).collect())
        assert ids == [i for i in range(400) if i != 7]
        assert [r[VIOLATIONS][0] for r in rejected_rows(scanned, feed_rules()).collect()] == [
            "page_well_formed"
        ]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    dump.write_text(feed(entry(id="x/1")).replace("<entry>", "<a:entry>").replace("</entry>", "</a:entry>"))
    assert [r["id"] for r in scan_entries(spark, str(dump), "a:entry").collect()] == ["1"]


def test_budget_counts_copies_but_only_valid_rows(spark):
    first = feed(entry(id="x/1"), entry(id="x/1"), entry(id="x/bad", title="", summary="z" * 9999))
    pages = page_frame(spark, first, feed(entry(id="x/2")), feed(entry(id="x/3")))
    entries = fetched_entries(pages)
    size = len("1On RiversWater flows.http://x/pdf/1Marycs.SE".encode()) + 16

    def ids(budget):
        return sorted(r["id"] for r in accepted_articles(entries, budget).collect())

    assert ids(2 * size) == ["1"]
    assert ids(2 * size + 1) == ["1", "2"]
    assert ids(3 * size + 1) == ids(None) == ["1", "2", "3"]


def test_page_table_reads_only_what_is_asked(spark, tmp_path):
    page_frame(spark, feed(entry())).write.parquet(str(tmp_path / "p"))
    plan = read_page_table(spark, str(tmp_path / "p")).select(F.col("category"))
    assert "payload" not in plan._jdf.queryExecution().executedPlan().toString()


def test_entries_of_a_piece_are_all_read(spark, tmp_path):
    one, two, three = (entry(id=str(i)) for i in (1, 2, 3))
    spaced = one.replace("</entry>", "</entry >")
    last = three.replace("</entry>", "</entry\n>")
    for name, entries in (("a", (spaced, two, three)), ("b", (one, two, last)), ("c", (spaced, two.replace("</entry>", "</entry >"), last))):
        path = tmp_path / f"{name}.xml"
        path.write_text(feed(*entries))
        rows = scan_entries(spark, str(path)).collect()
        assert sorted(r["id"] for r in rows) == ["1", "2", "3"] and not any(r[MALFORMED] for r in rows)


def test_a_closing_tag_in_text_is_flagged(spark, tmp_path):
    path = tmp_path / "d.xml"
    path.write_text(feed(entry(id="1", title="<![CDATA[a </entry> b]]>"), entry(id="2")))
    rows = scan_entries(spark, str(path)).collect()
    assert sorted((r["id"] or "", r[MALFORMED]) for r in rows) == [("", True), ("2", False)]


def test_pages_are_parsed_once(spark, tmp_path):
    (tmp_path / "e.xml").write_text(feed(entry()))
    both = parse_pages(page_frame(spark, feed(entry()))), scan_entries(spark, str(tmp_path / "e.xml"))
    for rows in both:
        for checked in (valid_rows(rows, feed_rules()), rejected_rows(rows, feed_rules())):
            plan = checked._jdf.queryExecution().optimizedPlan().toString()
            assert plan.count("from_xml") == 1


def test_pages_without_a_start_are_rejected(spark):
    pages = spark.createDataFrame([("cs.SE", None, feed(entry(id="1"))), ("cs.SE", 0, feed(entry(id="2")))], PAGE)
    entries = fetched_entries(pages)
    assert [r["id"] for r in accepted_articles(entries, 1 << 30).collect()] == ["2"]
    assert [r[VIOLATIONS] for r in rejected_rows(entries, page_rules()).collect()] == [["page_start_present"]]


def test_elements_of_other_vocabularies_are_not_atom(spark, tmp_path):
    inner = (
        '<m:title>foreign</m:title><m:id>x/9</m:id><m:link title="pdf" href="foreign"/>'
        '<link m:title="pdf" href="other"/>'
    )
    mixed = entry(id="x/1").replace("<entry>", f'<entry xmlns:m="http://m">{inner}')
    prefixed = f'<a:feed xmlns:m="http://m" xmlns:a="{ATOM}"><a:entry>{inner}<a:id>x/2</a:id><a:title>T</a:title></a:entry></a:feed>'
    rows = parse_pages(page_frame(spark, feed(mixed), prefixed)).collect()
    assert [(r["id"], r["title"], r["pdf_url"]) for r in rows] == [("1", "On Rivers", "http://x/pdf/1"), ("2", "T", "")]
    (tmp_path / "f.xml").write_text(feed(mixed, entry(id="x/2")))
    scanned = scan_entries(spark, str(tmp_path / "f.xml")).collect()
    assert sorted((r["id"], r["title"]) for r in scanned) == [("1", "On Rivers"), ("2", "On Rivers")]


def test_declared_encodings(spark, tmp_path):
    cases = {0: "UTF-8", 1000: "ISO-8859-1", 2000: "KOI8-R", 3000: "UTF-16"}
    for start, name in cases.items():
        folder = tmp_path / "landed" / "category=cs.AI" / f"start={start}"
        folder.mkdir(parents=True)
        text = feed(entry(id=f"x/{start}", title="café")).replace("UTF-8", name)
        (folder / "page.xml").write_bytes(text.encode("utf-8" if name == "KOI8-R" else name))
    broken = tmp_path / "landed" / "category=cs.AI" / "start=4000"
    broken.mkdir()
    (broken / "page.xml").write_bytes(feed(entry(title="café")).encode("latin-1"))
    entries = fetched_entries(read_pages(spark, str(tmp_path / "landed")))
    good = accepted_articles(entries).orderBy("id").collect()
    assert [(r["id"], r["title"]) for r in good] == [("0", "café"), ("1000", "café")]
    assert sorted(r["page_start"] for r in rejected_rows(entries, page_rules()).collect()) == [2000, 3000, 4000]

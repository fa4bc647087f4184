"""Well-formed XML: elements, whole texts, sections, and documents that can't be read."""

import pytest

from tessel.operators import segment
from tessel.sources import documents, markup

KIND = "doc_id string, text string"


def texts(xml, tags=("P", "HD", "FP"), least=8):
    rows, error = markup.texts_of(xml, tags, least)
    assert error is None
    return [(tag, text) for _, tag, text in rows]


def test_entities_prefixes_cdata_and_nesting():
    xml = """<R xmlns:ns="urn:x"><P>load &amp; force &#167; 5</P><ns:P>prefixed paragraph text</ns:P><P><![CDATA[inside <b> cdata]]> section</P>
    <p a='>'>lower case<!-- <P>no paragraph</P> --> name</p><FP>outer text<P>inner text</P>tail<br/>end</FP><HD>short</HD><X>not chosen, though long</X></R>"""
    assert texts(xml) == [("P", "load & force § 5"), ("P", "prefixed paragraph text"), ("P", "inside <b> cdata section"), ("P", "lower case name"), ("FP", "outer text inner text tail end"), ("P", "inner text")]
    assert texts("<R>no <b>chosen</b> element</R>") == [(None, "no chosen element")]
    assert texts("<R><P>short</P>   </R>") == [(None, "short")]
    assert texts("<R/>") == [] and texts("<P>the root itself</P>") == [("P", "the root itself")]


def test_encodings_and_parts(monkeypatch):
    assert texts('<?xml version="1.0" encoding="ISO-8859-1"?><R><P>caf\xe9 au lait</P></R>'.encode("latin-1")) == [("P", "café au lait")]
    assert texts("<R><P>汉字汉字汉字汉字</P></R>".encode("utf-16")) == [("P", "汉字汉字汉字汉字")]
    monkeypatch.setattr(markup, "PART", 3)
    assert texts("<R><P>load &amp; <E>for</E>ce 汉字</P></R>".encode()) == [("P", "load & for ce 汉字")]


@pytest.mark.parametrize("bad", ["", "plain", "<R>", "<R><P>one paragraph</P>", "<a/><b/>", "<R>&nbsp;</R>", "<R a=1/>", b'<?xml version="1.0" encoding="none-such"?><R/>'])
def test_what_is_not_well_formed_has_an_error_and_no_rows(bad):
    rows, error = markup.texts_of(bad, ("P",), 8)
    assert rows == [] and error


def test_rows_of_documents(spark):
    docs = [("a", "<R><P>first paragraph</P><P>second paragraph</P></R>"), ("b", "<R><P>broken paragraph"), ("c", None), ("d", "<R>only a text</R>"), ("e", "<R/>")]
    df = spark.createDataFrame([(*r, 1, "x") for r in docs], KIND + ", p_ord int, error string")
    assert sorted(map(tuple, markup.paragraphs(df).collect()), key=repr) == [("a", 0, "P", "first paragraph"), ("a", 1, "P", "second paragraph"), ("d", 0, None, "only a text")]
    assert [(r.doc_id, "no element" in r.error) for r in markup.errors(df).collect()] == [("b", True)]
    assert sorted(map(tuple, markup.texts(df).collect())) == [("a", "first paragraph second paragraph"), ("d", "only a text")]
    assert markup.paragraphs(df.limit(0)).count() == 0


def test_blocks_and_chunks_of_xml(spark):
    body = "S2. Scope &amp; purpose</HD><P>" + "The brake shall hold the load on a slope. " * 3 + "</P><HD>S3. Tests</HD><c:P>" + "Each test takes a minute at full load. " * 3
    df = spark.createDataFrame([("a", f'<R xmlns:c="urn:c"><HD>{body}</c:P></R>', "A"), ("b", "<R>S4. short text</R>", "B"), ("x", "<R>", "X")], KIND + ", code string")
    blocks = segment.markup_blocks(df, read=markup.paragraphs)
    assert sorted((r.doc_id, r.heading, r.text[:24]) for r in blocks.collect()) == [("a", "S2. Scope & purpose", "S2. Scope & purpose The "), ("a", "S3. Tests", "S3. Tests Each test take"), ("b", "XML text", "S4. short text")]
    chunks = segment.markup_chunks(df, read=markup.paragraphs, texts=markup.texts).orderBy("doc_id", "chunk_ord").collect()
    assert [(r.doc_id, r.heading) for r in chunks] == [("a", "S2. Scope & purpose"), ("a", "S3. Tests")]


def test_sections(spark):
    xml = """<R><SECTION N="a > b"><SECTNO>§ 571.<b>9</b>223</SECTNO><P>&lt;x&gt;</P></SECTION><SECTION><P>none</P></SECTION>
    <SECTION><SECTNO>§ 571.224</SECTNO><SECTION><SECTNO>7</SECTNO>é</SECTION> rest</SECTION><SECTION><X><SECTNO>5</SECTNO></X></SECTION></R>"""
    rows = [tuple(r)[1:] for r in markup.sections(spark.createDataFrame([("d", xml), ("e", "<SECTION>")], KIND)).orderBy("section_ord").collect()]
    assert [r[:2] for r in rows] == [(0, "571."), (1, ""), (2, "571.224"), (3, "7"), (4, "")]
    assert rows[0][2] == '<SECTION N="a > b"><SECTNO>§ 571.<b>9</b>223</SECTNO><P>&lt;x&gt;</P></SECTION>' and rows[3][2] == "<SECTION><SECTNO>7</SECTNO>é</SECTION>"
    twice = "<R><SECTION><SECTNO>§ 571.223</SECTNO><P>x</P></SECTION><SECTION><SECTNO>571.223</SECTNO></SECTION></R>"
    got = markup.section(spark.createDataFrame([("d", twice)], KIND), "571.223").collect()
    assert len(got) == 1 and "<P>x</P>" in got[0].text


def test_scan_goes_on_past_bad_sources(spark):
    entries = spark.createDataFrame([(k, f"c.d/{k}") for k in ("a.pdf", "b.pdf", "c.PDF", "a.xml", "b.XML", "c.xml", "d.xml", "a.txt", "none")], "doc_id string, path string")
    pages = spark.createDataFrame([("a.pdf", 1, " "), ("a.pdf", 2, "text"), ("b.pdf", 1, "\n"), ("b.pdf", 2, None)], "doc_id string, page int, text string")
    xml = spark.createDataFrame([("a.xml", "<R>text</R>"), ("b.XML", "<R>"), ("c.xml", "<R/>")], KIND)
    got = {r.doc_id: r.reason.split(":")[0] for r in documents.bad_sources(entries, pages, xml).collect()}
    assert got == {"b.pdf": "empty", "c.PDF": "missing", "b.XML": "malformed", "c.xml": "empty", "d.xml": "missing", "a.txt": "format", "none": "format"}
    files = spark.createDataFrame([("a.pdf", "x/a.pdf"), ("b.pdf", "x/b.pdf"), ("d.doc", "x/d.doc")], "doc_id string, path string")
    assert {tuple(r) for r in documents.refused(files, pages).collect()} == {("b.pdf", "empty"), ("d.doc", "format")}


def test_manifests_that_are_not_json_give_no_entries(spark, tmp_path):
    (tmp_path / "good.json").write_text('[{"code": "A", "path": "a.pdf"}, {"code": "B", "bytes": 5}]')
    (tmp_path / "bad.json").write_text('[{"code": "C"}, {"code": ')
    (tmp_path / "empty.json").write_text("")
    assert sorted(r.code for r in documents.read_manifest(spark, str(tmp_path)).collect()) == ["A", "B"]


def test_texts_are_cleaned_and_paragraphs_stripped(spark, tmp_path):
    from .test_sources import docx

    (tmp_path / "a.txt").write_text("  one  \n\n\t two\n")
    (tmp_path / "b.docx").write_bytes(docx("  x", "   "))
    got = {r.doc_id.rsplit("/", 1)[1]: r.text for r in documents.read_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "one\ntwo", "b.docx": "x\tend\nend"}

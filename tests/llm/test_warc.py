import base64
import gzip
import hashlib
import html
import html.parser
import random
import time
import zlib

import pytest

from creditmill.llm import warc

PAGE = (
    "<!DOCTYPE html><html lang='en'><head><title>A &amp; B</title><style>p{}</style></head><body><!-- no -->"
    "<script>var t=\"</p>\";</script><h1>Head</h1><p>One <b>two</b>&nbsp;three<br>four</p>"
    "<a href='/x?a=1&amp;b=2'>link</a><a class=c href=\"/y\">y</a> 1 < 2 &eacute;</body></html>"
)


def sha1(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def response(page, record="<urn:uuid:1>", url="http://e.org/"):
    message = warc.http_message(page)
    return warc.record("response", [("WARC-Record-ID", record), ("WARC-Target-URI", url), ("WARC-Date", "2024-05-06T07:08:09Z")], message), message


def test_plain_text():
    assert warc.plain_text(PAGE) == "Head\nOne two three\nfour\nlinky 1 < 2 é"
    assert warc.plain_text("") == "" and warc.plain_text("<p>") == "" and warc.plain_text("<!-- open") == ""
    assert warc.plain_text("a<script>b") == "a"
    assert len(warc.plain_text("<p>x</p>" * 20000).split("\n")) == 20000


def test_derivatives_keep_what_they_refer_to():
    data, message = response(PAGE)
    (_, meta_id, meta), (_, text_id, text) = warc.derive(data)
    body = message.partition(b"\r\n\r\n")[2]
    for record, own in ((meta, meta_id), (text, text_id)):
        version, headers, block = warc.split_record(record)
        assert version == "WARC/1.1" and headers["warc-record-id"] == own
        assert headers["warc-refers-to"] == "<urn:uuid:1>"
        assert headers["warc-refers-to-target-uri"] == headers["warc-target-uri"] == "http://e.org/"
        assert headers["warc-refers-to-date"] == "2024-05-06T07:08:09Z"
        assert headers["warc-source-payload-digest"] == sha1(body)
        assert headers["warc-payload-digest"] == headers["warc-block-digest"] == sha1(block)
        assert int(headers["content-length"]) == len(block)
    lines = warc.split_record(meta)[2].decode().splitlines()
    assert lines[:2] == ["source-status: HTTP/1.1 200 OK", f"source-block-digest: {sha1(message)}"]
    assert "source-header-content-type: text/html; charset=utf-8" in lines
    assert [x for x in lines if x.startswith("outlink")] == ["outlink: /x?a=1&b=2", "outlink: /y"]
    assert "title: A & B" in lines and "language: en" in lines
    assert warc.split_record(text)[2].decode() == warc.plain_text(PAGE)
    assert meta_id != text_id and warc.derive(data)[0][1] == meta_id


def test_other_and_broken_records():
    assert warc.derive(warc.record("request", [], b"GET / HTTP/1.1\r\n\r\n")) == []
    assert warc.derive(b"") == [] and warc.derive(b"junk") == []
    bare = warc.record("response", [], b"HTTP/1.1 204 No Content\r\n\r\n")
    assert [warc.split_record(r)[2] for _, _, r in warc.derive(bare)][1] == b""
    folded = b"WARC/1.0\r\nwarc-type: Response\r\nWARC-Record-ID:\r\n <urn:uuid:9>\r\n\r\nHTTP/1.1 200\r\nA: b\r\n\r\n<p>x"
    assert warc.split_record(warc.derive(folded)[1][2])[1]["warc-refers-to"] == "<urn:uuid:9>"
    split = warc.record("response", [("WARC-Target-URI", "http://x/\r\nWARC-Type: bad")], b"HTTP/1.1 200\r\n\r\n")
    assert warc.split_record(split)[1]["warc-target-uri"] == "http://x/ WARC-Type: bad"


def test_rows(spark):
    rows = [(1, "http://a/", PAGE, "x"), (1, "http://a/", PAGE, "x"), (2, None, None, "x"), (None, "", "", "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, record string")
    found = warc.derivatives(warc.responses(pages)).collect()
    assert len(found) == 8 and {r.warc_type for r in found} == {"metadata", "conversion"}
    for r in found:
        assert r.block_digest == sha1(bytes(r.record).partition(b"\r\n\r\n")[2])
    assert len({r.record_id for r in found if r.page_id == 1}) == 2
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0


def parse(data):
    """Records of a WARC file, read by their lengths."""
    at, out = 0, []
    while at < len(data):
        head = data.index(b"\r\n\r\n", at)
        size = int(data[at:head].lower().split(b"content-length: ")[1].split(b"\r\n")[0])
        end = head + 4 + size
        assert data[end : end + 4] == b"\r\n\r\n"
        out.append(data[at:end])
        at = end + 4
    return out


def test_files_hold_the_records_byte_for_byte(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://a/{i}", PAGE + "é\r\n\r\n" * i) for i in range(20)], "page_id bigint, url string, html string")
    records = warc.derivatives(warc.responses(pages))
    for compression, ending, opener in (("none", "*.txt", open), ("gzip", "*.gz", gzip.open)):
        path = tmp_path / compression
        warc.write_warc(records, str(path), compression=compression)
        found = []
        for file in path.glob(ending):
            with opener(file, "rb") as f:
                found += parse(f.read())
        assert sorted(found) == sorted(bytes(r.record) for r in records.collect())


def test_a_head_without_its_end_tag_ends_where_content_begins():
    text = warc.plain_text
    assert text("<html><head><title>x</title><body><p>text") == "text"
    assert text("<html><head><meta charset=utf-8><title>x</title><style>p{}</style><p>text") == "text"
    assert text("<head><title>x</title>bare text<p>more") == "bare text\nmore"
    assert text("<head><script>var a='<p>';</script><link rel=x></head><body>text") == "text"
    assert text("<p>a<noscript>b<p>c") == "ab\nc" and text("<p>a<noscript>b</noscript>c") == "a c"
    assert text("<header>a</header><p>b") == "a\nb"


def derived(headers, body):
    message = b"HTTP/1.1 200 OK\r\n" + headers + b"\r\n\r\n" + body
    (_, _, meta), (_, _, text) = warc.derive(warc.record("response", [("WARC-Record-ID", "<urn:uuid:1>")], message))
    return warc.split_record(meta)[2].decode().splitlines(), warc.split_record(text)[2].decode()


def test_repeated_headers_stay_in_order():
    lines, _ = derived(b"Set-Cookie: a=1\r\nVia: x\r\nset-cookie: b=2", b"<p>x")
    found = [x for x in lines if x.startswith("source-header")]
    assert found == ["source-header-set-cookie: a=1", "source-header-via: x", "source-header-set-cookie: b=2"]


def test_codings_and_charsets_are_undone():
    page = "<title>\u00e9</title><p>na\u00efve caf\u00e9"
    plain, zipped = page.encode(), gzip.compress(page.encode())
    chunks = b"".join(b"%x;n=1\r\n%s\r\n" % (len(zipped[i : i + 9]), zipped[i : i + 9]) for i in range(0, len(zipped), 9))
    want = warc.plain_text(page)
    for headers, body in (
        (b"Content-Encoding: gzip\r\nTransfer-Encoding: chunked", chunks + b"0\r\nTrailer: t\r\n\r\n"),
        (b"Content-Encoding: deflate", zlib.compress(plain)),
        (b"Content-Encoding: deflate", zlib.compress(plain)[2:-4]),
        (b"Content-Encoding: gzip\r\nTransfer-Encoding: chunked", plain),  # undone by the crawler
        (b"Content-Type: text/html; charset=ISO-8859-1", page.encode("latin-1")),
        (b'Content-Type: text/html; charset="utf-16"', page.encode("utf-16")),
        (b"Content-Type: text/html; charset=nonsense", plain),
    ):
        assert derived(headers, body)[1] == want
    assert derived(b"A: b", b"<meta charset='koi8-r'><p>" + "\u043c\u0438\u0440".encode("koi8-r"))[1] == "\u043c\u0438\u0440"


class Plain(html.parser.HTMLParser):
    """A plain version of text, title and links for well-formed pages."""

    BLOCKS = set("address article aside blockquote br dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.parts, self.links, self.name, self.skip, self.in_title = [], [], None, 0, False
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attributes):
        if tag in ("head", "script", "style"):
            self.skip += 1
        if tag == "title":
            self.in_title, self.name = True, ""
        if tag in self.BLOCKS:
            self.parts.append("\n")
        if tag == "a":
            self.links += [v for k, v in attributes if k == "href"]

    def handle_endtag(self, tag):
        if tag in ("head", "script", "style"):
            self.skip -= 1
            self.parts.append(" ")
        if tag == "title":
            self.in_title = False
        if tag in self.BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if self.in_title:
            self.name += data
        elif not self.skip:
            self.parts.append(data)

    def handle_comment(self, data):
        self.parts.append(" ")

    def text(self):
        lines = (" ".join(line.split()) for line in "".join(self.parts).split("\n"))
        return "\n".join(line for line in lines if line)


def test_random_pages_equal_a_plain_version():
    r = random.Random(3)

    def content(depth):
        out = []
        for _ in range(r.randint(1, 4)):
            kind = r.random()
            words = " ".join(r.choice(["one", "two", "&amp;", "caf&eacute;", "&lt;b&gt;", "&#65;"]) for _ in range(r.randint(1, 5)))
            if kind < 0.4 or depth == 0:
                out.append(words)
            elif kind < 0.7:
                tag = r.choice(["p", "div", "b", "li", "em", "td", "section", "span"])
                out.append(f"<{tag} class='c{r.randint(1, 9)}'>{content(depth - 1)}</{tag}>")
            elif kind < 0.8:
                out.append(f'<a href="/x{r.randint(1, 99)}?a=1&amp;b=2" rel=nofollow>{words}</a>')
            elif kind < 0.9:
                out.append(r.choice(["<script>var x = '<p>';</script>", "<style>p{}</style>", "<!-- note -->", "<br>", "<hr/>"]))
            else:
                out.append("\n  \t")
        return "".join(out)

    for _ in range(300):
        page = f"<!DOCTYPE html><html lang=en><head><title>T {r.randint(1, 99)} &amp; more</title><meta charset=utf-8></head><body>{content(3)}</body></html>"
        plain = Plain(page)
        assert warc.plain_text(page) == plain.text()
        data, message = response(page)
        (_, _, meta), (_, _, text) = warc.derive(data)
        lines = warc.split_record(meta)[2].decode().splitlines()
        assert [x.partition(": ")[2] for x in lines if x.startswith("outlink")] == plain.links
        assert f"title: {plain.name}" in lines and warc.split_record(text)[2].decode() == plain.text()


@pytest.mark.parametrize(
    "page",
    [
        "<title>" * 143_000,
        "<title" * 160_000,
        '<a href="' + " " * 1_000_000,
        "<a href='" + " \n" * 500_000 + "'>x</a>",
        "<a " * 330_000,
        "<head>" + "<title>" * 143_000,
        "<noscript>" * 100_000,
        "<!--" * 250_000,
        "<script>" * 125_000,
        "<" * 1_000_000,
        "&" * 1_000_000,
        "<html " * 160_000,
        "</title" + " " * 1_000_000,
        "<p>" + " " * 1_000_000 + "x",
    ],
)
def test_hostile_pages_of_a_megabyte_are_quick(page):
    begin = time.process_time()
    assert len(warc.derive(response(page)[0])) == 2
    assert time.process_time() - begin < 2


def test_many_small_members_are_quick():
    body = gzip.compress(b"x") * 40_000
    begin = time.process_time()
    assert warc.decoded(body, [("content-encoding", "gzip")]) == b"x" * 40_000
    assert time.process_time() - begin < 5


def test_files_are_read_back(spark, tmp_path):
    pages = spark.createDataFrame(
        [(i, f"http://a/{i}", PAGE + "\r\n" * (i % 5) + "WARC/1.1 no\r\n\r\n" * (i % 3)) for i in range(30)] + [(99, None, None)],
        "page_id bigint, url string, html string",
    )
    own = warc.responses(pages)
    records = own.select("record").unionByName(warc.derivatives(own).select("record"))
    warc.write_warc(records.repartition(3), str(tmp_path / "w"), compression="gzip")
    found = warc.read_warc(spark, str(tmp_path / "w"))
    assert sorted(bytes(r.record) for r in found.collect()) == sorted(bytes(r.record) for r in records.collect())
    assert found.select("file").distinct().count() == 3
    # Derivatives of records read from files are those of the records.
    again = warc.derivatives(found, "file").count()
    assert again == 2 * pages.count()


def test_one_member_a_record_and_cut_files(spark, tmp_path):
    made = [warc.record("response", [("WARC-Record-ID", f"<urn:{i}>")], b"HTTP/1.1 200\r\n\r\n" + b"y" * i) for i in range(5)]
    path = tmp_path / "m.warc.gz"
    path.write_bytes(b"".join(gzip.compress(r + b"\r\n\r\n") for r in made[:4]) + gzip.compress(b"junk\r\n\r\n" + made[4][:-2]))
    assert sorted(bytes(r.record) for r in warc.read_warc(spark, str(path)).collect()) == sorted(made[:4])

"""URL filters and web archives."""

import base64
import hashlib
import io
import zipfile

import pytest

from sqltrail.llm import queries, url_filter, warc

SF = "/root/testdata/sf0.001"


def brute_rule(url, rules, default):
    url = url or ""
    host, path = "", ""
    if "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        rest = rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fitting = [(len(h), len(p or ""), v == "allow", h + (p or ""), v) for h, p, v in rules if h is not None and (host == h or host.endswith("." + h)) and path.startswith(p or "")]
    return (host, path, *(max(fitting)[3:] if fitting else (None, default)))


RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"),
    ("a.b.c", "", "block"), ("b.c", "/x", "allow"), ("b.c", "/x/y", "block"), ("b.c", "/x", "block"), (None, "/", "block"), ("d", None, "block"), ("\u0001odd", "/", "block"),
]
URLS = [
    None, "", "no scheme", "http://", "http://com", "http://com/", "HTTP://WWW.Example.COM/en/a?x#y", "http://example.com/en", "http://example.com/en/", "x://ycom/",
    "https://a.example.com/en/?", "https://aexample.com/en/", "http://net/es/1", "http://m.net/fr/#t", "http://m.net/de/", "http://z.a.b.c", "http://b.c/x/y/z", "http://b.c/x1",
    "http://q.d?e", "http://h:80/en/", "http://u@com/", "http://.com/", "http://com./", "http://\u0001odd/", "http://x\u0001odd/", "http://é.com/é", "a\nb://com/\n", "http://com/en://net/es/",
] + ["http://www.example.com/en/hot"] * 40


@pytest.mark.parametrize("parts", [1, 7])
def test_url_filter(spark, parts):
    table = spark.createDataFrame([(i, u, 1, "x") for i, u in enumerate(URLS)], "page_id long, url string, host int, rule string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = {r.page_id: tuple(r)[1:] for r in url_filter.judge(table, rules, default="block", parts=parts).collect()}
    assert got == {i: brute_rule(u, RULES, "block") for i, u in enumerate(URLS)}
    assert url_filter.judge(table.limit(0), rules).count() == 0
    none = url_filter.judge(table, rules.limit(0)).collect()
    assert len(none) == len(URLS) and {r.verdict for r in none} == {"allow"} and {r.rule for r in none} == {None}


def test_url_filter_plan_is_native(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    plan = url_filter.judge(spark.read.parquet(f"{SF}/pages.parquet"), rules)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def expected_records(pages):
    firsts = {}
    for i, _, h in pages:
        if i is not None:
            firsts[h or ""] = min(i, firsts.get(h or "", i))
    out = []
    for i, _, h in pages:
        raw = (h or "").encode()
        first = firsts.get(h or "")
        kind = ("response", None) if first is None or i == first else ("revisit", first)
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), *kind))
    return sorted(out, key=repr)


def test_warc_cases(spark):
    pages = [(1, "http://a/", "x"), (2, "http://b/\r\nX: y", "x"), (3, None, None), (4, "", ""), (5, "u", "é" * 100_000), (5, "u", "é" * 100_000), (6, "u", "\r\n\r\nWARC/1.1\r\n"),
             (None, "n", "x"), (None, "n", "alone"), (-7, "m", "neg"), (8, "m", "neg")] + [(100 + i, "h", "hot") for i in range(50)]
    table = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, payload int")
    assert sorted((tuple(r) for r in warc.report(spark, table).collect()), key=repr) == expected_records(pages)
    assert warc.report(spark, table.limit(0)).count() == 0
    small = warc.round_trip(spark, table, min_bytes=2).where("payload_digest = (SELECT max(payload_digest) FROM VALUES ('') t(payload_digest)) OR payload_bytes < 2").collect()
    assert small and {r.record_type for r in small} == {"response"}
    texts = {r.page_id: bytes(r.payload).decode() for r in warc.round_trip(spark, table).where("record_type = 'response'").collect() if r.page_id}
    assert texts[5] == "é" * 100_000 and texts[6] == "\r\n\r\nWARC/1.1\r\n"


def test_warc_query(spark):
    pages = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted((tuple(r) for r in queries.queries()["op7_warc"](spark, SF).collect()), key=repr) == expected_records(pages)


def archive(folder, zip64=False, index=True, gz=True, monkeypatch=None):
    """An archive made with the standard library; its limits are lowered to make it write ZIP64 fields."""
    records = [warc.record(i, f"http://x/{i}", b"p" * i * 50, "D" * 32, None) for i in range(40)]
    if gz:
        import gzip

        records = [gzip.compress(r) for r in records]
    name = "data.warc.gz" if gz else "data.warc"
    lines, at = [], 0
    for r in records:
        lines.append(f'x 2024 {{"offset": {at}, "length": "{len(r)}", "filename": "{name}"}}\n')
        at += len(r)
    if zip64:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.comment = b"a comment PK\x05\x06 with a false end"
        z.writestr("other/file.txt", "x" * 300)
        z.writestr(f"archive/{name}", b"".join(records))
        if index:
            z.writestr("indexes/index.cdx", "".join(lines))
    path = folder / "a.wacz"
    path.write_bytes(out.getvalue())
    return str(path)


@pytest.mark.parametrize("gz", [True, False])
@pytest.mark.parametrize("index", [True, False])
@pytest.mark.parametrize("zip64", [True, False])
def test_foreign_archives(tmp_path, monkeypatch, zip64, index, gz):
    path = archive(tmp_path, zip64, index, gz, monkeypatch)
    found = list(warc.ranges(path, most=3_000))
    assert len(found) > 3 if index else len(found) == 1
    blocks = [b for r in found for _, b in warc.records(*r)]
    assert [len(b.partition(b"\r\n\r\n")[2]) for b in blocks] == [i * 50 for i in range(40)]


def test_broken_archives(tmp_path):
    (tmp_path / "b.wacz").write_bytes(b"no archive")
    with pytest.raises(ValueError, match="b.wacz"):
        list(warc.ranges(str(tmp_path / "b.wacz")))
    with zipfile.ZipFile(tmp_path / "c.wacz", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("archive/data.warc", b"x" * 1000)
    with pytest.raises(ValueError, match="not stored"):
        list(warc.ranges(str(tmp_path / "c.wacz")))

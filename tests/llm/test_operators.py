"""Each operator against its plain version, on awkward rows."""

import io
import itertools
import math
import random
import struct
import zipfile
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from sungrid.llm import attention_lm, common, decontaminate, exact_dedup, langid, license_scan, mixing, simhash, toxicity, url_filter, warc_zip
from sungrid.llm.components import components

#: Names that operators use inside.
CLASHES = ["digest", "uid", "t", "i", "r", "s", "fp", "w", "c", "k", "n", "x", "kept", "block", "score", "n_words", "page", "m", "component_id", "root", "spans", "held_out", "value"]


def frame(spark, rows, schema="doc_id long, text string", clash=True):
    df = spark.createDataFrame(rows, schema).repartition(3)
    return df.select("*", *[F.lit("other").alias(c) for c in CLASHES if c not in df.columns]) if clash else df


def taken(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=lambda r: tuple((x is not None, x) for x in r))


def rng_text(rng, n, vocab):
    return " ".join(rng.choice(vocab) for _ in range(n))


VOCAB = "the of and to in ÉTÉ straße niño idiot über kilo lima mike alpha bravo charlie delta echo foxtrot".split()


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    rows = [(i, rng_text(rng, rng.randint(1, 60), VOCAB)) for i in range(60)]
    rows += [(100 + i, rows[i % 7][1]) for i in range(40)]  # copies
    rows += [(200 + i, rows[i][1].replace("kilo", "LIMA", 1)) for i in range(10)]
    rows += [(300, None), (301, ""), (302, " \t\n"), (303, None), (304, "x"), (305, rng_text(rng, 20_000, VOCAB)), (306, "A\x1cb c d"), (307, "\U0001F600 İİ")]
    return rows


# --- exact dedup


def test_exact_groups(spark, texts):
    got = taken(exact_dedup.exact_groups(frame(spark, texts)), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got == brute.exact(texts)


def test_exact_groups_with_colliding_digests(spark, texts):
    weak = lambda t: F.length(t) % 3
    got = taken(exact_dedup.exact_groups(frame(spark, texts), digest=weak), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got == brute.exact(texts)


def test_exact_ties_null_ids_and_empty_tables(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, "a"), (None, "c"), (None, "c"), (2, None), (3, "")]
    df = frame(spark, rows)
    got = taken(exact_dedup.exact_groups(df), "doc_id", "keep_id", "group_size", "kept")
    assert got == [(None, None, 2, False), (None, None, 2, True), (None, 1, 3, False), (1, 1, 1, True), (1, 1, 3, False), (1, 1, 3, True), (2, 3, 2, False), (3, 3, 2, True)]
    left = exact_dedup.keep_exact(df)
    assert left.columns == df.columns
    assert taken(left, "doc_id", "text") == [(None, "c"), (1, "a"), (1, "b"), (3, "")]
    assert exact_dedup.exact_groups(df.limit(0)).count() == 0 and exact_dedup.keep_exact(df.limit(0)).count() == 0


# --- components and SimHash


def test_components_of_chains_hubs_and_cycles(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 60)] + [(2001, 2002), (2002, 2003), (2003, 2001), (5, 5), (None, 1), (7, None)]
    edges += [(rng.randrange(3000, 3100), rng.randrange(3000, 3100)) for _ in range(70)] + edges[:9]
    sets = brute.Sets()
    for a, b in edges:
        if None not in (a, b) and a != b:
            sets.join(a, b)
    want = sorted((n, sets.find(n)) for n in sets.up if sets.find(n) != n)
    got = taken(components(spark.createDataFrame(edges, "a long, b long"), "a", "b"), "node", "root")
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_near_duplicates(spark, texts):
    got = taken(simhash.near_duplicates(frame(spark, texts)), "doc_id", "fingerprint", "component_id")
    assert got == brute.near(texts)
    assert simhash.near_duplicates(frame(spark, texts).limit(0)).count() == 0


def test_near_duplicates_of_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (None, "zz")]
    got = taken(simhash.near_duplicates(frame(spark, rows)), "doc_id", "component_id")
    assert got == [(None, None), (None, 4), (4, 4), (4, 4)]


@pytest.mark.parametrize("spread", [1, 3, 6])
def test_links_keep_every_component(spark, spread):
    """Dense clusters around centres, chains of close fingerprints and strangers."""
    rng = np.random.default_rng(spread)
    fps = set()
    for c in rng.integers(0, 2**64, 5, dtype=np.uint64):
        for _ in range(80):
            f = int(c)
            for b in rng.integers(0, 64, rng.integers(0, spread + 1)):
                f ^= 1 << int(b)
            fps.add(f)
    f = int(rng.integers(0, 2**63))
    for b in range(0, 60, 3):
        f ^= 0b111 << b
        fps.add(f)
    fps |= {0, 1, 2**63, 2**64 - 1}
    signed = [(f - 2**64 if f >> 63 else f,) for f in fps]
    links = simhash.links(spark.createDataFrame(signed, "fp long")).collect()
    sets = brute.Sets()
    for r in links:
        assert ((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 4
        sets.join(r.a, r.b)
    want = brute.hamming_components(fps)
    groups = {}
    for (s,) in signed:
        groups.setdefault(sets.find(s), set()).add(want[s & (2**64 - 1)])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_keep_one_keeps_columns(spark, texts):
    df = frame(spark, texts)
    left = simhash.keep_one(df)
    assert left.columns == df.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted({c for _, _, c in brute.near(texts)})


def test_keep_one_of_null_and_repeated_ids(spark):
    """Each component keeps exactly one row."""
    a, b, c, d = "a b c d e", "one two three four five six", "kilo lima mike november", "zz"
    rows = [(None, a), (4, a), (4, a), (None, d), (7, b), (3, b), (7, c), (None, "qq"), (None, "qq"), (9, None), (9, "")]
    left = simhash.keep_one(frame(spark, rows))
    assert taken(left, "doc_id", "text") in [sorted([(None, d), (None, "qq"), (3, b), (4, a), (7, c), (9, t)], key=lambda r: tuple((x is not None, x) for x in r)) for t in (None, "")]
    assert simhash.keep_one(frame(spark, rows).limit(0)).count() == 0


# --- decontamination


@pytest.fixture(scope="module")
def items():
    rng = random.Random(9)
    made = [(i, rng_text(rng, rng.randint(14, 30), VOCAB)) for i in range(12)]
    return [*made, (20, made[0][1]), (21, made[1][1] + " zulu " + made[2][1]), (22, "yankee zulu"), (23, None), (24, ""), (25, "!!"), (26, rng_text(rng, 13, VOCAB)), (27, rng_text(rng, 12, VOCAB)), (28, "ÜBER")]


def planted(texts, items):
    rng = random.Random(4)
    rows = list(texts)
    for k in range(60):
        ws = brute.alnum(items[rng.randrange(12)][1])
        lo = rng.randrange(0, 4)
        part = ws[lo:lo + rng.choice([11, 12, 13, 14, 20])]
        rows.append((1000 + k, rng_text(rng, rng.randrange(0, 400), VOCAB) + " " + ", ".join(part).upper() + ".\n" + rng_text(rng, 5, VOCAB)))
    return rows + [(2000, "Yankee--ZULU and über")]


@pytest.mark.parametrize("block", [200_000, 20])
def test_windows_of_items(spark, texts, items, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    rows = planted(texts, items)
    got = decontaminate.match_items(frame(spark, rows), frame(spark, items, "item_id long, text string"))
    assert taken(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == brute.decontaminated(rows, items)


def test_decontaminate_keeps_clean_rows_as_they_were(spark, texts, items):
    rows = [*planted(texts, items[:12]), (None, items[0][1]), (None, "clean")]
    df, bench = frame(spark, rows), frame(spark, items[:12], "item_id long, text string")
    left = decontaminate.decontaminate(df, bench)
    bad = {r[0] for r in brute.decontaminated([(i, t) for i, t in rows if i is not None], items[:12]) if r[5]}
    assert left.columns == df.columns and bad
    assert taken(left, "doc_id", "text") == taken(df.where(~F.coalesce(F.col("doc_id").isin(list(bad)), F.lit(False)) & ~(F.col("doc_id").isNull() & (F.col("text") != "clean"))), "doc_id", "text")
    assert decontaminate.decontaminate(df, bench.limit(0)).count() == len(rows)
    assert decontaminate.decontaminate(df.limit(0), bench).count() == 0


def test_cut_spans():
    text = "One, two. THREE four".encode()
    assert decontaminate.cut_spans(text, [(1, 3)]) == b"One,  four"
    assert decontaminate.cut_spans(text, []) == text


@pytest.mark.parametrize("block", [200_000, 20])
def test_remove_spans(spark, items, block, monkeypatch):
    """Equal to cutting the hit words one by one; contaminated texts go, others stay as they were."""
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    rng = random.Random(8)
    ws = [brute.alnum(items[i][1]) for i in range(4)]
    filler = lambda n: [f"f{rng.randrange(50)}" for _ in range(n)]
    long = {10 + i: (filler(300), ws[i][:14], filler(200)) for i in range(4)}
    rows = [(i, " ".join(a + b + c)) for i, (a, b, c) in long.items()]
    rows += [(20, " ".join(ws[0])), (21, " ".join(filler(30)) + "\n"), (22, None), (23, ""), (None, " ".join(filler(400) + ["yankee", "ZULU"])), (21, "again")]
    df, bench = frame(spark, rows), frame(spark, [*items[:12], (22, "yankee zulu")], "item_id long, text string")
    left = decontaminate.remove_spans(df, bench)
    want = [(i, " ".join([*a, ""]) + " " + " ".join(c)) for i, (a, _, c) in long.items()] + [r for r in rows if r[0] not in (*long, 20)]
    assert left.columns == df.columns
    order = lambda rs: sorted(rs, key=lambda r: tuple((x is not None, x) for x in r))
    assert taken(left, "doc_id", "text") == order(want)
    assert taken(decontaminate.remove_spans(df, bench, longest=14), "doc_id", "text") == order(r for r in rows if r[0] != 20)
    short = taken(decontaminate.remove_spans(df, bench, longest=1), "doc_id", "text")
    assert short[[i for i, r in enumerate(short) if r[0] is None][0]][1] == " ".join(rows[-2][1].split()[:-2]) + " "
    assert decontaminate.remove_spans(df.limit(0), bench).count() == 0 and decontaminate.remove_spans(df, bench.limit(0)).count() == len(rows)


# --- WARC in ZIP


def test_warc_round_trip(spark, tmp_path):
    rng = random.Random(2)
    bodies = [None, "", "<p>é</p>", "x" * 300_000] + [rng_text(rng, 50, VOCAB) for _ in range(30)]
    rows = [(i, f"http://a.example/{i}?q=1 \r\nb%0D" if i % 5 else None, bodies[i % len(bodies)]) for i in range(120)]
    path = f"{tmp_path}/zips"
    warc_zip.write_archives(frame(spark, rows, "page_id long, url string, html string"), path, archive_bytes=4_000)
    got = warc_zip.read_archives(spark, path)
    ids = got.select(F.col("page").cast("long").alias("p"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long"))
    assert taken(ids, *ids.columns) == brute.warc([(i, h) for i, _, h in rows])
    back = {int(r.page): r for r in got.collect()}
    assert {i: r.url for i, r in back.items()} == {i: u for i, u, _ in rows}
    assert all(bytes(r.payload) == (rows[i][2] or "").encode() for i, r in back.items() if r.record_type == "response")
    files = list((tmp_path / "zips").glob("part-*"))
    assert len(files) > 3
    for f in files:  # valid to other readers, stored throughout
        z = zipfile.ZipFile(f)
        assert z.testzip() is None and {x.compress_type for x in z.infolist()} == {zipfile.ZIP_STORED}
    raw = zipfile.ZipFile(files[0]).read(warc_zip.RECORDS)
    first = [r for r in got.where(F.col("offset").isNotNull()).collect()][0]
    assert first.length > 0 and raw[:2] == b"\x1f\x8b"


def test_warc_nulls_repeats_and_no_rows(spark, tmp_path):
    rows = [(None, None, "a"), (5, "u", "a"), (5, "u", "a"), (None, None, "only"), (None, None, "only"), (7, None, None)]
    df = frame(spark, rows, "page_id long, url string, html string")
    warc_zip.write_archives(df, f"{tmp_path}/z")
    got = taken(warc_zip.read_archives(spark, f"{tmp_path}/z"), "page", "record_type", "refers_to")
    assert got == [(None, "response", None), (None, "response", None), (None, "revisit", "5"), ("5", "response", None), ("5", "response", None), ("7", "response", None)]
    warc_zip.write_archives(df.limit(0), f"{tmp_path}/none")
    assert warc_zip.read_archives(spark, f"{tmp_path}/none").count() == 0


def test_short_payloads_are_responses(spark, tmp_path):
    rows = [(1, None, "ab"), (2, None, "ab"), (3, None, "abc"), (4, None, "abc")]
    warc_zip.write_archives(frame(spark, rows, "page_id long, url string, html string"), f"{tmp_path}/z", min_bytes=3)
    assert taken(warc_zip.read_archives(spark, f"{tmp_path}/z", payloads=False), "page", "refers_to") == [("1", None), ("2", None), ("3", None), ("4", "3")]


def test_zip64_directory_is_parsed():
    """A ZIP64 end record, and an entry whose sizes and offset stand in its extra field."""
    data, name = b"stored bytes", b"archive/data.warc.gz"
    local = struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45, 0, 0, 0, 33, zlib.crc32(data), 0xFFFFFFFF, 0xFFFFFFFF, len(name), 20) + name + struct.pack("<HHQQ", 1, 16, len(data), len(data))
    lead = b"something before "
    extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), len(lead))
    entry = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45, 0, 0, 0, 33, zlib.crc32(data), 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    at = len(lead) + len(local) + len(data)
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(entry), at)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, at + len(entry), 1)
    end = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0xFFFF, 0xFFFF, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 3) + b"end"
    whole = lead + local + data + entry + end64 + locator + end
    found = warc_zip.members(lambda o, n: whole[o:o + n], len(whole))
    o, n = found[name.decode()]
    assert whole[o:o + n] == data
    assert zipfile.ZipFile(io.BytesIO(whole)).read(name.decode()) == data
    with pytest.raises(ValueError):
        warc_zip.members(lambda o, n: b"no zip"[o:o + n], 6)


# --- URL rules


def test_urls_and_aliases(spark):
    html = lambda h: f'<html><head><LINK href="{h}" REL="canonical"><title>x</title>'
    rows = [
        (1, "http://X.Example.NET/en/a?q#f", None), (2, "http://example.net", ""), (3, "http://notexample.net/en/", "x"), (4, None, html("http://a.net/")), (5, "no scheme net/", html("/b")),
        (6, "http://plain.io/p", html("http://bad.net/x")),  # blocked alias
        (7, "http://plain.io/q#top", html("p")),  # alias of an alias, by a relative link
        (8, "http://www.example.net/en/ok", html("http://bad.net/x")),  # its own allow stays
        (9, "http://free.io/", '<meta http-equiv="refresh" content="0; url=http://example.net/en/z">'), (10, "http://free.io/other?a=1&b=2", html("//free.io/?x")),
        (11, "http://free.io/?x", html("/")), (12, "https://lone.io/", "<link rel=canonical href='#a'>"), (13, "http://hop.io/1", None), (14, "https://example.com/de/x", None), (15, "http://s.org/fr/", None),
        (16, "HTTP://HOP.io/1", None),
    ]
    redirects = spark.createDataFrame([("http://hop.io/1", "http://hop.io/2"), ("http://hop.io/2", "http://sub.example.com/de/"), (None, "x")], "src string, dst string")
    got = {r.page_id: r for r in url_filter.judge(frame(spark, rows, "page_id long, url string, html string"), redirects=redirects).collect()}
    assert len(got) == len(rows)
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("x.example.net", "/en/a", "example.net/en/", "allow")
    assert (got[2].host, got[2].path, got[2].rule, got[2].verdict) == ("example.net", "", None, "allow")
    assert (got[3].rule, got[3].verdict) == ("net/", "block")
    assert (got[4].host, got[4].path, got[4].rule, got[4].verdict) == ("", "", None, "allow") and got[5].host == ""
    # 6, 7 and 8 share bad.net: 8 is allowed by a rule, and an allow goes before a block
    assert [got[i].verdict for i in (6, 7, 8)] == ["allow", "allow", "allow"] and got[6].rule is None
    assert [got[i].verdict for i in (9, 10, 11, 12)] == ["allow"] * 4
    assert got[13].verdict == "block" and got[13].rule is None and got[16].verdict == "block"
    assert got[14].rule == "example.com/de/" and got[15].rule == "org/fr/"
    alone = {r.page_id: r.verdict for r in url_filter.judge(frame(spark, [r for r in rows if r[0] != 8], "page_id long, url string, html string")).collect()}
    assert alone[6] == alone[7] == "block" and alone[13] == "allow"
    assert url_filter.judge(frame(spark, rows, "page_id long, url string, html string").limit(0)).count() == 0


def test_url_sql_follows_links(spark, tmp_path):
    import duckdb

    html = lambda h: f'<link rel="canonical" href="{h}">'
    rows = [(1, "http://a.io/x/y", html("../net")), (2, "http://a.io/x/../net", html("http://b.net/#q")), (3, "http://c.io", html("?q")), (4, "http://c.io?q", html("http://v.org/fr/")), (5, None, None), (6, "mailto:x", html("/a"))]
    df = frame(spark, rows, "page_id long, url string, html string", clash=False)
    pages = df.toPandas()  # noqa: F841
    want = sorted(map(tuple, duckdb.sql(url_filter.SQL).df().astype(object).where(lambda d: d.notna(), None).values.tolist()))
    assert taken(url_filter.judge(df), "page_id", "host", "path", "rule", "verdict") == want
    assert [r[4] for r in want[:4]] == ["block", "block", "allow", "allow"]


def test_equal_urls_meet(spark):
    import duckdb

    link = lambda rel, h: f'<link {rel} href="{h}">'
    one = 'rel="canonical"'
    rows = [(1, "http://a.io/x/y", link(one, "../net")), (2, "http://a.io/net", link(one, "http://bad.net/")),  # plainly written
            (3, "http://c.io", link(one, "http://b.org/fr/x")), (4, "http://d.io/", link(one, "HTTP://C.io/")),
            (5, "http://e.io/p", link('rel="alternate canonical"', "http://bad.net/")), (6, "http://f.io/p", link("rel='Canonical next'", "http://bad.net/z/./../")),
            (7, "http://g.io/p", link('rel="non-canonical"', "http://bad.net/")), (8, "http://h.io/a/b/", link("rel=canonical", "../../../..")), (9, "http://h.io", link(one, "http://bad.net")),
            (10, "http://i.io/a/./b/../c?x=/../", link(one, "/a/c?x=/../")), (11, "http://i.io/a/c?x=/../#f", link(one, "http://bad.net/q"))]
    df = frame(spark, rows, "page_id long, url string, html string", clash=False)
    got = {r.page_id: r.verdict for r in url_filter.judge(df).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "block", 6: "block", 7: "allow", 8: "block", 9: "block", 10: "block", 11: "block"}
    pages = df.toPandas()  # noqa: F841
    want = sorted(map(tuple, duckdb.sql(url_filter.SQL).df().astype(object).where(lambda d: d.notna(), None).values.tolist()))
    assert taken(url_filter.judge(df), "page_id", "host", "path", "rule", "verdict") == want


# --- license scan


def test_license_scan(spark, texts):
    rng = random.Random(8)
    rows = list(texts)
    for k, (_, t) in enumerate(license_scan.TEMPLATES * 3):
        ws = t.split()
        if k % 3 == 1:
            del ws[rng.randrange(len(ws))]
        if k % 3 == 2:
            rng.shuffle(ws)
        rows.append((3000 + k, rng_text(rng, 9, VOCAB) + "\n" + " ".join(ws) + " " + rng_text(rng, 3, VOCAB) + "\r\nthe end"))
    rows += [(4000, "MIT\nlicense, mit LICENSE! Apache-license general public license General Public mit  license"), (4001, "mit"), (4002, "license license mit"), (4003, "Licensed under CC BY-NC 4.0.")]
    got = taken(license_scan.scan(frame(spark, rows)), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    assert got == brute.licenses(rows, license_scan.PHRASES, license_scan.TEMPLATES, license_scan.CONTAINMENT)
    assert dict((r[0], r[6]) for r in got)[4003] == "cc-by-nc"
    assert license_scan.scan(frame(spark, rows).limit(0)).count() == 0


def test_license_notices_at_any_wrapping(spark):
    rows, want = [], {}
    for k, (label, t) in enumerate(license_scan.TEMPLATES):
        ws = t.split()
        for j, per in enumerate((1, 3, 7, 1000)):
            lines = [" * " + " ".join(ws[i:i + per]) for i in range(0, len(ws), per)]
            rows.append((10 * k + j, "kilo lima\n" + "\r\n".join(lines) + "\nmike alpha"))
            want[10 * k + j] = {label, "gpl"} if label == "lgpl" else {label}  # by a phrase in it
    scattered = "all of us walked home and then the many rights we once had were kept and reserved for later"
    rows += [(1000, scattered), (1001, "Licensed under CC\nBY-SA 4.0. Licensed under CC BY-NC\n4.0."), (1002, "Licensed under CC BY\n4.0. Licensed under CC BY-SA 4.0.")]
    want |= {1000: set(), 1001: {"cc-by-nc", "cc-by-sa"}, 1002: {"cc-by", "cc-by-sa"}}
    got = {r.doc_id: r for r in license_scan.scan(frame(spark, rows)).collect()}
    assert {i: set(filter(None, r.labels.split(","))) for i, r in got.items()} == want
    assert all(r.score == (0 if i == 1000 else 1) for i, r in got.items())


# --- language model


def plain_log_prob(ids, v, p, end):
    """The score of a text token by token, without windows or batches."""
    seq = [v.slot[end], *v.slot[ids[:-1]]]
    emb, total = p["emb"], 0.0
    for t, target in enumerate(ids):
        lo = max(0, t // attention_lm.HALF * attention_lm.HALF - attention_lm.HALF)
        here, near = emb[seq[t]], emb[seq[lo:t + 1]]
        i, shift = t % attention_lm.HALF, attention_lm.HALF - (t // attention_lm.HALF * attention_lm.HALF - lo)
        far = p["far"][i, shift:shift + len(near)]
        e = np.exp(near @ p["k"] @ (here @ p["q"]) / math.sqrt(attention_lm.DIM) + far)
        z = (here + e @ (near @ p["v"]) / e.sum()) @ p["out"]
        row, column = divmod(v.group[target], attention_lm.FINE)  # a softmax over rows, one over the columns of the row
        bias = p["bias"][attention_lm.PARTS:].reshape(attention_lm.PARTS, -1)[row]
        for z, at in ((z[:attention_lm.PARTS] + p["bias"][:attention_lm.PARTS], row), (z[attention_lm.PARTS:] + bias, column)):
            total += z[at] - np.log(np.exp(z).sum())
        total += v.within[target]
    return total


@pytest.fixture(scope="module")
def small_lm():
    rng = np.random.default_rng(0)
    counts = np.zeros(3000)
    counts[:1500] = rng.integers(1, 500, 1500)
    v = attention_lm.vocabulary(counts, rng.random((3000, 2 * attention_lm.NEAR)))
    p = attention_lm.start(v, counts)
    p["far"] = rng.normal(0, 0.3, p["far"].shape).astype(np.float32)
    return v, p


def test_every_token_is_scored_once(small_lm):
    v, p = small_lm
    rng = np.random.default_rng(1)
    ids = [rng.integers(0, 3000, n).astype(np.uint16) for n in (1, 2, 15, 16, 17, 32, 33, 100)]
    win, targets, owner = attention_lm.windows(ids, v, 2999)
    for i, x in enumerate(ids):
        assert [t for t in targets[owner == i].ravel() if t >= 0] == x.tolist()
    lp = attention_lm.Scorer(p).log_classes(win, v.group[targets]) + v.within[targets]
    got = np.bincount(owner, np.where(targets >= 0, lp, 0).sum(axis=1))
    assert np.allclose(got, [plain_log_prob(x, v, p, 2999) for x in ids], rtol=1e-4, atol=1e-3)


def test_probabilities_sum_to_one(small_lm):
    v, p = small_lm
    assert np.isclose(np.bincount(v.group, np.exp(v.within)), 1).all()
    win, targets, _ = attention_lm.windows([np.arange(40, dtype=np.uint16)], v, 2999)
    each = [np.exp(attention_lm.Scorer(p).log_classes(win, np.full(targets.shape, c))) for c in range(attention_lm.CLASSES)]
    assert np.allclose(sum(each)[targets >= 0], 1, atol=1e-4)


def test_gradients(small_lm):
    v, p = small_lm
    p = {k: x.astype(np.float64) for k, x in p.items()}
    win, targets, _ = attention_lm.windows([np.arange(21, dtype=np.uint16), np.array([5], np.uint16)], v, 2999)
    group, real = np.maximum(v.group[targets], 0), targets >= 0
    _, g = attention_lm.loss_and_gradients(p, win, group, real)
    rng = np.random.default_rng(2)
    for k in p:
        rows = np.unique(win[win < attention_lm.SLOTS]) if k == "emb" else np.arange(p[k].shape[0])
        for _ in range(6):
            at = (rng.choice(rows), *[rng.integers(n) for n in p[k].shape[1:]])
            old, h = p[k][at], 1e-5
            p[k][at] = old + h
            up = attention_lm.loss_and_gradients(p, win, group, real)[0]
            p[k][at] = old - h
            down = attention_lm.loss_and_gradients(p, win, group, real)[0]
            p[k][at] = old
            assert np.isclose(g[k][at], (up - down) / (2 * h), atol=1e-6), k


def test_gradients_into_given_arrays(small_lm):
    """A step of training allocates no gradients and takes no logarithms for a loss; steps are Adam's."""
    v, p = small_lm
    win, targets, _ = attention_lm.windows([np.arange(40, dtype=np.uint16), np.array([5], np.uint16)], v, 2999)
    group, real = v.group[targets], targets >= 0
    loss, want = attention_lm.loss_and_gradients(p, win, group, real)
    w = np.concatenate([x.ravel() for x in p.values()]).astype(np.float64)
    adam, m, s, plain = attention_lm.Adam(w, 0.01), 0, 0, w.copy()
    into = {k: np.full_like(x, 7) for k, x in p.items()}
    none, got = attention_lm.loss_and_gradients(p, win, group, real, into)
    assert math.isnan(none) and math.isfinite(loss) and got is into
    assert all(np.allclose(got[k], want[k], atol=1e-6) for k in want)
    g = np.concatenate([got[k].ravel() for k in p]).astype(np.float64)
    for step in (1, 2, 3):
        adam.gradient[:] = g
        adam.update()
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        plain -= 0.01 / (1 - 0.9 ** step) * m / (np.sqrt(s / (1 - 0.99 ** step)) + 1e-8)
    assert np.allclose(w, plain, atol=1e-7)


def test_words_of_a_batch_are_split_and_encoded_at_once():
    texts = [bytes([i, i]) + b"Ab" + bytes([j]) + b"Z\xff\xc3" for i in range(256) for j in range(0, 256, 3)] + [b"", b" \t ", "\u00a0Ä b\u2028c".encode()]
    for at in (0, 3):  # a slice of a longer batch too
        lists = attention_lm.split_texts(pa.array(texts, pa.binary()).slice(at))
        words = attention_lm._bytes(lists.flatten()).to_pylist()
        assert [[w for w in words[a:b] if w] for a, b in itertools.pairwise(lists.offsets.to_pylist())] == [common.tokens(t) for t in texts[at:]]
    ranks = attention_lm.read_ranks(attention_lm.VOCABULARY)
    made, calls = attention_lm.Subwords(ranks), []
    alone = tiktoken.Encoding("alone", pat_str="(?s:.+)", mergeable_ranks=ranks, special_tokens={})
    encode = made.core.encode_ordinary
    made.core.encode_ordinary = lambda text: calls.append(text) or encode(text)
    for some in (sorted(set(words)), [b""], [b"the", b""], [b"the"]):
        ids, first, long = made.each(some)
        want = [alone.encode_ordinary(" " + w.decode("utf-8", "replace")) if w else [max(ranks.values()) + 1] for w in some]
        assert [ids[a:a + n].tolist() for a, n in zip(first, long, strict=True)] == want
    assert len(calls) == 4


@pytest.mark.parametrize("head", [100_000, 3])
def test_base_scores_of_texts(spark, texts, tmp_path, monkeypatch, head):
    monkeypatch.setattr(attention_lm, "HEAD", head)
    frame(spark, texts).write.parquet(f"{tmp_path}/docs")
    got = {r.doc_id: r for r in attention_lm.score_texts(spark.read.parquet(f"{tmp_path}/docs")).collect()}
    want = brute.unigrams(texts)
    assert got.keys() == want.keys()
    for i, w in want.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert math.isclose(r.base_score, w[4], rel_tol=1e-9) and math.isfinite(r.score) and r.score < 0
    # what the model learns helps: better than the untrained one would do per subword
    some = [r for r in got.values() if r.n_tokens > 20]
    assert sum(r.score for r in some) > sum(-3.5 * r.n_tokens for r in some)


def test_every_training_text_trains_the_weights(spark, tmp_path, monkeypatch):
    """With the settings as they are: each text has a subword of its own, whose embedding moves."""
    kept, train, vocabulary = {}, attention_lm.train, attention_lm.vocabulary

    def spied_train(*args, **names):
        kept["before"] = next(x for x in args if isinstance(x, dict))["emb"].copy()
        kept["after"] = (p := train(*args, **names))["emb"]
        return p

    monkeypatch.setattr(attention_lm, "train", spied_train)
    monkeypatch.setattr(attention_lm, "vocabulary", lambda *args: kept.setdefault("v", vocabulary(*args)))
    ranks = attention_lm.read_ranks(attention_lm.VOCABULARY)
    own = [w for w in sorted(ranks) if w[:1] == b" " and len(w) > 4 and w[1:].isalpha() and w.islower()][:60]
    rows = [(i, w.decode()[1:] + " the end") for i, w in enumerate(own)]
    frame(spark, rows).write.parquet(f"{tmp_path}/d")
    got = {r.doc_id: r for r in attention_lm.score_texts(spark.read.parquet(f"{tmp_path}/d")).collect()}
    moved = (kept["before"] != kept["after"]).any(axis=1)
    learns = [i for i, _ in rows if not got[i].held_out]
    assert len(learns) > 40 and all(moved[kept["v"].slot[ranks[own[i]]]] for i in learns)


def test_language_model_without_rows(spark, tmp_path):
    df = frame(spark, [(None, None), (None, "a b"), (1, "a b"), (1, "a b")])
    df.write.parquet(f"{tmp_path}/d")
    got = attention_lm.score_texts(spark.read.parquet(f"{tmp_path}/d")).collect()
    assert sorted(r.n_tokens for r in got) == [1, 3, 3, 3]
    assert attention_lm.score_texts(spark.read.parquet(f"{tmp_path}/d").limit(0)).count() == 0


# --- mixing


def test_mixture_meets_budgets(spark):
    rng = random.Random(5)
    rows = [(i, rng_text(rng, rng.randint(0, 30), VOCAB), "big" if i % 3 else f"s{i % 4}" if i % 2 else None) for i in range(3000)]
    rows += [(9000, None, "none"), (9001, "", "none"), (1, rows[1][1], rows[1][2])]
    df = frame(spark, rows, "doc_id long, text string, source string")
    got = mixing.mix(df, columns=["doc_id", "r"], block_rows=100).collect()
    tokens, had = {}, {}
    for i, t, s in rows:
        tokens[s] = tokens.get(s, 0) + len(brute.spaced(t))
    for r in got:
        had[r.mix_source] = had.get(r.mix_source, 0) + r.mix_tokens
    total = sum(tokens.values())
    real = {s: t / total for s, t in tokens.items() if t}
    lo, hi = 0.0, 1.0
    weights = lambda a: {s: p**a / sum(q**a for q in real.values()) for s, p in real.items()}
    entropy = lambda w: -sum(x * math.log(x) for x in w.values())
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if entropy(weights(mid)) <= mixing.ENTROPY_SHARE * math.log(len(real)) else (mid, hi)
    lo2, hi2 = 0.0, 1.0
    for _ in range(60):
        mid = (lo2 + hi2) / 2
        lo2, hi2 = (lo2, mid) if max(w / real[s] for s, w in weights(mid).items()) <= mixing.MAX_EPOCHS else (mid, hi2)
    a = max(hi, hi2 if max(1 / p for p in real.values()) / len(real) > mixing.MAX_EPOCHS else 0)
    want = {s: math.floor(w * total + 0.5) for s, w in weights(a).items()}
    assert had.keys() == want.keys() and all(want[s] - 31 <= had[s] <= want[s] for s in want)
    assert {r.r for r in got} == {"other"} and max(r.mix_epoch for r in got) >= 1 and all(0 <= r.mix_at < 1 for r in got)
    # each epoch has a row once, but for the repeated one
    per = {}
    for r in got:
        per[r.doc_id, r.mix_epoch] = per.get((r.doc_id, r.mix_epoch), 0) + 1
    assert all(n == 1 or k[0] == 1 for k, n in per.items())
    again = mixing.mix(df.repartition(7), columns=["doc_id", "r"], block_rows=100)
    assert taken(again, *again.columns) == sorted((tuple(r) for r in got), key=lambda r: tuple((x is not None, x) for x in r))


def test_mixture_limits_repeats(spark):
    rows = [(i, "a b c d", "big") for i in range(960)] + [(1000 + i, "a b c d", "tiny") for i in range(10)]
    got = mixing.mix(frame(spark, rows, "doc_id long, text string, source string"), columns=["doc_id"], max_epochs=2.5).collect()
    tiny = sum(r.mix_tokens for r in got if r.mix_source == "tiny")
    assert 96 <= tiny <= 100 and max(r.mix_epoch for r in got) == 2
    assert mixing.mix(frame(spark, rows, "doc_id long, text string, source string").limit(0)).count() == 0
    assert mixing.mix(frame(spark, [(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")).count() == 0


def test_mixing_keeps_columns_that_have_the_names_of_results(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b", "s", 7, 8, 9), (2, "c", "t", 7, 8, 9)], "doc_id long, text string, source string, mix_at int, MIX_ORDER int, mix_at_in int")
    out = mixing.mix(df)
    assert out.columns == ["doc_id", "text", "source", "mix_at_in_in", "MIX_ORDER_in", "mix_at_in", "mix_source", "mix_tokens", "mix_epoch", "mix_at", "mix_order"]
    assert {tuple(r)[3:6] for r in out.collect()} == {(7, 8, 9)}


def test_mixing_uses_no_python(spark):
    df = frame(spark, [(1, "a b", "s"), (2, "c", None)], "doc_id long, text string, source string")
    plan = mixing.mix(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- language


def test_language_of_held_out_texts(spark):
    rng = random.Random(6)
    vocab = {"en": "the of and that with this from which".split(), "de": "der die und das nicht über größe".split(), "fr": "le la les été être garçon où".split()}
    rows = [(i, rng_text(rng, rng.randint(3, 40), vocab[y]), y) for i, y in enumerate(rng.choice(list(vocab)) for _ in range(400))]
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "123 ...", None), (1003, "the and that", None), (1004, "der die und " * 60_000, None), (None, "les été", None)]
    df = frame(spark, rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.predict(df, langid.fit(df)).collect()}
    held = [(got[i].lang_pred, y) for i, _, y in rows if i is not None and i < 400 and got[i].held_out]
    assert len(held) > 50 and sum(a == b for a, b in held) / len(held) > 0.98
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002))
    assert (got[1003].lang_pred, got[1004].lang_pred, got[None].lang_pred) == ("en", "de", "fr")
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(400)) and all(0 <= r.score <= 1 for r in got.values())
    blank = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.predict(df, langid.fit(blank)).collect()} == {"und"}
    assert langid.predict(df.limit(0), None).count() == 0 and langid.fit(df.limit(0)) is None


def plain_shares(text):
    """Shares of the buckets of all n-grams of a text, one by one."""
    c, found = [ord(x) for x in f" {text.lower()} "], {}
    for i in range(len(c)):
        for n in (1, 2, 3):
            if i + n <= len(c):
                h = 0
                for x in c[i:i + n]:
                    h = (h ^ x) * 0x9E3779B97F4A7C15 % 2**64
                    h ^= h >> 29
                found[h % langid.BUCKETS] = found.get(h % langid.BUCKETS, 0) + 1
    return {b: k / sum(found.values()) for b, k in found.items()}


@pytest.mark.parametrize("piece", [1, 2, 7, 500, 1 << 18])
def test_ngrams_reach_over_pieces(piece, monkeypatch):
    monkeypatch.setattr(langid, "PIECE", piece)
    rng = random.Random(2)
    for text in ("", "a", "ab", "Ünï \U0001F600", rng_text(rng, 150, VOCAB), rng_text(rng, 151, VOCAB) + "İ"):
        if len(text) + 2 < 500 and piece < 500:
            continue  # short texts are never cut
        at, x = langid.features(text)
        assert dict(zip(at.tolist(), x.tolist(), strict=True)) == pytest.approx(plain_shares(text))


def test_language_against_plain_scores(spark):
    """Predictions equal to counting, weighting and scoring one text at a time."""
    rng = random.Random(16)
    vocab = {"en": "the of and that".split(), "fr": "le la les été".split()}
    rows = [(i, rng_text(rng, rng.randint(1, 30), vocab[y]), y) for i, y in enumerate(rng.choice(list(vocab)) for _ in range(120))] + [(500, None, "en"), (501, "1 2", "fr")]
    df = frame(spark, rows, "doc_id long, text string, lang string")
    learns = [t for i, t, y in rows if t is not None and zlib.crc32(str(i).encode()) % 4 != 2]
    seen, total = langid.document_frequency(df.where("text is not null and crc32(cast(doc_id as string)) % 4 != 2"))
    want = np.zeros(langid.BUCKETS, int)
    for t in learns:
        want[list(plain_shares(t))] += 1
    assert total == len(learns) and (seen == want).all()
    model = langid.fit(df)
    assert np.allclose(model.idf, np.log((1 + total) / (1 + want)) + 1)
    for r in langid.predict(df, model).collect():
        text = dict((i, t) for i, t, _ in rows)[r.doc_id]
        if text is None or not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        shares = plain_shares(text)
        norm = math.sqrt(sum((x * model.idf[b]) ** 2 for b, x in shares.items()))
        z = [(sum(x * model.weights[b, k] for b, x in shares.items()) / norm + model.bias[k]) / model.temperature for k in range(len(model.langs))]
        p = [math.exp(x - max(z)) for x in z]
        assert r.lang_pred == model.langs[p.index(max(p))] and math.isclose(r.score, max(p) / sum(p), rel_tol=1e-6)


def test_ftrl_is_sparse():
    made = langid.Ftrl(50, 2)
    rng = np.random.default_rng(3)
    for _ in range(300):
        y = int(rng.integers(2))
        made.learn(np.array([y, 2 + int(rng.integers(40))]), np.array([1.0, 1e-7]), y)
    w = made.weights(slice(None))
    assert w[0, 0] > w[0, 1] and w[1, 1] > w[1, 0] and (w[45:50] == 0).all() and (w[2:42] == 0).mean() > 0.9


# --- toxicity


def toxic_rows(n=600):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(n):
        ws = [rng.choice(VOCAB[:7] + VOCAB[9:]) for _ in range(rng.randint(5, 40))]
        bad = rng.random() < 0.2
        if bad:
            ws.insert(rng.randrange(len(ws)), rng.choice(["Idiot", "MORON", "schurk" + rng.choice(["ä", "en", "isch", "heit", "ung", "tum"])]))
        rows.append((i, " ".join(ws)))
        if i % 10 < 9:
            labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_of_held_out_texts(spark):
    rows, labels = toxic_rows()
    extra = [(9000, None), (9001, ""), (None, "you are an idiot"), (9002, "the and " * 50_000 + "idiot"), (9003, "Schurkerei")]
    docs = frame(spark, rows + extra)
    marks = frame(spark, [*labels, (None, 1), (9001, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert {"=idiot", "=moron"} <= model.lexicon.keys() and any(k.startswith("^schur") for k in model.lexicon)
    held = [(got[i].predicted, y) for i, y in labels if got[i].held_out]
    assert len(held) > 60 and all(a == b for a, b in held)
    assert got[9000].predicted == got[9001].predicted == 0 and got[9000].score == got[9001].score
    assert got[None].predicted == 1 and got[9002].predicted == 1 and got[9003].predicted == 1
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got.values())
    left = toxicity.drop_toxic(docs, marks)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i, r in got.items() if not r.predicted}
    none = toxicity.fit(docs, marks.limit(0))
    assert {r.predicted for r in toxicity.score(docs, none).collect()} == {0} and toxicity.score(docs.limit(0), model).count() == 0


def test_grammar_marks_clauses():
    m = toxicity.Matcher({"=idiot": 2.0, "^schurk": 1.0})
    kinds = lambda t: {toxicity.PATTERNS[k]: float(x) for k, x in enumerate(m.clauses(t.encode())) if x}
    assert kinds("What an idiot.") == {"insult": 2.0}
    assert kinds("You are an IDIOT!") == {"insult at target": 2.0}
    assert kinds("He is not an idiot") == {"negated insult": 2.0}
    assert kinds("He is not never an idiot") == {"insult": 2.0}
    assert kinds("They. not one of the many idiot") == {"insult": 2.0}  # out of the negation's reach, the target in another clause
    assert kinds("She said: idiot. Such an idiot") == {"insult": 2.0, "reported insult": 2.0}
    # What stands behind a match counts too.
    assert kinds("idiot, you are one") == kinds("You idiot, do not touch that") == {"insult at target": 2.0}
    assert kinds("He is an idiot, she said") == kinds("said you idiot") == kinds("the word idiot") == {"reported insult": 2.0}
    assert kinds("an idiot you are not") == {"negated insult": 2.0} and kinds("an idiot, you are not") == {"insult at target": 2.0}
    # A threat is more than a verb, and weighs as the middle entry of the lexicon.
    assert kinds("kill") == kinds("burn the wood") == kinds("You, never hurt") == kinds("calm words") == {}
    assert kinds("I will kill you, schurkerei") == {"threat at target": 2.0, "insult at target": 1.0}
    assert kinds("I will burn it") == kinds("mataré") == {"threat": 2.0} and kinds("I will not hurt you") == {"negated threat": 2.0}
    assert kinds("kill you") == kinds("je vais te tuer") == {"threat at target": 2.0} and kinds("I will kill you, he said") == {"reported threat": 2.0}
    assert m.clauses(None).sum() == m.clauses(b"").sum() == 0 and toxicity.Matcher({}).clauses(b"kill you")[5] == 1.0


def test_grammar_against_plain_reading():
    lexicon = {"=idiot": 2.0, "^schurk": 1.0, "=moron": 4.0}
    m, rng = toxicity.Matcher(lexicon), random.Random(21)
    groups = [["idiot", "Schurkerei", "moron"], toxicity.THREAT, toxicity.PROMISE, toxicity.INTENT, toxicity.TARGET, toxicity.OBJECT, toxicity.NEGATION,
              toxicity.REPORTED, toxicity.MENTION, [",", ":"], [".", "!", "\n"], ["wood", "ünd", "9"], ["wood"]]
    seen = np.zeros(len(toxicity.PATTERNS))
    for _ in range(4000):
        text = " ".join(rng.choice(rng.choice(groups)) for _ in range(rng.randint(1, 14)))
        want = brute.clause_kinds(text, {"idiot": 2.0, "schurkerei": 1.0, "moron": 4.0}, toxicity)
        got = m.clauses(text.encode())
        assert got.tolist() == want, text
        seen += got > 0
    assert (seen > 50).all()


# --- pipeline


def test_pipeline_against_plain_stages(spark, items, tmp_path):
    import corpus_pipeline as cp

    rows, labels = toxic_rows(300)
    rng = random.Random(12)
    rows += [(400 + i, rows[i][1]) for i in range(30)] + [(500 + i, rows[i][1] + " end") for i in range(20)]
    rows += [(600 + i, rng_text(rng, 30, VOCAB[:7]) + " " + items[i][1]) for i in range(10)] + [(700, None), (701, "")]
    spark.createDataFrame([(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items[:12], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    text = dict(rows)
    bad = {i for i, t in rows if any(w in ("idiot", "moron") or w.startswith("schurk") for w in brute.alnum(t))}
    left = {i for i in text if i not in bad}
    want = [left]
    left = {r[0] for r in brute.exact([(i, text[i]) for i in left]) if r[3]}
    want.append(left)
    left = {r[2] for r in brute.near([(i, text[i]) for i in left])}
    want.append(left)
    left = {r[0] for r in brute.decontaminated([(i, text[i]) for i in left], items[:12]) if not r[5]}
    want.append(left)
    assert len({len(w) for w in want}) == 4
    for (name, stage), ids in zip(cp.STAGES[:-1], want, strict=True):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert {r.doc_id for r in docs.select("doc_id").collect()} == ids, name
    last = cp.STAGES[-1][1](spark, docs, str(tmp_path))
    assert set(columns) <= set(last.columns)
    whole = cp.run(spark, str(tmp_path))
    assert taken(whole, *whole.columns) == taken(last, *last.columns)

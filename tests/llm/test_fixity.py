"""Merkle audits find exactly the records that differ."""

import hashlib
import re

from pyspark.sql import functions as F

from ledgerloom.llm import fixity


def pages(spark):
    rows = [(i, f"http://h{i % 7}.org/{i}", "<p>" + "x" * (i * 37 % 3000) + "</p>") for i in range(300)]
    rows += [(None, None, None), (5, "a\r\nb", ""), (5, "a\r\nb", ""), (6, "big", "y" * 300_000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)


def plain(a, b):
    left, right = ({r["place"]: bytes(r["record"]) for r in x.collect()} for x in (a, b))
    return {
        (p, "missing" if p not in right else "added" if p not in left else "changed")
        for p in left.keys() | right.keys()
        if left.get(p) != right.get(p)
    }


def test_records_are_whole_and_in_order(spark):
    archive = fixity.archive(pages(spark)).orderBy("place").collect()
    assert len(archive) == 304 and len({r["place"] for r in archive}) == 304
    end = {}
    for r in archive:
        assert r["offset"] == end.get(r["volume"], 0)
        end[r["volume"]] = r["offset"] + len(r["record"])
        head, body = bytes(r["record"]).split(b"\r\n\r\n", 1)
        length = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.startswith(b"Content-Length"))
        assert len(body) == length + 4 and body.endswith(b"\r\n\r\n")


def test_audit_equals_comparison(spark):
    archive = fixity.archive(pages(spark))
    for one_in in (1, 20):
        other = fixity.decayed(archive, one_in)
        got = {(r["place"], r["fault"]) for r in fixity.audit(archive, other).collect()}
        assert got == plain(archive, other)
        back = {(r["place"], r["fault"]) for r in fixity.audit(other, archive).collect()}
        assert back == plain(other, archive)


def test_equal_and_empty_replicas(spark):
    archive = fixity.archive(pages(spark))
    assert fixity.audit(archive, archive).count() == 0
    none = archive.filter("false")
    assert fixity.audit(none, none).count() == 0
    assert fixity.audit(archive, none).filter("fault = 'missing'").count() == 304


def test_repeated_records_and_nulls(spark):
    archive = fixity.archive(pages(spark))
    assert fixity.audit(archive, archive.union(archive)).count() == 0
    first = archive.agg(F.min("place")).first()[0]
    lost = archive.withColumn("record", F.when(F.col("place") != first, F.col("record")))
    (row,) = fixity.audit(archive, lost).collect()
    assert (row["place"], row["fault"], row["other_hash"]) == (first, "changed", None)


def test_hashes_are_of_the_record(spark):
    archive = fixity.archive(pages(spark))
    want = {r["place"]: hashlib.sha256(bytes(r["record"])).hexdigest() for r in archive.collect()}
    assert {r["place"]: r["hash"] for r in fixity.leaves(archive).collect()} == want


def test_only_differing_branches_are_read(spark):
    archive = fixity.archive(pages(spark))
    hit = archive.agg(F.max("place")).first()[0]
    other = archive.filter(F.col("place") != hit)
    sides = [fixity.leaves(x) for x in (archive, other)]
    a, b = (fixity.tree(x, hit) for x in sides)
    for level in range(len(a)):
        assert fixity.differing(a[level], b[level]).count() == 1


def test_records_follow_the_format(spark):
    seen = {}
    for r in fixity.archive(pages(spark)).collect():
        head, _ = bytes(r["record"]).split(b"\r\n\r\n", 1)
        version, *fields = head.decode("ascii").split("\r\n")
        named = dict(field.split(": ", 1) for field in fields)
        assert version == "WARC/1.0" and len(named) == len(fields)
        assert named["WARC-Type"] == "resource" and named["Content-Type"].startswith("text/html")
        assert re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z", named["WARC-Date"])
        assert re.fullmatch(r"<urn:uuid:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}>", named["WARC-Record-ID"])
        assert re.fullmatch(r"[A-Za-z][A-Za-z0-9+.-]*:[^\s<>\"{}|\\^`]*", named["WARC-Target-URI"])
        seen[r["page_id"]] = named["WARC-Record-ID"]
    assert len(set(seen.values())) == len(seen)


def test_places_do_not_follow_the_split(spark):
    rows = pages(spark)
    found = []
    for dealt in (rows.coalesce(1), rows.repartition(7), rows.repartition(3, "url")):
        archive = fixity.archive(dealt)
        found.append(sorted((r["place"], bytes(r["record"])) for r in archive.collect()))
    assert found[0] == found[1] == found[2]

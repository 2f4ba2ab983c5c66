import hashlib
import random

import pytest
from pyspark.sql import functions as F

from nodeglass.llm import fixity

SCHEMA = "page_id long, url string, html string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def pages(keys, **changes):
    return [(k, f"http://h/{k}", changes.get(f"p{k}", f"<p>{k}</p>")) for k in keys]


def located(spark, one, two):
    one, two = fixity.manifest(frame(spark, one)), fixity.manifest(frame(spark, two))
    return sorted(((r["status"], r["key"], r["copies"]) for r in fixity.locate(one, two).collect()), key=str)


def moved(spark, one, two):
    one, two = fixity.manifest(frame(spark, one)), fixity.manifest(frame(spark, two))
    return sorted(tuple(r) for r in fixity.moved(one, two).collect())


def record(url, body):
    return (f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: {url}\r\nContent-Type: text/html\r\n"
            f"Content-Length: {len(body.encode())}\r\n\r\n{body}\r\n\r\n").encode()


def test_manifest(spark):
    keys = [*range(-3, 40), 4095, 4096, 5000]
    out = fixity.manifest(frame(spark, pages(keys))).orderBy("key").collect()
    assert [r["key"] for r in out] == keys
    at = {}
    for r in out:
        whole = record(f"http://h/{r['key']}", f"<p>{r['key']}</p>")
        assert r["archive"] == r["key"] // 4096 and r["copies"] == 1
        assert (r["offset"], r["length"], r["digest"]) == (at.get(r["archive"], 0), len(whole), hashlib.sha256(whole).hexdigest())
        at[r["archive"]] = r["offset"] + r["length"]


def test_intact_copies_have_one_root(spark):
    rows = pages(range(70))
    one, two = fixity.manifest(frame(spark, rows)), fixity.manifest(frame(spark, rows).repartition(7))
    (a,), (b,) = fixity.trees(one, two)
    assert a.count() == 1 and a.select("node", "digest").first() == b.select("node", "digest").first()
    assert fixity.audit(one, two).count() == 0


def test_only_differing_branches_are_opened(spark):
    keys = range(0, 60_000, 7)
    one, two = fixity.manifest(frame(spark, pages(keys))), fixity.manifest(frame(spark, pages(keys, p7007="x", p56000="y")))
    rounds = fixity.trees(one, two)
    assert [r.count() for r in rounds[0]] == [15, 1]
    top = rounds[0][1].select("node", F.struct("digest", "children").alias("x")).join(
        rounds[1][1].select("node", F.struct("digest", "children").alias("y")), "node")
    archives = fixity._opened(fixity._opened(fixity._opened(top))).select("node")
    assert sorted(r[0] for r in archives.collect()) == [7007 >> 12, 56000 >> 12]
    assert sorted(r[0] for r in fixity.audit(one, two).collect()) == [7007, 56000]


def test_damage_of_any_length_is_located(spark):
    one = pages(range(300))
    assert located(spark, one, pages(range(300), p13="xx", p40="", p299="y" * 5000)) == [("damaged", k, 1) for k in (13, 299, 40)]


def test_lost_and_added_records_mid_archive(spark):
    one = pages(range(0, 600, 2))
    lost = [r for r in one if r[0] != 80]
    assert located(spark, one, lost) == [("missing", 80, 1)] and located(spark, lost, one) == [("unexpected", 80, 1)]
    added = one + pages([81]) + [(100, "http://h/again", "<p>100</p>")]
    assert located(spark, one, added) == [("unexpected", 100, 1), ("unexpected", 81, 1)]
    assert located(spark, pages(range(3)), pages(range(9))) == [("unexpected", k, 1) for k in range(3, 9)]


def test_moved_records_are_told_by_ranges(spark):
    one = pages(range(100))
    two = pages(range(100), p40="<p>4</p>")
    assert moved(spark, one, two) == [(0, -1, 41, 99, 59)]  # one letter less
    assert moved(spark, one, one) == []


def test_random_faults(spark):
    rng = random.Random(1)
    one = pages(sorted(rng.sample(range(-5000, 20_000), 2000)))
    two, want = [], []
    for k, url, html in one:
        kind = rng.random()
        if kind < 0.01:
            want.append(("missing", k, 1))
        elif kind < 0.02:
            two.append((k, url, html[:2]))
            want.append(("damaged", k, 1))
        elif kind < 0.03:
            two += [(k, url, html)] * 3
            want.append(("unexpected", k, 2))
        else:
            two.append((k, url, html))
    assert located(spark, one, two) == sorted(want, key=str)


def test_odd_rows(spark):
    rows = [(1, None, None), (1, None, None), (2, "u", ""), (None, "é", "ü"), (None, "a", "b"), (3, "u", "x" * 200_000)]
    df = spark.createDataFrame([(*r, 7, "d") for r in rows], f"{SCHEMA}, archive int, digest string")
    one = fixity.manifest(df)
    assert one.count() == 5 and one.agg(F.sum("copies")).first()[0] == 6
    assert fixity.locate(one, fixity.manifest(df.repartition(4))).count() == 0
    assert located(spark, rows, rows[1:]) == [("missing", 1, 1)]
    assert located(spark, rows, [r for r in rows if r[1] != "a"]) == [("missing", None, 1)]
    empty = fixity.manifest(df.where("false"))
    assert fixity.locate(empty, empty).count() == 0 and fixity.moved(empty, one).count() == 0
    assert [r["status"] for r in fixity.locate(one, empty).collect()] == ["missing"] * 5
    assert [r["status"] for r in fixity.locate(empty, one).collect()] == ["unexpected"] * 5


def test_many_records_of_one_key(spark):
    one = [(9, f"u{i}", "x") for i in range(3000)] + pages([1, 20])
    assert located(spark, one, one[:2000] + one[2001:]) == [("missing", 9, 1)]

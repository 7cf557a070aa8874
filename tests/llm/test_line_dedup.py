"""Line dedup against brute force, with nulls, ties, repeated rows, clashing names, empty tables."""

import hashlib
import re

import pytest

from leadflow.llm.line_dedup import dedup_lines, line_dedup_digest

SCHEMA = "doc_id long, text string, lang string, h1 string, pos int, bitmap string, row string"
WS = re.compile(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$")


def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), WS.sub("", line))


def brute(rows, min_chars=10):
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == i]
        stays = [i is None or len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == i for x in lines]
        words = {w: sum(ok << j for j, ok in enumerate(stays[64 * w:64 * w + 64])) for w in range((len(lines) + 63) // 64)}
        bitmap = ",".join(f"{w}:{bits:016x}" for w, bits in words.items() if not all(stays[64 * w:64 * w + 64]))
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest(), bitmap))
    return sorted(out, key=repr)


ROWS = [
    (3, "A shared line here\nonly in three, long"), (1, "  a SHARED line here\t\nshort\nshort"), (2, None), (4, ""),
    (5, "short\n\x0bA shared LINE here\x0c\nÉcole des langues\nÉcole des langues"), (6, "école des langues"),
    (None, "A shared line here"), (7, "Own line stays here\nOwn line stays here"), (3, "A shared line here\nonly in three, long"),
    (8, "\n\n"), (9, "\n".join(f"filler line number {i}" for i in range(5000)) + "\na shared line here"),
    (10, "\n".join(f"filler line number {i}" for i in range(4990, 5010))), (13, "\n".join(f"filler line number {i}" for i in range(64))),
    *((100 + n, "\n".join(["x"] * (n - 1) + ["filler line number 7"])) for n in (1, 2, 62, 63, 64, 65, 127, 128, 129)),
    (14, "\n".join(["x"] * 63 + ["filler line number 3"] + ["y"] * 65 + ["filler line number 4"])), (11, "1234567890"), (12, "1234567890 "), (12, "123456789"),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", 1, "b", "r") for i, t in rows], SCHEMA).repartition(3)


def test_matches_brute_force(spark):
    got = sorted((tuple(r) for r in line_dedup_digest(frame(spark, ROWS)).collect()), key=repr)
    assert got == brute(ROWS)


def test_hot_line_and_many_documents(spark):
    rows = [(i, f"the very common line\nown line of document {i}" + ("\nsecond common line" if i % 3 else "")) for i in range(2000)]
    got = sorted((tuple(r) for r in line_dedup_digest(frame(spark, rows)).collect()), key=repr)
    assert got == brute(rows)


def test_documents_keep_their_columns(spark):
    out = dedup_lines(frame(spark, ROWS))
    assert out.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    texts = {(r.doc_id, r.text) for r in out.collect()}
    assert (2, None) in texts and (5, "short\nÉcole des langues\nÉcole des langues") in texts and (12, "") in texts
    assert out.count() == len(ROWS)


def test_first_line_rule_and_unknown_rule(spark):
    out = {r.doc_id: r.text for r in dedup_lines(frame(spark, [(7, "Own line stays here\nOwn line stays here")]),
                                                 keep="first_line").collect()}
    assert out == {7: "Own line stays here"}
    with pytest.raises(ValueError):
        dedup_lines(frame(spark, []), keep="other")


def test_empty_table(spark):
    assert line_dedup_digest(frame(spark, [])).collect() == []
    assert dedup_lines(frame(spark, [])).collect() == []

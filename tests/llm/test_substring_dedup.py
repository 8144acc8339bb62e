"""op3 against brute force over all windows, and against longest-previous-factor arrays."""

import hashlib
import random
from collections import Counter

import pytest

from sextant.llm import substring_dedup

SCHEMA = "doc_id long, text string, kept string"


def brute(rows, least):
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[i : i + least] for i in range(len(b) - least + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = [False] * (len(b) + 1)
        for i in range(len(b) - least + 1):
            if seen[b[i : i + least]] > 1:
                gone[i : i + least] = [True] * least
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((d, len(b), len(b) - len(kept), sum(g and not gone[i - 1] if i else g for i, g in enumerate(gone[:-1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def made(seed, n=70):
    r = random.Random(seed)
    say = lambda k: "".join(r.choices("abcdefgh é", k=k))
    shared = [say(k) for k in (150, 199, 200, 260, 700, 1500)]
    rows = []
    for i in range(n):
        t = "".join(r.choice([say(r.randint(0, 400)), r.choice(shared), r.choice(shared)[r.randint(0, 60) :], rows[-1][1] if rows and len(rows[-1][1]) < 4000 else ""]) for _ in range(r.randint(1, 4)))
        if t and r.random() < 0.4:
            at = r.randrange(len(t))
            t = t[:at] + r.choice(["", "#", "##"]) + t[at + 1 :]
        rows.append((r.randrange(1000), t))
    return rows + [(5, None), (6, ""), (None, say(300)), (None, shared[3]), (8, "x" * 900), (8, "x" * 199), (9, "xy" * 150), rows[3], (rows[4][0], rows[4][1] + "!")]


@pytest.mark.parametrize(("seed", "least", "chunk"), [(1, 200, 1 << 20), (2, 200, 700), (3, 50, 300)])
def test_brute(spark, monkeypatch, seed, least, chunk):
    monkeypatch.setattr(substring_dedup, "CHUNK", chunk)
    substring_dedup._tables.cache_clear()
    rows = made(seed)
    df = spark.createDataFrame([(*x, "z") for x in rows], SCHEMA).repartition(3)
    out = substring_dedup.remove_repeats(df, least)
    got = out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    substring_dedup._tables.cache_clear()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, least)
    if least == 200 and chunk > 1000:
        assert sorted((tuple(r) for r in substring_dedup.digest(df).collect()), key=str) == brute(rows, least)


def test_long_text_is_cut_rightly():
    r = random.Random(4)
    text = bytes(r.choices(b"abcdefghijklmnop", k=2_300_000))
    starts = [(w.at + s[w.part], w.n) for w, _, s in substring_dedup._runs([text], 200, 40)]
    assert sum(int(n.sum()) for _, n in starts) == len(text) - 199


def test_keep_first(spark):
    r = random.Random(6)
    text = "".join(r.choices("abc", k=60)) + "".join(r.choices("abcdefghij", k=900))
    text = text + text[100:500] + "#" + text[300:800]
    lpf = substring_dedup.longest_previous_factor(text.encode())
    want = [False] * len(text)
    for i, m in enumerate(lpf):
        if m >= 200:
            want[i : i + 200] = [True] * 200
    df = spark.createDataFrame([(1, text, ""), (2, text[:450], ""), (3, text[:450], "")], SCHEMA)
    got = {x.doc_id: x for x in substring_dedup.remove_repeats(df, keep_first=True).collect()}
    assert bytes(got[1].kept).decode() == "".join(c for c, w in zip(text, want) if not w)
    assert got[2].n_removed == got[3].n_removed == 450


def test_lpf():
    for t in (b"", b"a", b"aaaa", b"abaababaabaab", b"mississippi"):
        brute_lpf = [max([0, *(next((m for m in range(len(t) - i, 0, -1) if t[j : j + m] == t[i : i + m]), 0) for j in range(i))]) for i in range(len(t))]
        assert substring_dedup.longest_previous_factor(t) == brute_lpf


def test_empty(spark):
    assert substring_dedup.digest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_clashing_names_and_null_ids(spark):
    r = random.Random(9)
    a, b, c = ("".join(r.choices("abcdefghij", k=300)) for _ in range(3))
    rows = [(None, a), (None, a), (None, b + a[:250]), (None, c), (4, b), (4, c[:100])]
    df = spark.createDataFrame([(*x, "z") for x in rows], SCHEMA)
    names = ["_id", "_x", "_spans", "row_id", "row_text", "row_spans", "of_id", "id", "x", "spans"]
    wide = df.selectExpr("*", *[f"'keep' as {n}" for n in names])
    out = substring_dedup.remove_repeats(wide)
    assert [x for x in out.columns if x in names] == names and {x._id for x in out.collect()} == {"keep"}
    got = [tuple(x) for x in out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert sorted(got, key=str) == brute(rows, 200)


def test_full_filters(spark, monkeypatch):
    """Shared phrases shorter than a window: filters too small for the table hand on no more than some rows a document, in several rounds."""
    monkeypatch.setattr(substring_dedup, "MOST_BITS", 1 << 14)
    r = random.Random(10)
    say = lambda k: "".join(r.choices("abcdefghij ", k=k))
    phrase, passage = say(150), say(260)
    rows = [(i, say(150) + (passage if i % 60 == 0 else phrase) + say(150)) for i in range(240)]
    counts, real = {}, substring_dedup.staged

    def counted(df, name):
        out = real(df, name)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(substring_dedup, "staged", counted)
    df = spark.createDataFrame([(*x, "z") for x in rows], SCHEMA).repartition(3)
    assert sorted((tuple(x) for x in substring_dedup.digest(df).collect()), key=str) == brute(rows, 200)
    assert sum(counts.values()) < 25 * len(rows), counts


@pytest.mark.parametrize("keep_first", [False, True])
def test_runs_and_batches(spark, monkeypatch, keep_first):
    """Classes and groups that span runs of MEET rows, Arrow batches and rounds; repeated rows."""
    monkeypatch.setattr(substring_dedup, "MEET", 40)
    monkeypatch.setattr(substring_dedup, "MOST_BITS", 1 << 14)
    rows = list({d: (d, t) for d, t in made(11) if d is not None}.values())
    if keep_first:
        seen, want = set(), []
        for d, t in sorted(rows):
            b = (t or "").encode()
            gone = [False] * len(b)
            for i in range(len(b) - 199):
                if b[i : i + 200] in seen:
                    gone[i : i + 200] = [True] * 200
                seen.add(b[i : i + 200])
            want.append((d, sum(gone)))
        rows += rows[:9]
        want += [x for x in want if x[0] in {d for d, _ in rows[-9:]}]
    else:
        rows += rows[:9]
        want = [(x[0], x[2]) for x in brute(rows, 200)]
    df = spark.createDataFrame([(*x, "z") for x in rows], SCHEMA).repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = substring_dedup.remove_repeats(df, keep_first=keep_first).select("doc_id", "n_removed").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(map(tuple, got)) == sorted(want)

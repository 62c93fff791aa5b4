"""Operators 3 and 10, the pipeline and the helpers, against brute force."""

import base64
import collections
import glob
import hashlib
import io
import random
import re
import time
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wayfarer.llm import common, jaccard, quality, warc
from wayfarer.llm.queries import QUERIES, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# Operator 3


def expected(rows, least=0):
    first = {}
    for i, html in rows:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    out = []
    for i, html in rows:
        raw, of = (html or "").encode(), first.get(html or "")
        again = len(raw) >= least and of is not None and of != i
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", of if again else None))
    return collections.Counter(out)


def test_warc_of_whole_table(spark, sf):
    rows = [(r.page_id, r.html) for r in table(spark, sf, "pages").collect()]
    assert collections.Counter(tuple(r)[:5] for r in QUERIES["op3_warc"](spark, sf).collect()) == expected(rows)


@pytest.mark.parametrize("least", [0, 3])
def test_warc_awkward_rows(spark, least):
    rows = [(1, "u", "x"), (2, None, "x"), (3, "a\r\nb", None), (4, "", ""), (5, "é", "é😀\r\n\r\n"), (None, "n", "x"), (None, "n", "only"), (1, "u", "x"), (7, "z", "only2"), (6, "z", "only2"), (9, "q", "y" * 100_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as key", "2 as first", "3 as refers_to")
    manifest = warc.write_packages(df, least, package_bytes=200)
    got = warc.read_packages(manifest).collect()
    assert collections.Counter(tuple(r)[:5] for r in got) == expected([(a, c) for a, _, c in rows], least)
    assert warc.read_packages(warc.write_packages(df.limit(0))).collect() == []


def package(n=50):
    sink = io.BytesIO()
    writer = warc.PackageWriter(sink)
    for i in range(n):
        payload = f"page {i}".encode() * i
        writer.add(i, warc.record(i, f"http://x/{i}", payload, warc.digest_of(payload), None))
    writer.close()
    return sink.getvalue()


def test_package_is_a_zip_that_others_read_and_ranges_suffice():
    raw = package()
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert z.testzip() is None and {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED}
    reader = warc.PackageReader(pa.BufferReader(raw), fetch_bytes=500)
    assert [p for _, p in reader.records()] == [f"page {i}".encode() * i for i in range(50)]
    entry = list(reader.index())[17]
    assert warc.parse(reader.fetch(entry["offset"], entry["length"]))[1] == b"page 17" * 17


def test_zip64_directory_is_read():
    """A ZIP64 end record and extra fields, written by hand around one stored member."""
    import struct

    body = b"hello"
    local = struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45, 0, 0, 0, 0, 0, 5, 5, 1, 0) + b"m" + body
    extra = struct.pack("<HHQQQ", 1, 24, 5, 5, 0)
    central = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + b"m" + extra
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(central), len(local))
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, len(local) + len(central), 1)
    end = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 3) + b"hey"
    reader = warc.PackageReader(pa.BufferReader(local + central + end64 + locator + end))
    m = reader.members["m"]
    assert reader.source.read_at(m.size, reader.place("m")) == body


def test_damage_is_noticed():
    with pytest.raises(ValueError):
        warc.PackageReader(pa.BufferReader(b"nothing like a zip" * 10))


# Operator 10


def brute(rows, k, num, den):
    sets = {}
    for i, text in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = collections.defaultdict(list)
    for i, grams in sets.items():
        for g in grams:
            holders[g].append(i)
    for i, grams in sets.items():
        for j, n in collections.Counter(j for g in grams for j in holders[g] if j < i).items():
            if den * n >= num * (len(grams) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: (len(grams), root(i)) for i, grams in sets.items()}


def near_copies(seed=5):
    r, rows = random.Random(seed), []
    for _ in range(40):
        base = [r.choice("abcdefghij") + str(r.randint(0, 40)) for _ in range(r.choice([1, 3, 4, 5, 8, 10, 12, 15, 20, 30, 40, 60, 100, 200]))]
        for _ in range(r.randint(1, 12)):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 12))):
                if w:
                    p, x = r.randrange(len(w)), r.random()
                    if x < 0.4:
                        w[p] = "Z" + str(r.randint(0, 5))
                    elif x < 0.7:
                        del w[p]
                    else:
                        w.insert(p, "y")
            rows.append((len(rows) * 3, " ".join(w)))
    return rows + [(100_001, None), (100_003, ""), (100_005, " \n"), (100_007, "one"), (100_009, "ONE")]


@pytest.mark.parametrize("k,num,den,large", [(4, 85, 100, 64), (5, 80, 100, 3)])
def test_components_of_near_copies(spark, k, num, den, large):
    rows = near_copies()
    got = jaccard.clusters(spark.createDataFrame(rows, "doc_id long, text string"), k, num, den, large=large).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, k, num, den)


def test_components_of_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op10_jaccard"](spark, sf).collect()} == brute(rows, 4, 85, 100)


def test_passage_that_many_share_and_a_chain(spark):
    """Documents around one passage, some alike and most not quite, and a chain whose ends aren't alike."""
    r = random.Random(8)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join([*passage, *(f"u{i}x{j}" for j in range(r.randint(1, 25)))])) for i in range(150)]
    rows += [(1000 + i, " ".join(f"c{j}" for j in range(i * 3, i * 3 + 80))) for i in range(12)]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.clusters(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100, large=8).collect()}
    assert got == brute(rows, 4, 85, 100)
    assert got[1011][1] == 1000


def test_components_awkward_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A b c d e f"), (None, "x"), (4, "w " * 100_000)], "doc_id long, text string").selectExpr("*", "1 as key", "2 as comp", "3 as id", "4 as n")
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in jaccard.clusters(df).collect())
    assert got == [(0, 0), (0, 0), (1, 1), (1, 1), (2, 1), (4, 4)]
    assert sorted(r.doc_id or 0 for r in jaccard.keep_first(df).collect()) == [0, 0, 1, 4]
    assert jaccard.clusters(df.limit(0)).collect() == [] and jaccard.keep_first(df.limit(0)).collect() == []


def test_repeated_ids_with_other_texts_stay(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a, 1), (1, b, 2), (1, a.upper(), 3), (2, "", 4), (2, None, 5), (3, b, 6), (4, "z y x w v u", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, set_hash int")
    got = sorted((r.doc_id, r.text.lower() if r.text else "") for r in jaccard.keep_first(df).collect())
    assert got == sorted([(1, a), (1, b), (2, ""), (2, ""), (4, "z y x w v u")])


def test_components_without_broadcasts(spark, monkeypatch):
    """Every join by a shuffle, and sets that many pairs need in several parts."""
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", 0)
    monkeypatch.setattr(jaccard, "MEETS", 3)
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 5, 80, 100)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.clusters(df).collect()} == want
    assert {r.doc_id for r in jaccard.keep_first(df).collect()} == {c for _, c in want.values()}


def test_tables_leave_no_shuffle_files(spark, monkeypatch):
    """The index's are larger than all else: they must be gone before the next table is made."""
    local = [d.getPath() for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    write, labels = jaccard.written, set()

    def files():
        return {f for d in local for f in glob.glob(f"{d}/*/shuffle_*.data")}

    def watched(df, label):
        before, made = files(), write(df, label)
        deadline = time.time() + 5  # Spark deletes them on the side
        while files() - before and time.time() < deadline:
            time.sleep(0.05)
        assert not files() - before, label
        labels.add(label)
        return made

    monkeypatch.setattr(jaccard, "written", watched)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    rows, kept = near_copies()[:80], spark.conf.get(key)
    got = jaccard.clusters(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {"classes", "buckets", "members", "apart"} <= labels
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 5, 80, 100) and spark.conf.get(key) == kept


def test_histograms_never_drop_a_link():
    import numpy as np

    r = np.random.default_rng(1)
    for _ in range(300):
        n, m = int(r.integers(1, 3000)), int(r.integers(0, 400))
        common = r.integers(0, 1 << 63, n).astype(np.uint64)
        x, y = (np.concatenate([common, r.integers(0, 1 << 63, m).astype(np.uint64)]) for _ in range(2))
        cells = [np.frombuffer(jaccard.histogram(g), np.uint8).astype(int) for g in (x, y)]
        assert np.abs(cells[0] - cells[1]).sum() <= 2 * m


def check_links(df, rows, k, num, den):
    """Every link between classes, and the class and number of links of every row, by comparing all."""
    sets = {}
    for i, text in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        sets[i] = frozenset(" ".join(w[j : j + k]) for j in range(max(len(w) - k + 1, 1))) if w else frozenset()
    rep = {}
    for i in sorted(sets):
        rep.setdefault(sets[i], i)
    first = sorted((i for s, i in rep.items() if s))
    want = {(a, b) for n, a in enumerate(first) for b in first[n + 1 :] if den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])}
    links, members = jaccard.join(df, k, num, den)
    found = [tuple(r) for r in links.select("a", "b").collect()]
    assert len(found) == len(want) and set(found) == want
    many = {i: sum(i in link for link in want) for i in first}
    assert sorted(tuple(r) for r in members.collect()) == sorted((i, rep[s] if s else None, many[rep[s]] if s else 0) for i, s in sets.items())
    return want


def test_every_link_of_the_whole_table(spark, sf):
    docs = table(spark, sf, "documents")
    assert check_links(docs, [(r.doc_id, r.text) for r in docs.collect()], 4, 85, 100)


def test_links_within_a_group_are_all_there(spark):
    """Twelve texts that differ in one last word each, a copy of one, a chain, and empty texts."""
    rows = [(i, " ".join([*(f"w{j}" for j in range(60)), f"u{i}"])) for i in range(12)] + [(50, " ".join([*(f"w{j}" for j in range(60)), "u3"])), (60, ""), (61, None)]
    rows += [(1000 + i, " ".join(f"c{j}" for j in range(i * 3, i * 3 + 80))) for i in range(6)]
    want = check_links(spark.createDataFrame(rows, "doc_id long, text string"), rows, 4, 85, 100)
    assert sum(b < 12 for _, b in want) == 66


# Helpers and the pipeline


def test_group_figures_with_a_hot_key(spark):
    df = spark.range(2000).select(F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 7).alias("k"), "id", F.lit(1).alias("__key_"))
    got = common.with_group_figures(df, "k", F.col("id"), {"least": (F.col("id"), "min"), "size": (F.lit(1), "sum")}, salts=5)
    want = df.groupBy(F.col("k").alias("kk")).agg(F.min("id").alias("l"), F.count("*").alias("s"))
    assert got.count() == 2000 and got.join(want, F.col("k").eqNullSafe(F.col("kk"))).filter("least = l and size = s").count() == 2000


def test_pipeline_stages_against_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    for (name, stage), check in zip(corpus_pipeline.STAGES, (check_quality, check_near, check_private, check_sequences)):
        out = common.written(stage(spark, docs, sf), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        check({r.doc_id: r for r in docs.collect()}, out.collect())
        docs = out


def check_quality(before, after):
    # All hosts of this table are normal, as test_quality_verdicts_of_whole_table tells by brute force.
    assert {r.doc_id for r in after} == {i for i, r in before.items() if quality.passes(r.text, quality.ALLOWED["normal"])}


def check_near(before, after):
    comps = brute([(i, r.text) for i, r in before.items()], 5, 80, 100)
    assert {r.doc_id for r in after} == {c for _, c in comps.values()}
    assert all(before[r.doc_id] == r for r in after)


def check_private(before, after):
    assert {r.doc_id for r in after} == set(before) and all(r.n_chars == len(r.text) for r in after)
    for r in after:
        old = before[r.doc_id].text
        assert (r.text == old) == (re.search(r"<(EMAIL|IP|CARD|PHONE|IBAN|NATIONAL_ID|LOCAL_PHONE)>", r.text) is None)
        assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r.text)


def check_sequences(before, after):
    assert {r.doc_id for r in after} == set(before)
    fill = collections.Counter()
    for r in after:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048 and len(fill) <= -(-sum(fill.values()) // 2048) + 1


def test_pipeline_on_odd_rows(spark):
    rows = [(1, None, None, None, 0), (None, "a " * 60, "en", "s", 120), (2, "", "en", "s", 0), (3, " ".join(f"w{i}" for i in range(60)) + " me@x.org", "en", "s", 1), (3, " ".join(f"w{i}" for i in range(60)) + " me@x.org", "en", "s", 1)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
        for _, stage in corpus_pipeline.STAGES:
            docs = common.written(stage(spark, docs, ""), "odd")
        assert docs.count() == bool(data)


def test_pipeline_query_runs(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


